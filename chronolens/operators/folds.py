"""Ordered per-video folds: pure functions over one video's rows, and their DataFrame forms.

Each needs the state left by the row before, so none is a window function. A
video's rows are at most hours of samples and fit in a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Cue = tuple[float, float, str]


def dedup_rolling(cues: list[Cue]) -> list[Cue]:
    """Captions without what they repeat of the one before: an equal text or its end prolongs it, a longer text keeps its new end."""
    out: list[list] = []
    shown = ""
    for t0, t1, text in cues:
        text = " ".join(text.split())
        if not text:
            continue
        if out and (text == shown or shown.endswith(text)):
            out[-1][1] = max(out[-1][1], t1)
            continue
        new = text[len(shown) :].strip() if out and shown and text.startswith(shown + " ") else text
        out.append([t0, t1, new])
        shown = text
    return [tuple(c) for c in out]


def group_cues(cues: list[Cue], target: float = 15.0, gap: float = 2.0) -> list[Cue]:
    """Neighbouring cues joined while they stay within ``target`` seconds and pauses within ``gap``."""
    out: list[list] = []
    for t0, t1, text in cues:
        if out and t1 - out[-1][0] <= target and t0 - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t1, out[-1][2] + " " + text
        else:
            out.append([t0, t1, text])
    return [tuple(c) for c in out]


def cut_step(recent: list[float], since: int, d: float, window: int = 20) -> tuple[bool, list[float], int]:
    """Does a frame that differs by ``d`` from the one before start a shot? And the distances and frames since the cut, after it."""
    since, n = since + 1, len(recent)
    if n >= 3:
        mean = sum(recent) / n
        dev = math.sqrt(sum((x - mean) ** 2 for x in recent) / n)
        odd = d > mean + 3 * dev and d > 2.5 * max(mean, 0.02)
    else:
        odd = d >= 0.475
    cut = d >= 0.25 and (d >= 0.7 or odd) and since > 2
    return cut, [] if cut else [*recent, d][-window:], 0 if cut else since


def shot_cuts(distances: list[float], window: int = 20) -> list[bool]:
    """Which frames start a shot, from their distances to the frame before."""
    recent: list[float] = []
    out, since = [], 0
    for d in distances:
        cut, recent, since = cut_step(recent, since, d, window)
        out.append(cut)
    return out


def shots(times: list[float], distances: list[float], duration: float) -> list[tuple[float, float]]:
    """Shots without gaps from 0 to the duration."""
    starts = [0.0, *[t for t, c in zip(times, shot_cuts(distances)) if c and 0 < t < duration]]
    return list(zip(starts, [*starts[1:], duration]))


def keep_distinct(hashes: list[int], most: int = 6) -> list[bool]:
    """Frames that differ from the last one kept by more than ``most`` bits."""
    kept, out = None, []
    for h in hashes:
        new = kept is None or ((h ^ kept) & (2**64 - 1)).bit_count() > most
        kept = h if new else kept
        out.append(new)
    return out


def read_gate(times: list[float], hashes: list[int], changes: list[float], bits: int = 6, change: float = 0.02, gap: float = 30.0) -> list[bool]:
    """Frames worth reading: changed against the last one read, or it is ``gap`` seconds ago."""
    last, out = None, []
    for t, h, c in zip(times, hashes, changes):
        go = last is None or ((h ^ last[1]) & (2**64 - 1)).bit_count() > bits or c >= change or t - last[0] >= gap
        last = (t, h) if go else last
        out.append(go)
    return out


def new_lines(reads: list[list[str]]) -> list[list[str]]:
    """Lines of each read that the read before didn't have; lines of one character are dropped."""
    before: set[str] = set()
    out = []
    for lines in reads:
        good = [x.strip() for x in lines if len(x.strip()) >= 2]
        out.append([x for x in dict.fromkeys(good) if x not in before])
        before = set(good)
    return out


def speech(probabilities: list[float], hop: float = 0.032, on: float = 0.5, off: float = 0.35, merge: float = 1.0, least: float = 0.25, most: float = 120.0, pad: float = 0.2) -> list[tuple[float, float]]:
    """Speech stretches: hysteresis, near ones merged, short ones dropped, long ones split at their quietest middle, padded, disjoint."""
    raw: list[list[int]] = []
    talking = False
    for i, p in enumerate(probabilities):
        if not talking and p >= on:
            raw.append([i, i + 1])
            talking = True
        elif talking and p < off:
            talking = False
        elif talking:
            raw[-1][1] = i + 1
    joined: list[list[int]] = []
    for a, b in raw:
        if joined and (a - joined[-1][1]) * hop < merge:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    kept = [x for x in joined if (x[1] - x[0]) * hop >= least]
    done: list[list[int]] = []
    while kept:
        a, b = kept.pop(0)
        if (b - a) * hop > most:
            lo, hi = a + (b - a) // 4, b - (b - a) // 4
            at = min(range(lo, hi), key=lambda i: (probabilities[i], i))
            kept[:0] = [[a, at], [at, b]]
        else:
            done.append([a, b])
    end = len(probabilities) * hop
    out = [[max(0.0, a * hop - pad), min(end, b * hop + pad)] for a, b in done]
    for x, y in zip(out, out[1:]):
        if x[1] > y[0]:
            x[1] = y[0] = (x[1] + y[0]) / 2
    return [tuple(x) for x in out]


def shape_words(words: list[tuple[str, float, float, float]], most: float = 15.0, gap: float = 1.5) -> list[tuple[float, float, str, float]]:
    """Words (text, start, end, confidence) as spans: a new one after a pause or when one grows too long, cut at a sentence's end in its second half if there is one."""
    spans: list[list] = [[]]
    for w in words:
        now = spans[-1]
        if now and w[1] - now[-1][2] > gap:
            spans.append([w])
            continue
        if now and w[2] - now[0][1] > most:
            half = now[0][1] + most / 2
            ends = [i for i, x in enumerate(now[:-1]) if x[2] >= half and x[0].rstrip()[-1:] in ".?!"]
            pauses = [(now[i + 1][1] - now[i][2], -i) for i in range(len(now) - 1) if now[i][2] >= half]
            at = ends[-1] + 1 if ends else (-max(pauses)[1] + 1 if pauses and max(pauses)[0] > 0 else len(now))
            spans[-1], rest = now[:at], now[at:]
            spans.append([*rest, w])
        else:
            now.append(w)
    return [(s[0][1], s[-1][2], " ".join(x[0].strip() for x in s), sum(x[3] for x in s) / len(s)) for s in spans if s]


def split_long(spans: list[tuple[float, float]], starts: list[float], most: float = 180.0, part: float = 120.0, snap: float = 10.0) -> list[tuple[float, float]]:
    """Shots over ``most`` seconds in round(length / part) parts, cut at a span's start if one is near."""
    out = []
    for a, b in spans:
        n = max(1, round((b - a) / part)) if b - a > most else 1
        cuts = [a]
        for i in range(1, n):
            t = a + (b - a) * i / n
            near = min(starts, key=lambda s: (abs(s - t), s), default=None)
            t = near if near is not None and abs(near - t) <= snap and cuts[-1] < near < b else t
            cuts.append(t)
        out += list(zip(cuts, [*cuts[1:], b]))
    return out


def scenes(spans: list[tuple[float, float]], strength: list[float], weak: float = 0.5, short: float = 20.0, most: float = 180.0) -> list[tuple[float, float]]:
    """Shots merged into scenes; ``strength[i]`` is that of the boundary after shot i.

    The weakest boundary that is weak, or beside a short scene, goes first, if the
    joined scene is not too long; then short scenes left join their weaker side.
    """
    parts, walls = [list(x) for x in spans], list(strength)

    def merge(i: int) -> None:
        parts[i][1] = parts[i + 1][1]
        del parts[i + 1], walls[i]

    while True:
        able = [(w, i) for i, w in enumerate(walls) if (w < weak or parts[i][1] - parts[i][0] < short or parts[i + 1][1] - parts[i + 1][0] < short) and parts[i + 1][1] - parts[i][0] <= most]
        if not able:
            break
        merge(min(able)[1])
    while len(parts) > 1:
        i = next((i for i, (a, b) in enumerate(parts) if b - a < short), None)
        if i is None:
            break
        merge(i if i == 0 or (i < len(walls) and walls[i] < walls[i - 1]) else i - 1)
    return [tuple(p) for p in parts]


def depth_scores(similarity: list[float]) -> list[float]:
    """How deep each gap's similarity lies under the peaks on both sides."""
    n = len(similarity)
    left, right = list(similarity), list(similarity)
    for i in range(1, n):
        if similarity[i - 1] >= similarity[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if similarity[i + 1] >= similarity[i]:
            right[i] = right[i + 1]
    return [(a - s) + (b - s) for a, s, b in zip(left, similarity, right)]


def chapters(starts: list[float], total: float, depth: list[float], bonus: list[bool], each: float = 600.0, least: float = 180.0) -> list[tuple[float, float]]:
    """Chapters cut at the deepest gaps, ``depth[i]`` being that before unit i + 1; a changed title adds a quarter."""
    want = max(1, round(total / each))
    order = sorted(range(len(depth)), key=lambda i: (-(depth[i] + 0.25 * bonus[i]), i))
    cuts = [0.0]
    for i in order:
        t = starts[i + 1]
        if len(cuts) < want and depth[i] + 0.25 * bonus[i] > 0 and all(abs(t - c) >= least for c in cuts) and total - t >= least:
            cuts.append(t)
    cuts.sort()
    return list(zip(cuts, [*cuts[1:], total]))


def title_like(lines: list[str]) -> str | None:
    """The first line that may be a title: three to sixty characters, mostly letters."""
    for x in lines:
        x = x.strip()
        if 3 <= len(x) <= 60 and sum(c.isalpha() for c in x) >= 0.6 * len(x):
            return x
    return None


def canonical(name: str) -> str:
    return re.sub(r"\s+", " ", name.strip().lower())


def folded(rows: DataFrame, by: list[str], schema: str, fold: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """``fold`` over each group's rows; its tuples follow the group's key."""
    names = [c.strip().split(" ")[0].rstrip(":") for c in re.split(r",(?![^<]*>)", schema)]

    kinds = {"string": object, "long": "int64", "int": "int32", "double": "float64", "boolean": bool}
    none = pd.DataFrame({n: pd.Series([], dtype=kinds.get(c.split()[-1], object)) for n, c in zip(names, re.split(r",(?![^<]*>)", schema))})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(*key, *r) for r in fold(pdf)]
        return pd.DataFrame(out, columns=names) if out else none

    return rows.groupBy(*by).applyInPandas(run, schema)
