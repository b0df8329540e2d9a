"""License scans by patience alignment.

A text is compared with licence templates word by word (letters and digits, case
ignored). Words that occur once in the stretch of text and once in the template
are anchors; the longest increasing run of them is kept, and the gaps between
anchors are aligned in the same way; a gap without anchors is aligned by longest
common subsequence. Coverage is the share of the template's words that align.

Where to look: a stretch that covers a template by ``least`` or more lacks few
of its words, so it holds one of any set of words that makes up more than the
rest. The longest words serve as that set. A stretch reaches a template's length
and a quarter before and after such a word; what it aligns is not looked at again.

Marks, words and version numbers that tell licences apart, must all align, and no
other mark may stand among the aligned words. A notice inside a longer one is part of it.
A short notice doesn't count where it is denied: by a word such as *not* right before it, or, if some of its words are
lacking, two words before it or among them.

Every document gives one row. Null and empty texts, and texts without a licence,
have null license and coverage 0. Of several licences the one of highest
coverage counts, then the one with more words, then the first by name;
``n_licenses`` counts them all. Texts are read whole; repeated rows repeat their
result; columns beyond doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import HEADERS, TEXTS

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    # alone it doesn't tell which BSD licence; a hit inside that of a longer template isn't counted
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    **HEADERS,
    **TEXTS,
}
#: words that tell one licence from another, as numbers of versions do: those of the template must align, and none else may stand among what aligns
MARKS = {"nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs", "lesser", "library", "affero", "neither", "endorse"}
_BEFORE = {"version", "v", "cc", "by", "nc", "sa", "nd", "license", "attribution", "noncommercial", "sharealike", "noderivatives"}
_DENIES, _SHORT = {"not", "never", "no", "isn", "aren", "without"}, 30
LEAST = 0.8
SCHEMA = "doc_id long, license string, coverage double, n_matched long, n_licenses long"
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second ones rise: patience sorting with back links."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if a[i] == b[j] else max(rows[i + 1][j], rows[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of aligned equal words."""
    if not a or not b:
        return []
    ca, cb = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if cb[w] == 1}
    anchors = _longest_rise([(i, place[w]) for i, w in enumerate(a) if ca[w] == 1 and w in place])
    if not anchors:
        return _common(a, b)
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in align(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def marks(found: list[str]) -> list[bool]:
    """Which words are marks: ``MARKS``, and numbers of versions, but for zeros and years."""
    out, number = [], False
    for i, w in enumerate(found):
        number = w.isdigit() and len(w) < 3 and i > 0 and (found[i - 1] in _BEFORE or number)
        out.append(w in MARKS or number and w != "0")
    return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        self.least, self.templates = least, []
        for name, text in sorted(templates.items()):
            t = words(text)
            need, keys = len(t) - least * len(t), set()
            for w in sorted(set(t), key=lambda w: (-len(w), w)):
                keys.add(w)
                if sum(x in keys for x in t) > need:
                    break
            self.templates.append((name, t, keys, Counter(t), {j for j, m in enumerate(marks(t)) if m}))
        self.by_key: dict[str, list[int]] = {}
        for n, (_, _, keys, _, _) in enumerate(self.templates):
            for k in keys:
                self.by_key.setdefault(k, []).append(n)
        # numbers and words of a letter occur everywhere in a text; words are looked up whole
        self.keys = set(self.by_key)

    def _fits(self, found: list[str], lo: int, hi: int, t: list[str], own: set[int], marked: list[bool]) -> list[tuple[int, int]]:
        """The aligned words of ``found[lo:hi]``, if enough of them do and the marks agree."""
        pairs = align(found[lo:hi], t)
        if not pairs or len(pairs) / len(t) < self.least or not own <= {j for _, j in pairs}:
            return []
        used, first, last = {i + lo for i, _ in pairs}, lo + pairs[0][0], lo + pairs[-1][0]
        # a number or mark right after what aligns goes on with it: version 2.1, by 4 0 is over
        if len(t) <= _SHORT:
            near = 1 if len(pairs) == len(t) else 2
            said = found[max(0, first - near) : first] + ([found[i] for i in range(first, last) if i not in used] if near == 2 else [])
            if not _DENIES.isdisjoint(said):
                return []
        end = last + 1 if last + 1 < len(found) and pairs[-1][1] == len(t) - 1 and pairs[-1][1] in own and found[last + 1].isdigit() else last
        return [] if any(marked[i] and i not in used for i in range(first, end + 1)) else pairs

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, words aligned, first word, last word) of each licence, best first."""
        found = words(text) if text else []
        held: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            if w in self.keys:
                held.setdefault(w, []).append(i)
        if not held:
            return []
        marked, hits = marks(found), []
        for n in sorted({n for k in held for n in self.by_key[k]}):
            name, t, keys, count, own = self.templates[n]
            need, reach = self.least * len(t), len(t) + len(t) // 4 + 1
            if len(found) < need:
                continue
            after = skip = -1
            for p in sorted(i for k in keys for i in held.get(k, ())):
                if p <= after or p < skip:
                    continue
                lo, hi = max(0, p - reach, after + 1), min(len(found), p + reach + 1)
                lack = need - sum((Counter(found[lo:hi]) & count).values())
                if lack > 0:
                    # a window further on by a word has one word more at most
                    skip = p + lack
                    continue
                pairs = self._fits(found, lo, hi, t, own, marked)
                if not pairs and len(t) <= 60:
                    # other notices in the window can hide this one: closer ones, by the word's places
                    for j in [j for j, w in enumerate(t) if w == found[p]]:
                        x, y = max(lo, p - j), min(hi, p - j + len(t))
                        for wide in (0, 2, len(t) // 4):
                            pairs = pairs or self._fits(found, max(lo, x - wide), min(hi, y + wide), t, own, marked)
                        if pairs:
                            lo = max(lo, x - next(w for w in (0, 2, len(t) // 4) if self._fits(found, max(lo, x - w), min(hi, y + w), t, own, marked)))
                            break
                if pairs:
                    after = lo + pairs[-1][0]
                    hits.append((name.partition("#")[0], len(pairs) / len(t), len(pairs), lo + pairs[0][0], after))
        best: dict[str, tuple] = {}
        for h in hits:
            if any(o[3] <= h[3] and h[4] <= o[4] and o[2] > h[2] for o in hits):
                continue  # part of a longer notice
            if h[0] not in best or (h[1], h[2], -h[3]) > (best[h[0]][1], best[h[0]][2], -best[h[0]][3]):
                best[h[0]] = h
        return sorted(best.values(), key=lambda x: (-x[1], -x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row per document: its licence, coverage, words aligned and number of licences found; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(templates, least)
        for batch in batches:
            hits = [own.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h[0][0] if h else None for h in hits], pa.string()),
                    pa.array([h[0][1] if h else 0.0 for h in hits], pa.float64()),
                    pa.array([h[0][2] if h else 0 for h in hits], pa.int64()),
                    pa.array([len(h) for h in hits], pa.int64()),
                ],
                names=["doc_id", "license", "coverage", "n_matched", "n_licenses"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
