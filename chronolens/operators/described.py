"""Model replies as rows: the text of descriptions, and entities, mentions and events from windows of lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..providers import Llm
from ..timeq import hms
from .folds import canonical

KINDS = ("person", "object", "text", "place", "concept")
WINDOW_SECS = 300.0
MOST_CHARS = 24_000


def _flat(value: object, by: str) -> str:
    """Text as it is, a list joined, null as nothing, all else as JSON."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return by.join(t for t in (x.strip() if isinstance(x, str) else _json(x) for x in value) if t)
    return "" if value is None else _json(value)


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _counted(thing: object) -> str | None:
    """``{"name": "chairs", "count": 2}`` as "2 chairs"; nothing where the count is zero."""
    if isinstance(thing, str):
        return thing.strip() or None
    name = thing.get("name") if isinstance(thing, dict) else None
    if not isinstance(name, str) or not name.strip():
        return None
    n = thing.get("count")
    if isinstance(n, str) and n.strip().isdigit():
        n = int(n)
    if isinstance(n, bool) or not isinstance(n, (int, float)):
        return name.strip()
    n = int(max(0.0, n) + 0.5)
    return f"{n} {name.strip()}" if n else None


def description(raw: str | None) -> tuple[str, str | None]:
    """(searchable text, JSON object) of a reply: a scene in the order of its fields, a shot as sentences, prose as it is."""
    bare = (raw or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        found = json.loads(bare)
    except ValueError:
        return bare, None
    if not isinstance(found, dict):
        return bare, None
    if "people" in found or "objects" in found:
        things = found.get("objects")
        parts = [_flat(found.get("summary"), " "), _flat(found.get("people"), "; "), ", ".join(filter(None, map(_counted, things))) if isinstance(things, list) else "", _flat(found.get("actions"), "; "), _flat(found.get("on_screen_text"), "; ")]
        text = ""
        for p in filter(None, map(str.strip, parts)):
            text += ("" if not text else " " if text[-1] in ".!?" else ". ") + p
    else:
        text = " ".join(filter(None, (_flat(found.get(k), "; ") for k in ("summary", "visible", "actions", "on_screen_text", "topics"))))
    return text or bare, _json(found)


def described(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with ``text`` and ``structured`` in the place of ``raw``."""

    @F.pandas_udf("text string, structured string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([description(r) for r in x], columns=["text", "structured"], dtype=object)

    return replies.withColumn("__d", run(F.col(raw))).select(*[c for c in replies.columns if c != raw], "__d.text", "__d.structured")


def undescribed(segments: DataFrame, descriptions: DataFrame, provenance: DataFrame, prompt: str, provider: str, model: str) -> DataFrame:
    """Segments that the same prompt, provider and model have not described yet: those alone are paid for."""
    same = provenance.where((F.col("operator") == "vlm_describe") & (F.col("prompt_hash") == prompt) & (F.col("provider") == provider) & (F.col("model") == model)).select(F.col("id").alias("provenance_id"))
    done = descriptions.where("target_kind = 'segment'").join(same, "provenance_id", "left_semi").select(F.col("target_id").alias("id"))
    return segments.join(done, "id", "left_anti")


def _without_loose_commas(text: str) -> str:
    """Without commas, outside strings, that the end of a list or an object follows."""
    out, inside, skip = [], False, False
    for i, c in enumerate(text):
        if inside:
            inside = skip or c != '"'
            skip = not skip and c == "\\"
        elif c == '"':
            inside = True
        elif c == "," and text[i + 1 :].lstrip()[:1] in ("}", "]"):
            continue
        out.append(c)
    return "".join(out)


def object_in(reply: str | None) -> dict | None:
    """The JSON object in a reply, prose and fences around it and loose commas in it forgiven."""
    text = (reply or "").strip()
    inner = text[text.find("{") : text.rfind("}") + 1]
    for some in (text, inner, _without_loose_commas(inner)):
        try:
            found = json.loads(some)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def lines_of(transcripts: DataFrame, scenes: DataFrame) -> DataFrame:
    """video_id, t, line: transcript spans and scene descriptions (video_id, t0, text) as timed lines."""
    at = lambda head: F.concat(F.lit("["), hms(F.col("t0")), F.lit(head))
    said = transcripts.select("video_id", F.col("t0").alias("t"), F.concat(at("] "), "text").alias("line"))
    return said.unionByName(scenes.select("video_id", F.col("t0").alias("t"), F.concat(at("] (scene) "), F.substring("text", 1, 1200)).alias("line")))


def prompts(lines: DataFrame, secs: float = WINDOW_SECS) -> DataFrame:
    """video_id, w0, text: the lines of each window in order of time, cut at ``MOST_CHARS``; empty windows have none."""
    w0 = (F.floor(F.col("t") / secs) * secs).cast("double").alias("w0")
    g = lines.groupBy("video_id", w0).agg(F.array_sort(F.collect_list(F.struct("t", "line"))).alias("l"))
    return g.select("video_id", "w0", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 1, MOST_CHARS).alias("text"))


def replies(asked: DataFrame, model: Llm) -> DataFrame:
    """``asked`` (video_id, w0, text) with the model's ``reply``, asked in batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.generate(x.tolist()), dtype=object)

    return asked.withColumn("reply", run(F.col("text")))


_FOUND = "video_id string, w0 double, n int, what string, name string, kind string, canonical string, t0 double, t1 double, text string, participants array<string>"


def extracted(asked: DataFrame) -> DataFrame:
    """What replies (video_id, w0, reply) hold, a row an entity, mention or event; replies without an object hold nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        many = lambda x: x if isinstance(x, list) else []
        for b in batches:
            out = []
            for video, w0, reply in zip(b["video_id"], b["w0"], b["reply"]):
                found = object_in(reply) or {}
                for e in many(found.get("entities")):
                    name = e.get("name") if isinstance(e, dict) else None
                    if not isinstance(name, str) or not name.strip():
                        continue
                    key, kind = canonical(name), e.get("kind", "concept")
                    out.append((video, w0, len(out), "entity", name.strip(), kind if kind in KINDS else "concept", key, None, None, None, None))
                    for m in many(e.get("mentions")):
                        a, z = (number(m.get(k)) if isinstance(m, dict) else None for k in ("t0", "t1"))
                        if a is not None and z is not None:
                            out.append((video, w0, len(out), "mention", None, None, key, max(0.0, a), max(0.0, a, z), None, None))
                for e in many(found.get("events")):
                    a, z, text = (number(e.get("t0")), number(e.get("t1")), e.get("text")) if isinstance(e, dict) else (None,) * 3
                    if a is not None and z is not None and isinstance(text, str):
                        who = [canonical(p) for p in many(e.get("participants")) if isinstance(p, str)]
                        out.append((video, w0, len(out), "event", None, None, None, max(0.0, a), max(0.0, a, z), text.strip(), who))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return asked.select("video_id", "w0", "reply").mapInPandas(run, _FOUND)


def entities(found: DataFrame) -> DataFrame:
    """video_id, canonical_name, name, kind, mentions: a name's first window says what it is."""
    e = found.where("what = 'entity'").groupBy("video_id", "canonical").agg(F.min_by(F.struct("name", "kind"), F.struct("w0", "n")).alias("e"))
    m = found.where("what = 'mention'").groupBy("video_id", "canonical").agg(F.count("*").alias("mentions"))
    return e.join(m, ["video_id", "canonical"], "left").select("video_id", F.col("canonical").alias("canonical_name"), "e.name", "e.kind", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


def events(found: DataFrame) -> DataFrame:
    """video_id, t0, t1, text, participants: only those that are entities by then, of that window or one before."""
    known = found.where("what = 'entity'").groupBy("video_id", "canonical").agg(F.min("w0").alias("since"))
    e = found.where("what = 'event'").select("video_id", "w0", "n", "t0", "t1", "text", F.posexplode_outer("participants").alias("k", "canonical"))
    who = e.join(known, ["video_id", "canonical"], "left")
    named = F.when(F.col("since") <= F.col("w0"), F.struct("k", "canonical"))
    g = who.groupBy("video_id", "w0", "n", "t0", "t1", "text").agg(F.array_sort(F.collect_list(named)).alias("p"))
    return g.select("video_id", "t0", "t1", "text", F.transform("p", lambda x: x["canonical"]).alias("participants"))


def depth_scores(rows: DataFrame, by: list[str], order: list[Column], similarity: str) -> DataFrame:
    """``rows`` with ``depth``: how deep each gap's similarity lies under the peaks on both sides, by windows alone.

    A peak is where going away from the gap the similarity falls for the first time: the far end of the run that falls
    towards the gap, on the left, and that rises from it, on the right.
    """
    w, s = Window.partitionBy(*by).orderBy(*order), F.col(similarity)
    before = F.lag(similarity).over(w)
    rows = rows.withColumn("__l", F.sum(F.when(before < s, 1).otherwise(0)).over(w)).withColumn("__r", F.sum(F.when(before > s, 1).otherwise(0)).over(w))
    left = F.first(similarity).over(Window.partitionBy(*by, "__l").orderBy(*order))
    right = F.last(similarity).over(Window.partitionBy(*by, "__r").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("depth", (left - s) + (right - s)).drop("__l", "__r")
