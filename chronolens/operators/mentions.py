"""Exhaustive mention counts and library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_tokens, snippet
from .catalog import selected
from .text_index import Source, index_of, matched

FOUND = "term_i int, term string, kind string, id string, video_id string, t0 double, t1 double"


def mentions(source: Source, terms: list[str], prefix: bool = False, videos: list[str] | None = None, kinds: list[str] | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """Rows that hold a term as a phrase: term_i, term, kind, id, video_id, t0, t1; OCR text repeated within a minute counts once.

    One read of the postings, or of the texts, for all terms. Lines of on-screen text are known by a 64-bit hash and their length.
    """
    index = index_of(source)
    asked = [(i, t, query_tokens(t)) for i, t in enumerate(terms)]
    asked = [(i, t, p) for i, t, p in asked if p]
    if not asked:
        return index.rows().sparkSession.createDataFrame([], FOUND)
    rows = selected(matched(index, [(p, prefix) for _, _, p in asked]), videos, kinds, window)
    hit = [F.when(F.col(f"f{k}") > 0, F.struct(F.lit(i).alias("term_i"), F.lit(t).alias("term"))) for k, (i, t, _) in enumerate(asked)]
    found = rows.select("kind", "id", "video_id", "t0", "t1", "line", "dl", F.explode(F.array_compact(F.array(*hit))).alias("h")).select("h.*", "kind", "id", "video_id", "t0", "t1", "line", "dl")
    lines = found.where("kind = 'ocr'").groupBy("term_i", "term", "kind", "video_id", "line", "dl", F.floor(F.col("t0") / 60).alias("minute")).agg(F.min(F.struct("t0", "t1", "id")).alias("m"))
    lines = lines.select("term_i", "term", "kind", "m.id", "video_id", "m.t0", "m.t1")
    return found.where("kind <> 'ocr'").select(*lines.columns).unionByName(lines)


def counts(found: DataFrame) -> DataFrame:
    """term, kind, video_id, n."""
    return found.groupBy("term_i", "term", "kind", "video_id").agg(F.count("*").alias("n"))


def samples(found: DataFrame, per_video: int, source: Source, prefix: bool = False) -> DataFrame:
    """The earliest rows of each term, kind and video, with ``text``: a snippet, or the line itself for OCR."""
    w = Window.partitionBy("term_i", "kind", "video_id").orderBy("t0", "id")
    some = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(per_video, 1))
    some = some.join(index_of(source).texts(), ["kind", "id"])
    return some.withColumn("text", F.when(F.col("kind") == "ocr", F.col("text")).otherwise(snippet(F.col("text"), F.col("term"), prefix)))


def video_totals(found: DataFrame, most: int | None = None) -> DataFrame:
    """Videos by mentions, most first; ties in order of the first term, kind and id. ``most`` leaves the best: one row of places a task then."""
    c = counts(found).withColumn("kind_i", F.expr("array_position(array('transcript', 'ocr', 'description'), kind)"))
    g = c.groupBy("video_id").agg(F.sum("n").alias("total"), F.min(F.struct("term_i", "kind_i", "video_id")).alias("first"))
    return placed(g, [F.desc("total"), F.col("first")], most).select("place", "video_id", "total")


def placed(rows: DataFrame, order: list, most: int | None = None) -> DataFrame:
    """``rows`` with their ``place`` in an order of all of them.

    Sorted over all tasks; a task numbers its own rows, and how many stand before it are sums that the driver holds, one a task.
    With ``most`` only so many are wanted, and sorted as a top-k.
    """
    if most is not None:
        rows = rows.orderBy(*order).limit(most)
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    ordered = rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())
    n = ordered.groupBy(F.shiftright("__m", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()
    base, at = {}, 0
    for r in sorted(n, key=lambda r: r["p"]):
        base[r["p"]], at = at, at + r["n"]
    first = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in base.items() for x in kv]), F.shiftright("__m", 33)) if base else F.lit(0)
    return ordered.withColumn("place", first + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__m")


def _asked(found: DataFrame, terms: list[str]) -> DataFrame:
    """(term_i, term) of all the terms that were asked for and have words, found or not."""
    return found.sparkSession.createDataFrame([(i, t) for i, t in enumerate(terms) if query_tokens(t)], "term_i int, term string")


def by_library(found: DataFrame, terms: list[str]) -> DataFrame:
    """Per term asked, with hits or without: total, videos with any hit, hits by kind."""
    by = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("transcript", "ocr", "description")]
    hit = found.groupBy("term_i").agg(F.count("*").alias("total"), F.countDistinct("video_id").alias("videos"), *by)
    out = F.broadcast(_asked(found, terms)).join(hit, "term_i", "left")
    return out.select("term_i", "term", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in hit.columns[1:]])


def by_channel(found: DataFrame, videos: DataFrame, terms: list[str]) -> DataFrame:
    """Per term asked and channel, those without hits included; no channel counts as ``unknown``."""
    channel = F.coalesce(F.col("channel"), F.lit("unknown")).alias("channel")
    of = videos.select(F.col("id").alias("video_id"), channel)
    words = [(i, t) for i, t in enumerate(terms) if query_tokens(t)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("term_i"), F.lit(t).alias("term")) for i, t in words]) if words else F.array().cast("array<struct<term_i: int, term: string>>"))
    every = of.select("channel").distinct().select("channel", each.alias("t")).select("t.*", "channel")
    hit = found.join(of, "video_id").groupBy("term_i", "channel").agg(F.count("*").alias("total"), F.countDistinct("video_id").alias("videos"))
    return every.join(hit, ["term_i", "channel"], "left").select("term_i", "term", "channel", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("videos", F.lit(0)).cast("long").alias("videos"))


def library(videos: DataFrame) -> DataFrame:
    """Per channel videos and seconds, and the whole library as channel null."""
    rows = videos.select(F.coalesce("channel", F.lit("unknown")).alias("channel"), F.coalesce("duration_secs", F.lit(0.0)).alias("secs"))
    return rows.rollup("channel").agg(F.count("*").alias("videos"), F.sum("secs").alias("secs"))


def per_video(videos: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table (video_id) by video: one aggregate a table, joined to all videos."""
    out = videos.select(F.col("id").alias("video_id"))
    for name, rows in tables.items():
        out = out.join(rows.groupBy("video_id").agg(F.count("*").alias(f"n_{name}")), "video_id", "left")
    return out.select("video_id", *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in tables])


def pattern_hits(evidence: DataFrame, pattern: str) -> DataFrame:
    """Times, to a tenth of a second, at which a case-insensitive pattern occurs in each video."""
    hit = evidence.where(F.col("text").rlike(f"(?i){pattern}"))
    return hit.groupBy("video_id").agg(F.sort_array(F.collect_set(F.round("t0", 1))).alias("times"), F.count("*").alias("n"))
