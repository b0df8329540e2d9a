"""Hybrid search: reciprocal-rank fusion of ranked lists, grouped into temporal units of each video."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STATE_RANK
from . import lexical, vector_search
from .catalog import selected
from .joins import nearest as nearest_in_time
from .joins import points_in
from .text_index import Source, index_of

RRF = 60
REST = 0.3


def list_depth(k: int) -> int:
    return min(max(5 * k, 20), 200)


def ranked(rows: DataFrame, name: str, depth: int) -> DataFrame:
    """A ranked list of evidence rows with ``score``: list, rank and the rows, to ``depth``."""
    top = lexical.top(rows, depth)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))).withColumn("list", F.lit(name))


def ranked_by_kind(rows: DataFrame, depth: int) -> DataFrame:
    """A ranked list for each kind of ``rows``, from one scan; tasks keep only what can be in a list."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= depth).withColumn("list", F.concat(F.lit("bm25:"), "kind"))


def fused(lists: list[DataFrame]) -> DataFrame:
    """One row per hit: ``score`` is the sum of 1/(60 + rank) over the lists that have it, ``sources`` names them."""
    keep = lexical.HIT
    every = reduce(DataFrame.unionByName, [x.select(*keep, "list", "rank") for x in lists])
    return every.groupBy(*keep).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), F.sort_array(F.collect_list("list")).alias("sources"))


def temporal_units(segments: DataFrame, extents: DataFrame) -> DataFrame:
    """video_id, unit, t0, t1, segment_id, how: the stretches that hits of a video are grouped by.

    Its scenes; else its shots, those over 90 s cut into round(length / 60) equal
    parts; else its chapters; else windows of 60 s over its extent (video_id,
    extent), which counts as 60 s at least and seven days at most.
    """
    order = F.create_map(*[F.lit(x) for kv in (("scene", 0), ("shot", 1), ("chapter", 2)) for x in kv])
    seg = segments.withColumn("__l", order[F.col("level")])
    best = seg.groupBy("video_id").agg(F.min("__l").alias("__best"))
    seg = seg.join(best, "video_id").where(F.col("__l") == F.col("__best"))
    length = F.col("t1_secs") - F.col("t0_secs")
    parts = F.when((F.col("level") == "shot") & (length > 90), F.greatest(F.round(length / 60), F.lit(1))).otherwise(F.lit(1)).cast("int")
    cut = seg.withColumn("__p", parts).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__p") - 1)))
    step = length / F.col("__p")
    at = lambda i: F.when(i == F.col("__p"), F.col("t1_secs")).otherwise(F.round(F.col("t0_secs") + step * i, 3))
    from_segments = cut.select("video_id", F.when(F.col("__i") == 0, F.col("t0_secs")).otherwise(at(F.col("__i"))).alias("t0"), at(F.col("__i") + 1).alias("t1"), F.col("id").alias("segment_id"), F.col("level").alias("how"))
    plain = extents.join(best, "video_id", "left_anti")
    n = F.ceil(F.least(F.greatest(F.coalesce("extent", F.lit(0.0)), F.lit(60.0)), F.lit(7 * 86400.0)) / 60).cast("int")
    windows = plain.select("video_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("video_id", (F.col("i") * 60.0).alias("t0"), (F.col("i") * 60.0 + 60).alias("t1"), F.lit(None).cast("string").alias("segment_id"), F.lit("window").alias("how"))
    every = from_segments.unionByName(windows)
    return every.withColumn("unit", F.row_number().over(Window.partitionBy("video_id").orderBy("t0", "t1", "segment_id")) - 1)


def in_units(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with their unit: the first that holds their start, else the video's last."""
    u = units.select("video_id", "unit", F.col("t0").alias("u0"), F.col("t1").alias("u1"), "segment_id", "how")
    found = points_in(hits, u, ["video_id"], "t0", "u0", "u1", how="left")
    unit = F.struct("unit", "u0", "u1", "segment_id", "how")
    first = found.groupBy(*hits.columns).agg(F.min(F.when(F.col("unit").isNotNull(), unit)).alias("u"))
    last = u.groupBy("video_id").agg(F.max(unit).alias("l"))
    whole = first.join(last, "video_id", "left")
    return whole.withColumn("u", F.coalesce("u", "l")).where("u is not null").select(*hits.columns, "u.*")


def grouped(hits: DataFrame, k: int, per_video: int | None = None, most_evidence: int = 4) -> DataFrame:
    """Units ranked by their best hit plus 0.3 of the rest; at most ``per_video`` a video, ``k`` in all."""
    key = F.struct((-F.col("score")).alias("s"), "id", "kind", "t0", "sources")
    g = hits.groupBy("video_id", "unit", "u0", "u1", "segment_id", "how").agg((F.max("score") + REST * (F.sum("score") - F.max("score"))).alias("score"), F.count("*").alias("n_hits"), F.slice(F.array_sort(F.collect_list(key)), 1, most_evidence).alias("evidence"))
    if per_video is not None:
        w = Window.partitionBy("video_id").orderBy(F.desc("score"), "unit")
        g = g.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(per_video, 1)).drop("__n")
    return g.orderBy(F.desc("score"), "video_id", "unit").limit(k)


def search(source: Source, units: DataFrame, query: str, k: int = 8, videos: list[str] | None = None, kinds: list[str] | None = None, per_video: int | None = None, until: float | None = None, embeddings: DataFrame | None = None, vector: list[float] | None = None, depth: int | None = None) -> DataFrame:
    """Lexical lists by kind and, given a query vector and embeddings (id, vector), a vector list; fused and grouped. ``depth`` of the lists: by ``k``, if not given."""
    window = (0.0, until) if until is not None else None
    wanted = kinds or ["transcript", "ocr", "description"]
    depth = list_depth(k) if depth is None else depth
    scored = lexical.bm25(source, query, videos, wanted, window)
    lists = [ranked_by_kind(scored, depth)]
    if vector is not None and embeddings is not None:
        near = vector_search.scored(embeddings.select(F.col("target_id").alias("id"), "vector"), vector).select("id", "score")
        lists.append(ranked(selected(index_of(source).rows(), videos, wanted, window).join(near, "id"), "text_vec", depth))
    return grouped(in_units(fused(lists), units), k, per_video)


def with_texts(found: DataFrame, source: Source) -> DataFrame:
    """Results of ``search`` with the text of each piece of evidence; they are few, so they are sent to where the texts are."""
    each = found.select("video_id", "unit", F.posexplode("evidence").alias("n", "e")).select("video_id", "unit", "n", "e", F.col("e.kind").alias("kind"), F.col("e.id").alias("id"))
    texts = index_of(source).texts().join(F.broadcast(each), ["kind", "id"])
    whole = texts.groupBy("video_id", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e", "text"))), lambda x: x["e"].withField("text", x["text"])).alias("evidence"))
    return found.drop("evidence").join(whole, ["video_id", "unit"]).orderBy(F.desc("score"), "video_id", "unit")


def thumbnails(hits: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """Hits (video_id, t, key) with the thumbnail nearest in time, within two seconds."""
    return nearest_in_time(hits, frames.where("thumbnail_blob is not null").select("video_id", F.col("t_secs").alias("thumb_t"), "thumbnail_blob"), ["video_id"], key, "t", "thumb_t", 2.0)


def least_state(videos: DataFrame) -> DataFrame:
    """The least advanced index state among videos: one row; of equals the first by id."""
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])
    return videos.agg(F.min_by("index_state", F.struct(rank[F.col("index_state")], "id")).alias("index_state"))
