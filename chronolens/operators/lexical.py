"""Lexical retrieval: BM25 over postings, of a stored index or of evidence as it is.

Statistics (rows, mean length, rows per term) are those of a kind's whole table,
so filters do not change scores. Of a stored index they are sums that a write leaves behind, and one aggregate of the
postings of the query's words: texts are never read. Of evidence as it is they are one pass over the texts, and hits are another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_text_terms
from .catalog import selected
from .text_index import Source, index_of, matched

K1, B = 1.2, 0.75
HIT = ["kind", "id", "video_id", "t0", "t1"]


def bm25(source: Source, query: str, videos: list[str] | None = None, kinds: list[str] | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """Evidence rows (kind, id, video_id, t0, t1) that hold any of the query's words, with ``score``; filters come before any limit."""
    terms, index = free_text_terms(query), index_of(source)
    if not terms:
        return index.rows().withColumn("score", F.lit(0.0)).where(F.lit(False))
    # a row a kind, of which there are three
    stats = F.broadcast(index.statistics(terms, kinds))
    f = [F.col(f"f{i}").cast("double") for i in range(len(terms))]
    some, score = F.lit(False), F.lit(0.0)
    mean = F.coalesce(F.nullif(F.col("total") / F.col("rows"), F.lit(0.0)), F.lit(1.0))
    for i in range(len(terms)):
        n = F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("rows") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        some = some | (f[i] > 0)
        score = score + idf * f[i] * (K1 + 1) / (f[i] + K1 * (1 - B + B * F.col("dl") / mean))
    return selected(matched(index, terms), videos, kinds, window).where(some).join(stats, "kind").select(*HIT, score.alias("score"))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best by score; ties go to the smaller id."""
    return rows.orderBy(F.desc("score"), "id").limit(k)


def top_by_kind(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each kind, then the k best of these together."""
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    return top(rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n"), k)
