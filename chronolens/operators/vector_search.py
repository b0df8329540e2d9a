"""Exact vector retrieval by cosine: one scan, filters before scores, top-k kept per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cosine


def scored(rows: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """``rows`` with their cosine to ``query``; another dimension is an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    checked = F.when(F.size(v) == len(query), v).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("array<double>"))
    return rows.withColumn("score", cosine(checked, q))


def nearest(rows: DataFrame, query: list[float], k: int, vector: str = "vector", key: str = "id") -> DataFrame:
    return scored(rows, query, vector).orderBy(F.desc("score"), key).limit(k)


def fetched(rows: DataFrame, targets: list[tuple[str, str]], model: str) -> DataFrame:
    """Vectors of targets in the order asked, null where there is none: pos, target_kind, target_id, vector."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(targets)], "pos int, target_kind string, target_id string")
    have = rows.where(F.col("model") == model).select("target_kind", "target_id", "vector")
    return asked.join(have, ["target_kind", "target_id"], "left").select("pos", "target_kind", "target_id", "vector").orderBy("pos")
