"""Joins on time. Each turns an interval condition into an equality on a time bin, so that it runs as a hash or sort-merge join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(t0: Column, t1: Column, width: float) -> Column:
    """Bins that the half-open [t0, t1) touches; one bin for a point."""
    first = F.floor(t0 / width)
    last = F.greatest(first, F.ceil(t1 / width) - 1)
    return F.sequence(first, last)


def points_in(points: DataFrame, spans: DataFrame, by: list[str], t: str = "t", t0: str = "t0", t1: str = "t1", width: float = 60.0, how: str = "inner") -> DataFrame:
    """Each point with the spans of its ``by`` that hold it (t0 <= t < t1)."""
    right = spans.withColumn("__bin", F.explode(bins(F.col(t0), F.col(t1), width)))
    left = points.withColumn("__bin", F.floor(F.col(t) / width))
    for c in by:
        right = right.withColumnRenamed(c, f"__{c}")
    on = F.col("__bin") == F.col("__rbin")
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    on = on & (F.col(t) >= F.col(t0)) & (F.col(t) < F.col(t1))
    out = left.join(right.withColumnRenamed("__bin", "__rbin"), on, how)
    return out.drop("__bin", "__rbin", *[f"__{c}" for c in by])


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a0: str, a1: str, b0: str, b1: str, width: float = 60.0) -> DataFrame:
    """Pairs whose half-open intervals overlap, each pair once: in the bin where the later of the two starts."""
    left = a.withColumn("__bin", F.explode(bins(F.col(a0), F.col(a1), width)))
    right = b.withColumn("__rbin", F.explode(bins(F.col(b0), F.col(b1), width)))
    for c in by:
        right = right.withColumnRenamed(c, f"__{c}")
    on = F.col("__bin") == F.col("__rbin")
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    on = on & (F.col(a0) < F.col(b1)) & (F.col(a1) > F.col(b0)) & (F.col("__bin") == F.floor(F.greatest(a0, b0) / width))
    return left.join(right, on).drop("__bin", "__rbin", *[f"__{c}" for c in by])


def nearest(points: DataFrame, samples: DataFrame, by: list[str], key: list[str], t: str, s: str, tolerance: float) -> DataFrame:
    """Each point with the sample nearest in [max(t - tolerance, 0), t + tolerance); ties go to the earlier; points without one are kept."""
    near = points.withColumn("__bin", F.explode(F.array(*[F.floor(F.col(t) / tolerance) + d for d in (-1, 0, 1)])))
    right = samples.withColumn("__rbin", F.floor(F.col(s) / tolerance))
    names = [c for c in samples.columns if c not in by]
    for c in by:
        right = right.withColumnRenamed(c, f"__{c}")
    on = F.col("__bin") == F.col("__rbin")
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    on = on & (F.col(s) >= F.greatest(F.col(t) - tolerance, F.lit(0.0))) & (F.col(s) < F.col(t) + tolerance)
    found = near.join(right, on).groupBy(*by, *[k for k in key if k not in by])
    best = found.agg(F.min_by(F.struct(*names), F.struct(F.abs(F.col(s) - F.col(t)), F.col(s))).alias("__best"))
    return points.join(best, [*by, *[k for k in key if k not in by]], "left").select(*points.columns, "__best.*")


def islands(spans: DataFrame, by: list[str], t0: str = "t0", t1: str = "t1", gap: float = 0.0) -> DataFrame:
    """Spans of each ``by`` that overlap, touch or lie within ``gap`` of each other, joined: by, t0, t1, n."""
    w = Window.partitionBy(*by).orderBy(t0, t1)
    before = F.max(t1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col(t0) > before + gap), 1).otherwise(0)
    marked = spans.withColumn("__first", first).withColumn("__island", F.sum("__first").over(w))
    return marked.groupBy(*by, "__island").agg(F.min(t0).alias(t0), F.max(t1).alias(t1), F.count("*").alias("n")).drop("__island")


def gaps(spans: DataFrame, by: list[str], t0: str = "t0", t1: str = "t1", least: float = 0.001) -> DataFrame:
    """Where a span starts more than ``least`` after the one before it ends: by, gap0, gap1."""
    before = F.lag(t1).over(Window.partitionBy(*by).orderBy(t0, t1))
    return spans.withColumn("__b", before).where(F.col(t0) - F.col("__b") > least).select(*by, F.col("__b").alias("gap0"), F.col(t0).alias("gap1"))
