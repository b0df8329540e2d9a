"""Reads of a time window and of what is new since a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..timeq import merge_windows


def overlapping(rows: DataFrame, t0: float, t1: float, a: str = "t0", b: str | None = "t1") -> DataFrame:
    """Intervals that overlap [t0, t1); points that lie in it."""
    if b is None:
        return rows.where((F.col(a) >= t0) & (F.col(a) < t1))
    return rows.where((F.col(a) < t1) & (F.col(b) > t0))


def time_window(evidence: DataFrame, video_id: str, t0: float, t1: float, kinds: list[str] | None = None) -> DataFrame:
    """Evidence of one video in a window: lines as points, the rest as intervals."""
    rows = evidence.where(F.col("video_id") == video_id)
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    point = F.col("kind") == "ocr"
    inside = (F.col("t0") >= t0) & (F.col("t0") < t1)
    return rows.where(F.when(point, inside).otherwise((F.col("t0") < t1) & (F.col("t1") > t0)))


def spans_since(evidence: DataFrame, since: Column | float) -> DataFrame:
    """What a follower has not seen: transcript that ends after ``since``, lines at or after it. A row that straddles it comes again."""
    s = since if isinstance(since, Column) else F.lit(since)
    return evidence.where(((F.col("kind") == "transcript") & (F.col("t1") > s)) | ((F.col("kind") == "ocr") & (F.col("t0") >= s)))


def segments_since(segments: DataFrame, level: str, since: float) -> DataFrame:
    return segments.where((F.col("level") == level) & (F.col("t1_secs") > since))


def window_text(evidence: DataFrame, windows: list[tuple[float, float]], most: int = 3) -> DataFrame:
    """Per video, kind and merged window the text in order; a line is told once a window."""
    merged = merge_windows(windows, most)
    chars = max(8000 // len(merged), 4000)
    which = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(merged))):
        which = F.when((F.col("t0") < b) & (F.greatest("t1", F.col("t0") + 1e-9) > a), F.lit(i)).otherwise(which)
    rows = evidence.withColumn("window", which).where("window is not null")
    once = rows.where("kind = 'ocr'").groupBy("video_id", "kind", "window", "text").agg(F.min(F.struct("t0", "id")).alias("m")).select("video_id", "kind", "window", "m.t0", "m.id", "text")
    rest = rows.where("kind <> 'ocr'").select("video_id", "kind", "window", "t0", "id", "text")
    g = rest.unionByName(once).groupBy("video_id", "kind", "window").agg(F.array_sort(F.collect_list(F.struct("t0", "id", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["text"]), "\n")
    return g.select("video_id", "kind", "window", F.size("r").alias("n"), F.substring(text, 1, chars).alias("text"))


def tumbling(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def consecutive_distinct(rows: DataFrame, by: list[str], order: list[str], value: str, most: int = 6) -> DataFrame:
    """Per group how many values differ from the one before by more than ``most`` bits; the first counts."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    new = before.isNull() | (F.bit_count(F.col(value).bitwiseXOR(before)) > most)
    return rows.withColumn("__new", new.cast("int")).groupBy(*by).agg(F.sum("__new").alias("distinct_frames"), F.count("*").alias("frames"))


def trailing_sum(rows: DataFrame, by: list[str], t: str, value: str, secs: int) -> DataFrame:
    """``rows`` with the sum of ``value`` over the last ``secs`` seconds, the present included."""
    w = Window.partitionBy(*by).orderBy(F.col(t).cast("long")).rangeBetween(-secs, 0)
    return rows.withColumn("trailing", F.sum(value).over(w))
