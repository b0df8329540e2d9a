"""Sampling of frames and audio by time, and segments of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def sample_frames(frames: DataFrame, by: list[str], t: str, interval: float) -> DataFrame:
    """The first frame of each interval: once a target time is met, all targets up to it are."""
    slot = F.floor((F.col(t) + EPS) / interval)
    first = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(t))
    return frames.withColumn("__slot", slot).withColumn("__n", first).where("__n = 1").drop("__slot", "__n")


def audio_chunks(tracks: DataFrame, samples: str = "n_samples", chunk: int = 480_000, hop: int = 400_000, rate: int = 16_000) -> DataFrame:
    """Chunks of each track every ``hop`` samples; a last shorter one only if it is longer than the overlap."""
    n = F.col(samples)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"), F.lit(hop).cast("long"))
    out = tracks.where(n > 0).withColumn("s0", F.explode(starts)).withColumn("s1", F.least(F.col("s0") + chunk, n))
    whole = F.col("s1") - F.col("s0") == chunk
    return out.where((F.col("s0") == 0) | whole | (F.col("s1") - F.col("s0") > chunk - hop)).withColumn("t0", F.col("s0") / rate).withColumn("t1", F.col("s1") / rate)


def covering(segments: DataFrame, t0: float, t1: float) -> DataFrame:
    """Recorded segments that a time range touches."""
    return segments.where((F.col("t1") > t0) & (F.col("t0") < t1))


def head(segments: DataFrame, by: list[str]) -> DataFrame:
    return segments.groupBy(*by).agg(F.max("t1").alias("head"), F.min("t0").alias("t0"), F.count("*").alias("segments"))


def feed(segments: DataFrame, by: list[str], tick: float, ended: bool = True) -> DataFrame:
    """by, t, item: what a decoder of live segments (by, t0, t1) hands on, in order of t, then item.

    ``media`` a segment, ``gap`` where a segment starts after the one before it ends, ``tick`` each ``tick`` seconds
    of stream time that has been reached, ``end`` at the end.
    """
    w = Window.partitionBy(*by).orderBy("t0", "t1")
    until = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    media = segments.select(*by, F.col("t0").alias("t"), F.lit("media").alias("item"))
    gaps = segments.withColumn("__u", until).where(F.col("t0") > F.col("__u") + EPS).select(*by, F.col("t0").alias("t"), F.lit("gap").alias("item"))
    whole = segments.groupBy(*by).agg(F.min("t0").alias("a"), F.max("t1").alias("z"))
    n = F.floor((F.col("z") - F.col("a")) / tick).cast("int")
    ticks = whole.where(n > 0).select(*by, "a", F.explode(F.sequence(F.lit(1), n)).alias("k")).select(*by, (F.col("a") + F.col("k") * tick).alias("t"), F.lit("tick").alias("item"))
    out = media.unionByName(gaps).unionByName(ticks)
    return out.unionByName(whole.select(*by, F.col("z").alias("t"), F.lit("end").alias("item"))) if ended else out


def frame_rows(frames: DataFrame, track: str, t: str, timebase: int = 1000) -> DataFrame:
    """A row of ``frame_samples`` per sampled frame: its id names track and time, so that sampling again writes the same rows."""
    pts = F.round(F.col(t) * timebase).cast("long")
    return frames.select(F.sha2(F.concat_ws("|", track, pts.cast("string")), 256).alias("id"), F.col(track).alias("track_id"), F.col(t).alias("t_secs"), pts.alias("pts"), (F.row_number().over(Window.partitionBy(track).orderBy(t)) == 1).alias("is_keyframe"))


def state_of(last: Column) -> Column:
    return F.when(last, F.lit("ended")).otherwise(F.lit("live"))
