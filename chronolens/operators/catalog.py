"""The catalog: tables as Parquet, merges by key, deletes that cascade, the evidence view and reads bounded in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

EVIDENCE = ["kind", "id", "video_id", "t0", "t1", "text"]


class Catalog:
    """Tables under one directory, each an append-only log of Parquet files.

    Every append carries a sequence number; a read keeps the last row of each
    key, so writers never rewrite what is there. ``compact`` writes a table anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def open(self) -> Catalog:
        """Check the manifest, or write one; older versions gain columns as nulls when read."""
        at = f"{self.path}/manifest"
        if self._exists(at):
            schema.readable("\n".join(r[0] for r in self.spark.read.text(at).collect()))
        else:
            self.spark.createDataFrame([(schema.manifest(),)], "value string").coalesce(1).write.text(at)
        return self

    def append(self, name: str, rows: DataFrame, seq: int) -> None:
        """Upsert rows by key: of rows with one key the one of highest ``seq`` is read."""
        if rows.where(schema.violations(rows, name)).limit(1).count():
            raise ValueError(f"a value outside its enumeration in {name}")
        rows.withColumn("__seq", F.lit(seq)).withColumn("__deleted", F.lit(False)).write.mode("append").parquet(self._files(name))

    def delete(self, name: str, keys: DataFrame, seq: int) -> None:
        """Tombstones for keys."""
        keys.select(*schema.KEYS[name]).withColumn("__seq", F.lit(seq)).withColumn("__deleted", F.lit(True)).write.mode("append").parquet(self._files(name))

    def read(self, name: str) -> DataFrame:
        if not self._exists(self._files(name)):
            return schema.empty(self.spark, name)
        log = self.spark.read.schema(schema.TABLES[name] + ", __seq int, __deleted boolean").parquet(self._files(name))
        return latest(log, schema.KEYS[name], "__seq").where("not __deleted").drop("__seq", "__deleted")

    def compact(self, name: str, to: str) -> None:
        """Write the live rows of a table to another catalog directory."""
        self.read(name).withColumn("__seq", F.lit(0)).withColumn("__deleted", F.lit(False)).write.mode("overwrite").parquet(f"{to.rstrip('/')}/{name}")


def put_sessions(old: DataFrame, new: DataFrame, now: Column, secs: int) -> DataFrame:
    """Sessions after a write: ``new`` (id, state) lives ``secs`` from ``now``, first creation is kept, those expired by ``now`` go."""
    new = new.select("id", now.alias("created_at"), (now + F.make_interval(secs=F.lit(secs))).alias("expires_at"), "state")
    both = upsert(old.withColumn("first_at", F.col("created_at")), new.withColumn("first_at", F.lit(None).cast("timestamp")), ["id"], ("first_at",))
    return both.withColumn("created_at", F.coalesce("first_at", "created_at")).drop("first_at").where(F.col("expires_at") >= now).select(*old.columns)


def session_states(sessions: DataFrame, now: Column) -> DataFrame:
    """id, state of the sessions that can still be read."""
    return sessions.where(F.col("expires_at") >= now).select("id", "state")


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last written row of each key, aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``new`` over ``old`` by key; columns named in ``keep_if_null`` keep the old value where the new one is null."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b.withColumn("__new", F.lit(True)), keys, "full")
    pick = []
    for c in old.columns:
        if c in keys:
            pick.append(F.col(c))
        elif c in keep_if_null:
            pick.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c))
        else:
            pick.append(F.when(F.col("__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*pick)


def cascade(tables: dict[str, DataFrame], videos: DataFrame) -> dict[str, DataFrame]:
    """The tables without some videos (id) and all that hangs on them."""
    out = dict(tables)
    gone = videos.select(F.col("id").alias("video_id"))

    def without(name: str, keys: DataFrame, column: str) -> DataFrame:
        left = out[name].join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_anti").select(*out[name].columns)
        lost = out[name].join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
        out[name] = left
        return lost.select("id") if "id" in lost.columns else lost

    if "videos" in out:
        without("videos", gone, "id")
    lost_targets = []
    tracks = without("tracks", gone, "video_id") if "tracks" in out else None
    for name in ("segments", "events"):
        if name in out:
            lost_targets.append(without(name, gone, "video_id"))
    if "entities" in out:
        entities = without("entities", gone, "video_id")
        if "entity_mentions" in out:
            without("entity_mentions", entities, "entity_id")
    if tracks is not None:
        if "transcript_spans" in out:
            lost_targets.append(without("transcript_spans", tracks, "track_id"))
        if "frame_samples" in out:
            frames = without("frame_samples", tracks, "track_id")
            lost_targets.append(frames)
            if "ocr_spans" in out:
                lost_targets.append(without("ocr_spans", frames, "frame_sample_id"))
    if lost_targets:
        targets = reduce(DataFrame.unionByName, lost_targets)
        if "descriptions" in out:
            targets = targets.unionByName(without("descriptions", targets, "target_id"))
        if "embeddings" in out:
            out["embeddings"] = out["embeddings"].join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti").select(*out["embeddings"].columns)
    return out


def evidence(transcripts: DataFrame, tracks: DataFrame, ocr: DataFrame, frames: DataFrame, descriptions: DataFrame, segments: DataFrame, videos: DataFrame) -> DataFrame:
    """All searchable rows with the video and time that each belongs to: kind, id, video_id, t0, t1, text.

    Written once when tables change, so that queries need no joins. A description
    belongs to its segment's video or its frame's; one whose target is gone vanishes.
    """
    of_track = tracks.select(F.col("id").alias("track_id"), "video_id")
    known = videos.select(F.col("id").alias("video_id"))
    spans = transcripts.join(of_track, "track_id").select(F.lit("transcript").alias("kind"), "id", "video_id", F.col("t0_secs").alias("t0"), F.col("t1_secs").alias("t1"), "text")
    on_frame = frames.join(of_track, "track_id").select(F.col("id").alias("frame_id"), "video_id", F.col("t_secs").alias("t"))
    lines = ocr.join(on_frame, F.col("frame_sample_id") == F.col("frame_id")).select(F.lit("ocr").alias("kind"), "id", "video_id", F.col("t_secs").alias("t0"), F.col("t_secs").alias("t1"), "text")
    seg = segments.select(F.col("id").alias("seg_id"), F.col("video_id").alias("seg_video"), "t0_secs", "t1_secs")
    d = descriptions.join(seg, (F.col("target_kind") == "segment") & (F.col("target_id") == F.col("seg_id")), "left")
    d = d.join(on_frame, (F.col("target_kind") == "frame") & (F.col("target_id") == F.col("frame_id")), "left")
    d = d.select(F.lit("description").alias("kind"), "id", F.coalesce("seg_video", "video_id").alias("video_id"), F.coalesce("t0_secs", "t").alias("t0"), F.coalesce("t1_secs", "t").alias("t1"), "text")
    return spans.unionByName(lines).unionByName(d).join(known, "video_id", "left_semi").select(*EVIDENCE)


def in_time(t: Column, window: tuple[float, float] | None) -> Column:
    """Half-open bound on a start time; none bounds nothing."""
    return F.lit(True) if window is None else (t >= window[0]) & (t < window[1])


def selected(rows: DataFrame, videos: list[str] | None = None, kinds: list[str] | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """Evidence rows of some videos and kinds that start in a window; an empty list means all."""
    if videos:
        rows = rows.where(F.col("video_id").isin(*videos))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    return rows.where(in_time(F.col("t0"), window))


def bounded(rows: DataFrame, limits: DataFrame, t0: str = "t0", t1: str | None = None) -> DataFrame:
    """Rows as of each video's own limit: those that start before it, ends clipped to it.

    ``limits`` is video_id, until; a video without one is not bounded. Each video
    has its own limit, also where several live ones are asked together.
    """
    out = rows.join(limits.select("video_id", F.col("until").alias("__until")), "video_id", "left")
    out = out.where(F.col("__until").isNull() | (F.col(t0) < F.col("__until")))
    if t1:
        out = out.withColumn(t1, F.least(F.col(t1), F.col("__until")))
    return out.drop("__until").select(*rows.columns)


def limits(videos: DataFrame, until: float | None = None) -> DataFrame:
    """What is known of each video: ``until`` if asked, else its watermark, else its duration."""
    return videos.select(F.col("id").alias("video_id"), F.coalesce(F.lit(until).cast("double"), F.col("watermark_secs"), F.col("duration_secs")).alias("until"))


def ranked_once(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
