"""Readers of sidecars: subtitles, info files, media files and their pairing. Cues are cut in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_markup

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"
_ARROW = rf"{_TIME}\s*-->\s*{_TIME}"

INFO = "title string, channel string, uploader string, upload_date string, timestamp long, description string, duration double, chapters array<struct<start_time: double, end_time: double, title: string>>"


def _secs(line: Column, at: int) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, _ARROW, at + i), F.lit("")).cast("double"), F.lit(0.0))
    return part(0) * 3600 + part(1) * 60 + part(2) + F.rpad(F.regexp_extract(line, _ARROW, at + 3), 3, "0").cast("double") / 1000


def cues(files: DataFrame, text: str = "value") -> DataFrame:
    """Cues of SRT or WebVTT texts: the other columns, then n, t0, t1, text.

    Byte-order marks and carriage returns go; blocks are split by blank lines; header,
    note, style and region blocks, empty cues and those that don't end after they start are dropped.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    rest = [c for c in files.columns if c != text]
    blocks = files.select(*rest, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("n", "block"))
    blocks = blocks.where(~F.trim("block").rlike(r"^(WEBVTT|NOTE|STYLE|REGION)"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    arrow = F.filter(lines, lambda x: x.rlike(_ARROW))
    body = F.slice(lines, F.array_position(lines, F.get(arrow, F.lit(0))).cast("int") + 1, F.size(lines))
    out = blocks.where(F.size(arrow) > 0).withColumn("__a", F.get(arrow, F.lit(0))).withColumn("text", strip_markup(F.array_join(body, " ")))
    out = out.withColumn("t0", _secs(F.col("__a"), 1)).withColumn("t1", _secs(F.col("__a"), 5))
    return out.where((F.col("text") != "") & (F.col("t1") > F.col("t0"))).select(*rest, "n", "t0", "t1", "text")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all .srt and .vtt files under a path: path, stem, lang, n, t0, t1, text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{srt,vtt}").withColumn("path", F.input_file_name())
    return cues(with_sidecar_name(files))


def with_sidecar_name(files: DataFrame) -> DataFrame:
    """Rows with a ``path`` of the form stem[.lang].ext, and stem and lang; names of more parts are dropped."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = F.split(name, r"\.")
    return files.where(F.size(part).isin(2, 3)).withColumn("stem", part[0]).withColumn("lang", F.when(F.size(part) == 3, part[1]))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Info files: title, channel, published (from the day, else the epoch), duration, chapters that end after they start."""
    raw = spark.read.schema(INFO).json(path, multiLine=True, recursiveFileLookup=True)
    return info(raw)


def info(raw: DataFrame, *keys: str) -> DataFrame:
    """The columns ``keys``, then what is read of a file; chapters that don't end after they start are dropped."""
    day = F.try_to_timestamp("upload_date", F.lit("yyyyMMdd"))
    good = F.filter("chapters", lambda c: c["end_time"] > c["start_time"])
    return raw.select(*keys, "title", F.coalesce("channel", "uploader").alias("channel"), F.coalesce(day, F.timestamp_seconds("timestamp")).alias("published_at"), "description", F.col("duration").alias("duration_secs"), good.alias("chapters"))


def imported_chapters(infos: DataFrame, by: str) -> DataFrame:
    """A row per chapter: by, n, t0, t1, title."""
    c = infos.select(by, F.posexplode("chapters").alias("n", "c"))
    return c.select(by, "n", F.col("c.start_time").alias("t0"), F.col("c.end_time").alias("t1"), F.col("c.title").alias("title"))


def read_media(spark: SparkSession, path: str, pattern: str = "*.{mp4,mkv,webm,mov,avi,m4v}") -> DataFrame:
    """Media files under a path, known by their content: path, length, content_hash. Schemes are those of the Hadoop file systems at hand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"))


def blob_key(content: Column) -> Column:
    """Where content lies: ab/cd/<hash>."""
    h = F.sha2(content, 256)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def write_blobs(rows: DataFrame, content: str, path: str) -> None:
    """Contents once each under their hash."""
    rows.select(F.sha2(F.col(content), 256).alias("hash"), F.col(content).alias("content")).where("content is not null").dropDuplicates(["hash"]).write.mode("append").parquet(path)


def dispatched(source: Column) -> Column:
    """``dispatch`` of a column."""
    low = F.lower(source)
    site = F.when(low.rlike(r"youtube\.com/|youtu\.be/|vimeo\.com/"), "video_site").otherwise("http")
    return F.when(low.rlike(r"^(s3a?|gs|az|abfss?|r2)://"), "object_store").when(low.rlike("^https?://"), site).otherwise("local_file")


def expanded(spark: SparkSession, source: str, pattern: str = "*.{mp4,mkv,webm,mov,avi,m4v}") -> DataFrame:
    """path, length, modified of the media files that a source holds: the file itself, or all under a folder or an object prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def dispatch(source: str) -> str:
    """Which reader takes a source."""
    low = source.lower()
    if low.split("://")[0] in ("s3", "s3a", "gs", "az", "abfs", "abfss", "r2") and "://" in low:
        return "object_store"
    if low.startswith(("http://", "https://")):
        return "video_site" if any(h in low for h in ("youtube.com/", "youtu.be/", "vimeo.com/")) else "http"
    return "local_file"
