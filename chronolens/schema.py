"""Schemas of the catalog's tables, enumerations and the manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3

TABLES: dict[str, str] = {
    "videos": "id string, source_uri string, content_hash string, title string, description string, channel string, published_at timestamp, duration_num long, duration_den int, duration_secs double, start_wallclock timestamp, probe string, index_state string, created_at timestamp, watermark_secs double, live_ended_at timestamp",
    "tracks": "id string, video_id string, kind string, stream_index int, codec string, timebase_num int, timebase_den int, width int, height int, fps double, sample_rate int, channels int, language string",
    "provenance": "id string, operator string, operator_version int, provider string, model string, model_version string, prompt_hash string, params string, created_at timestamp, cost_usd double, tokens_in long, tokens_out long, latency_ms long",
    "segments": "id string, video_id string, level string, parent_id string, t0_secs double, t1_secs double, keyframe_sample_id string, title string, summary string, provenance_id string",
    "frame_samples": "id string, track_id string, t_secs double, pts long, is_keyframe boolean, phash long, thumbnail_blob string, width int, height int",
    "transcript_spans": "id string, track_id string, t0_secs double, t1_secs double, text string, speaker string, language string, confidence float, words array<struct<w: string, s: double, e: double, p: double>>, provenance_id string",
    "ocr_spans": "id string, frame_sample_id string, t_secs double, text string, bbox struct<x: float, y: float, w: float, h: float>, confidence float, provenance_id string",
    "descriptions": "id string, target_kind string, target_id string, kind string, text string, structured string, provenance_id string",
    "entities": "id string, video_id string, kind string, name string, canonical_name string, attributes string",
    "entity_mentions": "entity_id string, t0_secs double, t1_secs double, source_kind string, source_id string, confidence float",
    "events": "id string, video_id string, t0_secs double, t1_secs double, text string, participants array<string>, provenance_id string",
    "embeddings": "id string, target_kind string, target_id string, model string, dim int, vector array<float>, provenance_id string",
    "sessions": "id string, created_at timestamp, expires_at timestamp, state string",
}

#: What holds one embedding, and what names a row of the other tables.
KEYS: dict[str, list[str]] = {t: ["id"] for t in TABLES} | {"embeddings": ["target_kind", "target_id", "model"], "entity_mentions": ["entity_id", "source_kind", "source_id"]}

ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("videos", "index_state"): ("acquired", "live", "coarse", "fine", "failed"),
    ("tracks", "kind"): ("video", "audio", "subtitle"),
    ("segments", "level"): ("shot", "scene", "chapter"),
    ("descriptions", "target_kind"): ("segment", "frame"),
}

#: The rank of index states when the least advanced one is reported.
STATE_RANK = {"failed": 0, "acquired": 1, "coarse": 2, "live": 2, "fine": 3}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def violations(df: DataFrame, table: str) -> Column:
    """True for rows with a value outside an enumeration of ``table``."""
    bad = F.lit(False)
    for (t, c), allowed in ENUMS.items():
        if t == table and c in df.columns:
            bad = bad | ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return bad


def manifest(version: int = VERSION) -> str:
    return json.dumps({"schema_version": version})


def readable(text: str) -> int:
    """The version of a manifest; newer than this library is refused."""
    version = int(json.loads(text)["schema_version"])
    if version > VERSION:
        raise ValueError(f"schema {version} is newer than {VERSION}")
    return version
