"""Vectors as the search operators read them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>): vectors without null or non-finite components, on request without zero vectors.

    Rows without an id take no part. Rows that repeat an id count once, with the
    least vector.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(~bad)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column, width: int, kind=np.float64) -> np.ndarray:
    """The vectors of a column as rows; shorter ones count as followed by zeros."""
    out = np.zeros((len(column), width), kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def width_of(*columns) -> int:
    return max((len(v) for c in columns for v in c), default=0)
