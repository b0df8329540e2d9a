"""What a request to look at a video may ask for: windows, frames a second and regions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SECS, MOST_FRAMES = 120.0, 16
LEAST_SIDE, MOST_SIDE, LEAST_CROP = 1024, 1600, 64


def _within(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def window(t0: Column, t1: Column, fps: Column, frames: Column, duration: Column) -> Column:
    """(t0, t1, fps, frames): inside the video, half a second at least and ``MOST_SECS`` at most, fps lowered until the frames fit."""
    n = _within(frames, F.lit(1), F.lit(MOST_FRAMES))
    a = _within(t0, F.lit(0.0), F.greatest(duration, F.lit(0.0)))
    z = F.least(_within(t1, a + 0.5, F.greatest(duration, a + 0.5)), a + MOST_SECS)
    rate = F.when(F.isnan(fps) | (fps <= 0) | fps.isNull(), F.lit(1.0)).otherwise(fps)
    return F.struct(a.alias("t0"), z.alias("t1"), F.least(rate, n / (z - a)).alias("fps"), n.cast("int").alias("frames"))


def region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A region in fractions of a frame, inside it and of some size."""

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def at(v: Column) -> Column:
        return F.when(finite(v), _within(v, F.lit(0.0), F.lit(0.999))).otherwise(F.lit(0.0))

    def size(v: Column, since: Column) -> Column:
        return F.when(finite(v) & (v > 0), F.least(v, 1 - since)).otherwise(1 - since)

    return F.struct(at(x).alias("x"), at(y).alias("y"), size(w, at(x)).alias("w"), size(h, at(y)).alias("h"))


def pixels(of: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) in pixels of a ``region``; less than ``LEAST_CROP`` a side is widened around its centre, inside the frame."""

    def axis(since: Column, size: Column, whole: Column) -> tuple[Column, Column]:
        a, z = since * whole, (since + size) * whole
        # around the centre, as (a + z) / 2: a side taken off each end would round to another pixel
        small, centre = z - a < LEAST_CROP, (a + z) / 2
        a, z = F.when(small, centre - LEAST_CROP / 2).otherwise(a), F.when(small, centre + LEAST_CROP / 2).otherwise(z)
        a, z = F.greatest(a, F.lit(0.0)), z - F.least(a, F.lit(0.0))
        a, z = F.greatest(a - F.greatest(z - whole, F.lit(0.0)), F.lit(0.0)), F.least(z, whole)
        start = F.floor(a)
        return start, F.greatest(F.least(F.ceil(z), whole.cast("long")) - start, F.lit(1))

    (x, w), (y, h) = axis(of["x"], of["w"], width.cast("double")), axis(of["y"], of["h"], height.cast("double"))
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def zoom_side(longest: Column) -> Column:
    """The longest side that a crop is scaled to."""
    return _within(longest, F.lit(LEAST_SIDE), F.lit(MOST_SIDE))
