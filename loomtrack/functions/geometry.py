"""Box, time and island helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRACK = ("session_id", "source_id", "stream_epoch", "local_track_id")
FRAME = ("session_id", "source_id", "stream_epoch", "frame_index")


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with prefixes ``a`` and ``b``; each area is at least 1."""
    c = F.col
    width = F.greatest(F.lit(0.0), F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1")))
    height = F.greatest(F.lit(0.0), F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1")))
    area = lambda p: F.greatest(F.lit(1.0), (c(f"{p}x2") - c(f"{p}x1")) * (c(f"{p}y2") - c(f"{p}y1")))
    return width * height / (area(a) + area(b) - width * height + F.lit(1e-6))


def centre_x() -> Column:
    return (F.col("x1") + F.col("x2")) / 2


def centre_y() -> Column:
    return (F.col("y1") + F.col("y2")) / 2


def track_window(*order: str) -> Window:
    return Window.partitionBy(*TRACK).orderBy(*(order or ("frame_index",)))


def half_even(value: Column) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(value, 0).cast("long")
