"""Table shapes.

``pixels``  movie_id, frame, y, x, value, and h, w: the frame size travels with
            the pixel, so edge handling needs neither a join nor a scan of the
            extent. c (channel) and z (plane) are optional extra keys.
``masks``   roi_id, zone, y, x.
``traces``  trace_id, t, value.
``locs``    id, frame, x, y, intensity and optional fit columns; track_id = -1
            when unlinked; movie_id optional.
``boxes``   image_id, id, x, y, width, height, class_name, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("frame", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("intensity", T.DoubleType()),
    T.StructField("sigma_x", T.DoubleType()),
    T.StructField("sigma_y", T.DoubleType()),
    T.StructField("background", T.DoubleType()),
    T.StructField("uncertainty", T.DoubleType()),
    T.StructField("track_id", T.LongType()),
])

PIXELS = T.StructType([
    T.StructField("movie_id", T.StringType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("h", T.IntegerType()),
    T.StructField("w", T.IntegerType()),
])

_PLANE = ("movie_id", "c", "z")


def movie_keys(df: DataFrame) -> list[str]:
    """Keys of one stack: movie, and channel and plane where present."""
    return [k for k in _PLANE if k in df.columns]


def frame_keys(df: DataFrame) -> list[str]:
    return [*movie_keys(df), "frame"]


def pixel_keys(df: DataFrame) -> list[str]:
    """Keys of one pixel's time series."""
    return [*movie_keys(df), "y", "x"]


def track_keys(df: DataFrame) -> list[str]:
    return [k for k in ("movie_id", "track_id") if k in df.columns]


def val() -> Column:
    """The pixel or trace value."""
    return F.col("value")
