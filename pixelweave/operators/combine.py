"""Pixel-aligned combinations of two stacks, and per-frame scalars on pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.schemas import frame_keys, pixel_keys
from pixelweave.session import attach

_OPERATIONS = {
    "Add": lambda a, b: a + b,
    "Subtract": lambda a, b: a - b,
    "Multiply": lambda a, b: a * b,
    "Divide": lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)),
    "AND": lambda a, b: ((a != 0) & (b != 0)).cast("int"),
    "OR": lambda a, b: ((a != 0) | (b != 0)).cast("int"),
    "XOR": lambda a, b: ((a != 0) != (b != 0)).cast("int"),
    "Min": lambda a, b: F.least(a, b),
    "Max": lambda a, b: F.greatest(a, b),
    "Average": lambda a, b: (a + b) / 2,
}


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """v1, v2 of two stacks at the same pixel; a still (no frame column) repeats over frames.

    Both sides hash on the full pixel key, so no movie or frame is a hot key;
    frames missing from the shorter stack fall away.
    """
    if "frame" not in b.columns:
        return attach(a.withColumnRenamed("value", "v1"),
                      b.select(*pixel_keys(b), F.col("value").alias("v2")), pixel_keys(b), "inner")
    keys = [*frame_keys(a), "y", "x"]
    return a.withColumnRenamed("value", "v1").join(b.select(*keys, F.col("value").alias("v2")), keys)


def image_calculator(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    return pair(a, b).withColumn("value", _OPERATIONS[operation](F.col("v1"), F.col("v2"))).drop("v1", "v2")


def calculate_pair(wide: DataFrame, operation: str) -> DataFrame:
    """The same on a table that already holds v1 and v2."""
    return wide.withColumn("value", _OPERATIONS[operation](F.col("v1"), F.col("v2"))).drop("v1", "v2")


def logically_combine(a: DataFrame, b: DataFrame, operator: str) -> DataFrame:
    if operator not in ("AND", "OR", "XOR"):
        raise ValueError(operator)
    return image_calculator(a, b, operator)


def subtract_trace(df: DataFrame, trace: DataFrame) -> DataFrame:
    return _with_trace(df, trace).withColumn("value", F.col("value") - F.col("_t")).drop("_t")


def divide_trace(df: DataFrame, trace: DataFrame) -> DataFrame:
    return _with_trace(df, trace).withColumn("value", F.try_divide("value", "_t")).drop("_t")


def _with_trace(df: DataFrame, trace: DataFrame) -> DataFrame:
    """Per-frame scalar on every pixel; a trace of another length is rejected."""
    keys = [k for k in frame_keys(df) if k in trace.columns]
    frames = df.select(*keys).distinct()
    if frames.join(trace, keys, "left_anti").limit(1).count():
        raise ValueError("the trace does not cover every frame")
    return attach(df, trace.select(*keys, F.col("value").alias("_t")), keys, "inner")
