"""Super-resolution renderings: every localization adds to a bounded set of
pixels and the sums combine before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["iy", "ix"]


def _inside(df: DataFrame, height: int, width: int) -> DataFrame:
    return df.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1))


def _weight(weighted: bool):
    return F.col("intensity") if weighted else F.lit(1.0)


def render_histogram(df: DataFrame, pixel_size: float, height: int, width: int, weighted: bool = True) -> DataFrame:
    at = df.select(F.floor(F.col("y") / pixel_size).cast("int").alias("iy"), F.floor(F.col("x") / pixel_size).cast("int").alias("ix"),
                   _weight(weighted).alias("_v"))
    return _inside(at, height, width).groupBy(*KEYS).agg(F.sum("_v").alias("value"))


def render_scatter(df: DataFrame, pixel_size: float, height: int, width: int) -> DataFrame:
    at = df.select(F.floor(F.col("y") / pixel_size).cast("int").alias("iy"), F.floor(F.col("x") / pixel_size).cast("int").alias("ix"))
    return _inside(at, height, width).distinct().withColumn("value", F.lit(1.0))


def render_ash(df: DataFrame, pixel_size: float, height: int, width: int, magnification: int = 2, weighted: bool = True) -> DataFrame:
    """Average of m x m shifted histograms.

    A shift below one pixel lands in the own or the next pixel, so a
    localization contributes at most four rows whatever m is.
    """
    m = max(int(magnification), 1)

    def shares(axis: str):
        low = F.floor(F.col(axis) / pixel_size)
        over = sum((F.floor((F.col(axis) + s * pixel_size / m) / pixel_size) > low).cast("int") for s in range(1, m)) if m > 1 else F.lit(0)
        return F.filter(F.array(F.struct(low.cast("int").alias("p"), (F.lit(m) - over).alias("n")),
                                F.struct((low + 1).cast("int").alias("p"), (F.lit(0) + over).alias("n"))), lambda e: e["n"] > 0)

    rows = df.select(_weight(weighted).alias("_v"), F.explode(shares("y")).alias("_y"), shares("x").alias("_xs"))
    rows = rows.select("_v", "_y", F.explode("_xs").alias("_x"))
    at = rows.select(F.col("_y.p").alias("iy"), F.col("_x.p").alias("ix"), (F.col("_v") * F.col("_y.n") * F.col("_x.n")).alias("_w"))
    return _inside(at, height, width).groupBy(*KEYS).agg((F.sum("_w") / (m * m)).alias("value"))


def render_gaussian(df: DataFrame, pixel_size: float, height: int, width: int, sigma: float | None = None,
                    sigma_column: str | None = None, normalize_peak: bool = False) -> DataFrame:
    """Gaussian splat per localization with the common radius ceil(3 sigma) + 1 of
    the widest one; peak-normalised splats ignore the intensity."""
    widest = (sigma or pixel_size) / pixel_size
    s = F.lit(float(widest))
    if sigma_column:
        top = df.agg(F.max(sigma_column)).first()[0]
        widest = max(widest, (top or 0.0) / pixel_size)
        s = F.col(sigma_column) / pixel_size
    r = int(math.ceil(3.0 * widest)) + 1
    s = F.greatest(s, F.lit(0.1))
    cx, cy = F.col("x") / pixel_size, F.col("y") / pixel_size

    def span(c, size):
        mid = c.cast("int")
        lo, hi = F.greatest(mid - r, F.lit(0)), F.least(mid + r, F.lit(size - 1))
        return F.when(lo <= hi, F.sequence(lo, hi))

    rows = df.select(cx.alias("_cx"), cy.alias("_cy"), s.alias("_s"), "intensity", F.explode(span(cy, height)).alias("iy"), span(cx, width).alias("_xs"))
    rows = rows.select("*", F.explode("_xs").alias("ix"))
    dx, dy = F.col("ix") - F.col("_cx"), F.col("iy") - F.col("_cy")
    g = F.exp(-(dx * dx + dy * dy) / (2 * F.col("_s") * F.col("_s")))
    if not normalize_peak:
        g = F.col("intensity") * g / (2 * math.pi * F.col("_s") * F.col("_s"))
    return rows.groupBy(*KEYS).agg(F.sum(g).alias("value"))


def render(df: DataFrame, method: str, pixel_size: float, height: int, width: int, **options) -> DataFrame:
    table = {"histogram": render_histogram, "scatter": render_scatter, "ash": render_ash, "gaussian": render_gaussian,
             "normalized_gaussian": lambda *a, **k: render_gaussian(*a, normalize_peak=True, **k)}
    return table[method](df, pixel_size, height, width, **options)
