"""ROI masks: (y, x) sets, traces over them, boolean and morphological changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.schemas import frame_keys, movie_keys, val
from pixelweave.session import attach



def in_rectangle(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Half-open: x0 <= x < x1, y0 <= y < y1."""
    return (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)


def in_ellipse(cx: float, cy: float, rx: float, ry: float) -> Column:
    if rx < 0.5 or ry < 0.5:
        return F.lit(False)
    dx, dy = (F.col("x") - cx) / rx, (F.col("y") - cy) / ry
    return dx * dx + dy * dy < 1


def on_line(x0: int, y0: int, x1: int, y1: int) -> Column:
    """Pixels of the rasterised segment: one per step of the longer axis."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    sx, sy = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1)
    ix, iy = (F.col("x") - x0) * sx, (F.col("y") - y0) * sy
    if dx == 0 and dy == 0:
        return (F.col("x") == x0) & (F.col("y") == y0)
    if dx >= dy:
        return ix.between(0, dx) & (iy == F.floor((2 * dy * ix + dx) / (2 * dx)))
    return iy.between(0, dy) & (ix == F.floor((2 * dx * iy + dy) / (2 * dy)))


def at_point(x: int, y: int) -> Column:
    return (F.col("x") == x) & (F.col("y") == y)


def in_polygon(points: list[tuple[float, float]]) -> Column:
    """Ray-crossing parity against a fixed vertex list."""
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
        if ya == yb:
            continue
        lo, hi = min(ya, yb), max(ya, yb)
        at = xa + (F.col("y") - ya) * ((xb - xa) / (yb - ya))
        crossings = crossings + ((F.col("y") >= lo) & (F.col("y") < hi) & (F.col("x") < at)).cast("int")
    return crossings % 2 == 1


def polygon_mask(pixels: DataFrame, vertices: DataFrame) -> DataFrame:
    """(roi_id, y, x) inside polygons held as a vertex table (roi_id, pos, x, y).

    Edges are spread over the pixel rows they cross, so the join is on y.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("roi_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.select("roi_id", F.col("x").alias("xa"), F.col("y").alias("ya"),
                            F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("xb"),
                            F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("yb")).where("ya <> yb")
    lo, hi = F.least("ya", "yb"), F.greatest("ya", "yb")
    rows = (edges.withColumn("y", F.explode(F.sequence(F.ceil(lo).cast("int"), F.ceil(hi).cast("int"))))
            .where(F.col("y") < hi)
            .select("roi_id", "y", (F.col("xa") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))).alias("cross")))
    grid = pixels.select("y", "x").distinct()
    hits = grid.join(rows, "y").where(F.col("x") < F.col("cross"))
    return hits.groupBy("roi_id", "y", "x").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select("roi_id", "y", "x")


def mask_from(pixels: DataFrame, inside: Column, roi_id: str = "roi", zone: str = "in") -> DataFrame:
    """Mask table of the pixel grid of a stack that satisfies a predicate."""
    return (pixels.where(inside).select("y", "x").distinct()
            .select(F.lit(roi_id).alias("roi_id"), F.lit(zone).alias("zone"), "y", "x"))


def center_surround_mask(pixels: DataFrame, center: Column, surround: Column, roi_id: str = "roi") -> DataFrame:
    return mask_from(pixels, center, roi_id, "center").unionByName(mask_from(pixels, surround & ~center, roi_id, "surround"))


# -- traces -----------------------------------------------------------------

def roi_trace(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean of the mask pixels per frame; an empty mask gives zeros."""
    if mask.isEmpty():
        return df.select(*frame_keys(df)).distinct().withColumn("value", F.lit(0.0))
    inside = attach(df, mask.select("roi_id", "y", "x"), ["y", "x"], "inner")
    return inside.groupBy(*movie_keys(df), "roi_id", "frame").agg(F.avg("value").alias("value"))


def point_trace(df: DataFrame, x: int, y: int) -> DataFrame:
    return df.where(at_point(x, y)).select(*frame_keys(df), "value").orderBy(*frame_keys(df))


def center_surround_trace(df: DataFrame, mask: DataFrame) -> DataFrame:
    zones = attach(df, mask.select("zone", "y", "x"), ["y", "x"], "inner")
    return zones.groupBy(*frame_keys(df)).agg(
        (F.avg(F.when(F.col("zone") == "center", val())) - F.avg(F.when(F.col("zone") == "surround", val()))).alias("value"))


def sample_points(spark: SparkSession, points: list[tuple[float, float]], width: int = 1) -> DataFrame:
    """Unit-spaced samples along a poly-line and across its width.

    Rows (pos, off, sx, sy); ``points`` are literal (x, y) vertices.
    """
    import math

    out, pos = [], 0
    for (xa, ya), (xb, yb) in zip(points, points[1:]):
        length = math.hypot(xb - xa, yb - ya)
        n = max(int(round(length)), 1)
        ux, uy = (xb - xa) / max(length, 1e-12), (yb - ya) / max(length, 1e-12)
        for i in range(n + 1):
            for k in range(width):
                off = k - (width - 1) / 2
                out.append((pos, float(off), xa + ux * i * length / n - uy * off, ya + uy * i * length / n + ux * off))
            pos += 1
    return spark.createDataFrame(out, "pos int, off double, sx double, sy double")


def sample_values(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Bilinear value of every sample point in every frame (0 outside)."""
    corners = samples.select("*", F.inline(F.array(*[F.struct(
        (F.floor("sy") + dy).cast("int").alias("y"), (F.floor("sx") + dx).cast("int").alias("x"),
        ((F.lit(1.0) - F.abs(F.col("sy") - (F.floor("sy") + dy))) * (F.lit(1.0) - F.abs(F.col("sx") - (F.floor("sx") + dx)))).alias("wt"))
        for dy in (0, 1) for dx in (0, 1)]))).where("wt > 0")
    hit = attach(df, corners, ["y", "x"], "inner")
    return hit.groupBy(*frame_keys(df), "pos", "off").agg(F.sum(val() * F.col("wt")).alias("value"))


def band_trace(df: DataFrame, points: list[tuple[float, float]], width: int = 3) -> DataFrame:
    """Mean of a wide poly-line ROI per frame."""
    return sample_values(df, sample_points(df.sparkSession, points, width)).groupBy(*frame_keys(df)).agg(F.avg("value").alias("value"))


def roi_stats(df: DataFrame, mask: DataFrame) -> DataFrame:
    """mean, population std, min, max, area and integrated value per ROI and frame."""
    inside = attach(df, mask.select("roi_id", "y", "x"), ["y", "x"], "inner")
    return inside.groupBy(*movie_keys(df), "roi_id", "frame").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count(F.lit(1)).alias("area"), F.sum("value").alias("integrated"))


def roi_stats_z(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean per plane and over all planes (z null) of each frame."""
    inside = attach(df, mask.select("roi_id", "y", "x"), ["y", "x"], "inner")
    keys = [k for k in ("movie_id", "roi_id", "frame") if k in inside.columns]
    per_plane = inside.groupBy(*keys, "z").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("_n"))
    whole = per_plane.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("_n")) / F.sum("_n")).alias("mean"))
    return per_plane.select(*keys, "z", "mean").unionByName(whole.select(*keys, F.lit(None).cast("int").alias("z"), "mean"))


# -- mask algebra -----------------------------------------------------------

def roi_boolean(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    left, right = a.select("y", "x"), b.select("y", "x")
    if operation == "AND":
        return left.intersect(right)
    if operation == "OR":
        return left.union(right).distinct()
    if operation == "SUBTRACT":
        return left.exceptAll(right).distinct()
    if operation == "XOR":
        return left.distinct().exceptAll(right.distinct()).union(right.distinct().exceptAll(left.distinct()))
    raise ValueError(operation)


def _spread(mask: DataFrame, pixels: int) -> DataFrame:
    span = F.sequence(F.lit(-pixels), F.lit(pixels))
    return (mask.select("y", "x", F.explode(span).alias("_dy")).withColumn("_dx", F.explode(span))
            .select((F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")))


def roi_transform(mask: DataFrame, operation: str, pixels: int, h: int, w: int) -> DataFrame:
    """Enlarge, shrink or band a mask with a (2 pixels + 1)^2 box inside an h x w image."""
    base = mask.select("y", "x").distinct()
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    grown = _spread(base, pixels).where(inside).distinct()
    if operation == "enlarge":
        return grown
    if operation == "band":
        return grown.exceptAll(base)
    if operation == "shrink":
        k = (2 * pixels + 1) ** 2
        return _spread(base, pixels).groupBy("y", "x").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select("y", "x")
    raise ValueError(operation)


def union_masks(masks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), masks)
