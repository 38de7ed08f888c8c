"""Per-pixel projections, predicates and frame bookkeeping.

Narrow transforms only: none of these shuffles except where a statistic of the
whole movie is the definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import columns as fn
from pixelweave.operators.blocks import exact_quantiles
from pixelweave.schemas import frame_keys, movie_keys, val
from pixelweave.session import attach



def map_value(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("value", f(F.col("value")))


def subtract(df: DataFrame, value: float) -> DataFrame:
    return map_value(df, lambda v: v - value)


def multiply(df: DataFrame, value: float) -> DataFrame:
    return map_value(df, lambda v: v * value)


def divide(df: DataFrame, value: float) -> DataFrame:
    """True division; dividing by zero gives null."""
    return map_value(df, lambda v: F.try_divide(v, F.lit(float(value))))


def power(df: DataFrame, exponent: float) -> DataFrame:
    return map_value(df, lambda v: F.pow(v, F.lit(float(exponent))))


def sqrt(df: DataFrame) -> DataFrame:
    return map_value(df, lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))


def absolute_value(df: DataFrame) -> DataFrame:
    return map_value(df, F.abs)


_WRAP = {"uint8": 8, "uint16": 16, "uint32": 32, "int8": 8, "int16": 16, "int32": 32}


def change_datatype(df: DataFrame, datatype: str) -> DataFrame:
    """Cast as an array cast does: truncate towards zero, wrap modulo 2^bits.

    Unsigned kinds land in the next wider signed type.
    """
    if datatype in ("float16", "float32"):
        return map_value(df, lambda v: v.cast("float"))
    if datatype == "float64":
        return map_value(df, lambda v: v.cast("double"))
    if datatype in ("int64", "uint64"):
        return map_value(df, lambda v: v.cast("long"))
    size = 1 << _WRAP[datatype]
    target = {"uint8": "short", "uint16": "int", "uint32": "long", "int8": "byte", "int16": "short", "int32": "int"}[datatype]
    whole = F.pmod(val().cast("long"), F.lit(size))
    if not datatype.startswith("u"):
        whole = F.when(whole >= size // 2, whole - size).otherwise(whole)
    return df.withColumn("value", whole.cast(target))


def convert_uint8(df: DataFrame) -> DataFrame:
    """(v - min) * 255 / (max - min) of each movie, truncated."""
    keys = movie_keys(df)
    ext = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = F.floor((val() - F.col("_lo")) * 255 / (F.col("_hi") - F.col("_lo"))).cast("short")
    return attach(df, ext, keys).withColumn("value", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.lit(0).cast("short"))).drop("_lo", "_hi")


def set_value(df: DataFrame, value: float, first: int, last: int, mask: DataFrame | None = None,
              outside: bool = False) -> DataFrame:
    """Overwrite frames first..last, everywhere or in / outside a (y, x) mask."""
    hit = F.col("frame").between(first, last)
    if mask is not None:
        df = attach(df, mask.select("y", "x").distinct().withColumn("_in", F.lit(True)), ["y", "x"])
        inside = F.coalesce(F.col("_in"), F.lit(False))
        hit = hit & (~inside if outside else inside)
    return df.withColumn("value", F.when(hit, F.lit(float(value))).otherwise(val())).drop("_in")


def threshold(df: DataFrame, value: float, dark_background: bool = False) -> DataFrame:
    return map_value(df, lambda v: ((v < value) if dark_background else (v > value)).cast("int"))


def trim(df: DataFrame, first: int, last: int, increment: int = 1, delete: bool = False) -> DataFrame:
    """Keep every increment-th frame of first..last (inclusive), or delete that set.

    The new frame number is arithmetic, so nothing is sorted or shuffled.
    """
    f = F.col("frame")
    chosen = f.between(first, last) & ((f - first) % increment == 0)
    if not delete:
        return df.where(chosen).withColumn("frame", F.floor((f - first) / increment).cast("int"))
    gone = F.greatest(F.floor((F.least(f - 1, F.lit(last)) - first) / increment) + 1, F.lit(0))
    return df.where(~chosen).withColumn("frame", (f - gone).cast("int"))


def frame_remover(df: DataFrame, start: int, end: int, interval: int, length: int) -> DataFrame:
    """Drop ``length`` frames from every ``interval``-th frame of start..end and close the gaps."""
    f = F.col("frame")
    blocks = (end - start) // interval + 1
    span = min(length, interval)
    tail_end = start + (blocks - 1) * interval + length
    offset = f - start
    inside = (f >= start) & (f < tail_end) & (
        (offset % interval < span) | (f >= start + (blocks - 1) * interval))
    at = F.least(F.greatest(f, F.lit(start)), F.lit(tail_end)) - start
    full = F.least(F.floor(at / interval), F.lit(blocks - 1))
    removed = full * span + F.least(at - full * interval, F.lit(length))
    removed = F.when(full < blocks - 1, full * span + F.least(at - full * interval, F.lit(span))).otherwise(removed)
    return df.where(~inside).withColumn("frame", (f - removed).cast("int"))


def deinterleave(df: DataFrame, n_channels: int) -> DataFrame:
    return (df.withColumn("c", (F.col("frame") % n_channels).cast("int"))
            .withColumn("frame", F.floor(F.col("frame") / n_channels).cast("int")))


def split_channels(df: DataFrame) -> dict[int, DataFrame]:
    """One stack per colour channel 0..2 (a fourth channel, if any, is index 3)."""
    return {i: df.where(F.col("c") == i).drop("c") for i in range(4)}


def split_channel(df: DataFrame, channel: int) -> DataFrame:
    return df.where(F.col("c") == channel).drop("c")


def channels_wide(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Channel rows to columns: one scan and one shuffle instead of a self-join."""
    keys = [k for k in ("movie_id", "z", "frame", "y", "x") if k in df.columns]
    carry = [F.first(k).alias(k) for k in ("h", "w") if k in df.columns]
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == i, val())).alias(n) for i, n in names.items()], *carry)
    return wide.where(" and ".join(f"{n} is not null" for n in names.values()))


def grayscale(df: DataFrame, method: str = "Luminance") -> DataFrame:
    """RGB channel rows (c = 0, 1, 2) to one gray value per pixel."""
    wide = channels_wide(df, {0: "_r", 1: "_g", 2: "_b"})
    return wide.withColumn("value", fn.grayscale(F.col("_r"), F.col("_g"), F.col("_b"), method)).drop("_r", "_g", "_b")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to 0..1 over their movie; a flat column is left alone."""
    keys = [k for k in ("movie_id", "z") if k in df.columns]
    ext = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = attach(df, ext, keys)
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def blend_channels(wide: DataFrame, a: str = "v1", b: str = "v2", alpha: float = 0.5) -> DataFrame:
    """Green/magenta composite of two min-max scaled channels.

    The blend mode of the original has no effect on its output, so there is none here.
    """
    s = min_max(wide, [a, b])
    green, magenta = alpha * F.col(a), (1 - alpha) * F.col(b)

    def clip(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    return s.withColumns({"red": clip(magenta), "green": clip(green), "blue": clip(magenta)}).drop(a, b)


def convert_color_space(df: DataFrame, conversion: str) -> DataFrame:
    """RGB channel rows to HSV, YCrCb or LAB columns after min-max scaling, or HSV to RGB."""
    wide = channels_wide(df, {0: "_0", 1: "_1", 2: "_2"})
    scaled = min_max(wide.withColumn("_all", F.lit(0)), ["_0", "_1", "_2"]).drop("_all")
    make = {"RGB to HSV": fn.rgb_to_hsv, "HSV to RGB": fn.hsv_to_rgb,
            "RGB to YCrCb": fn.rgb_to_ycbcr, "RGB to LAB": fn.rgb_to_lab}[conversion]
    keep = [c for c in scaled.columns if c not in ("_0", "_1", "_2")]
    return scaled.select(*keep, *make(F.col("_0"), F.col("_1"), F.col("_2")))


def concatenate_stacks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of b after those of a, movie by movie."""
    keys = movie_keys(a)
    length = a.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    shifted = attach(b, length, keys).withColumn(
        "frame", (F.col("frame") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")
    return a.unionByName(shifted)


def normalize(df: DataFrame, method: str = "Min-Max (0-1)") -> DataFrame:
    """Min-Max, Z-Score or Percentile scaling of each movie; zero range gives zeros."""
    keys = movie_keys(df)
    clean = F.when(~F.isnan("value"), val())
    if method == "Percentile (1-99%)":
        stats = exact_quantiles(df, keys, "value", {"_a": 0.01, "_b": 0.99})
        out = attach(df, stats, keys)
        scaled = (val() - F.col("_a")) / (F.col("_b") - F.col("_a"))
        return out.withColumn("value", F.when(F.col("_b") > F.col("_a"), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
                              .otherwise(0.0)).drop("_a", "_b")
    if method == "Z-Score":
        stats = df.groupBy(*keys).agg(F.avg(clean).alias("_a"), F.stddev_pop(clean).alias("_b"))
        return attach(df, stats, keys).withColumn(
            "value", F.when(F.col("_b") > 0, (val() - F.col("_a")) / F.col("_b")).otherwise(0.0)).drop("_a", "_b")
    stats = df.groupBy(*keys).agg(F.min(clean).alias("_a"), F.max(clean).alias("_b"))
    return attach(df, stats, keys).withColumn(
        "value", F.when(F.col("_b") > F.col("_a"), (val() - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)).drop("_a", "_b")


def frame_time(df: DataFrame, dt: float) -> DataFrame:
    """Acquisition time of a frame."""
    return df.withColumn("time", F.col("frame") * F.lit(dt))


# -- stack geometry ---------------------------------------------------------

def frame_binning(df: DataFrame, n: int) -> DataFrame:
    keys = [k for k in df.columns if k not in ("frame", "value")]
    return df.groupBy(*keys, F.floor(F.col("frame") / n).cast("int").alias("frame")).agg(F.avg("value").alias("value"))


def pixel_binning(df: DataFrame) -> DataFrame:
    """2 x 2 means; incomplete blocks at an odd edge are dropped."""
    keys = frame_keys(df)
    geometry = [F.floor(F.col(k) / 2).cast("int").alias(k) for k in ("h", "w") if k in df.columns]
    rest = df.select(*keys, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), *geometry, "value")
    groups = [c for c in rest.columns if c != "value"]
    return (rest.groupBy(*groups).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
            .where("_n = 4").drop("_n"))


def zproject(df: DataFrame, first: int, last: int, kind: str = "Average") -> DataFrame:
    """Projection over frames first..last, both included."""
    agg = {"Average": F.avg("value"), "Max Intensity": F.max("value"), "Min Intensity": F.min("value"),
           "Sum Slices": F.sum("value"), "Standard Deviation": F.stddev_pop("value"),
           "Median": F.percentile("value", F.lit(0.5))}[kind]
    keys = [k for k in df.columns if k not in ("frame", "value")]
    return df.where(F.col("frame").between(first, last)).groupBy(*keys).agg(agg.alias("value"))


def zproject_all(df: DataFrame, first: int, last: int) -> DataFrame:
    """Every projection in one pass."""
    keys = [k for k in df.columns if k not in ("frame", "value")]
    return df.where(F.col("frame").between(first, last)).groupBy(*keys).agg(
        F.avg("value").alias("average"), F.max("value").alias("maximum"), F.min("value").alias("minimum"),
        F.sum("value").alias("total"), F.stddev_pop("value").alias("std"),
        F.percentile("value", F.lit(0.5)).alias("median"))


def resize(df: DataFrame, factor: int) -> DataFrame:
    """Integer up-scaling, bilinear, pixel-centre aligned, edges held.

    Each source pixel adds its weight to the at most (2 factor)^2 targets that
    use it, so the interpolation is one explode and one combinable sum.
    """
    def targets(axis: str, size: str) -> Column:
        # target t reads position p = (t + 0.5) / factor - 0.5 clamped to the image
        t = F.sequence(F.greatest(F.lit(0), (F.col(axis) - 1) * factor), F.least(F.col(size) * factor - 1, (F.col(axis) + 2) * factor - 1))
        return F.transform(t, lambda k: F.struct(k.alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(
            F.least(F.greatest((k + 0.5) / factor - 0.5, F.lit(0.0)), F.col(size) - 1.0) - F.col(axis))).alias("wt")))

    keys = frame_keys(df)
    rows = (df.withColumn("_y", F.explode(targets("y", "h"))).where("_y.wt > 0")
            .withColumn("_x", F.explode(targets("x", "w"))).where("_x.wt > 0"))
    return rows.groupBy(*keys, F.col("_y.t").cast("int").alias("y"), F.col("_x.t").cast("int").alias("x"),
                        (F.col("h") * factor).alias("h"), (F.col("w") * factor).alias("w")).agg(
        F.sum(val() * F.col("_y.wt") * F.col("_x.wt")).alias("value"))


def shear_transform(df: DataFrame, theta: float, shift_factor: int = 1, rows: str = "z", cols: str = "x") -> DataFrame:
    """Oblique planes straightened: the (rows, cols) plane under [[1, cos t], [0, sin t]], nearest samples.

    ``rows`` is first repeated ``shift_factor`` times. A target (r, c) takes the
    source at (r - c cos t / sin t, c / sin t), both rounded half to even, so a
    source pixel knows its targets: the columns and rows that round to it. Other
    coordinates stay. Targets that no source reaches have no row and stand for 0.
    """
    import math

    lean, narrow = math.cos(math.radians(theta)), math.sin(math.radians(theta))

    def near(v):
        return F.sequence(F.floor(v).cast("int") - 1, F.ceil(v).cast("int") + 1)

    c = F.filter(near(F.col(cols) * narrow), lambda k: (k >= 0) & (F.bround(k / narrow) == F.col(cols)))
    out = df.withColumn("_c", F.explode(c))
    source = F.explode(F.sequence(F.col(rows) * shift_factor, F.col(rows) * shift_factor + shift_factor - 1))
    out = out.withColumn("_z", source).withColumn("_s", F.col("_c") * lean / narrow)
    r = F.filter(near(F.col("_z") + F.col("_s")), lambda k: (k >= 0) & (F.bround(k - F.col("_s")) == F.col("_z")))
    out = out.withColumn("_r", F.explode(r))
    return out.drop(rows, cols, "_z", "_s").withColumnsRenamed({"_r": rows, "_c": cols}).select(*df.columns)
