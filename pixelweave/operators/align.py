"""Registration and line profiles: integer shifts, channel alignment,
stitching, kymographs and line scans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.masks import sample_points, sample_values
from pixelweave.operators.stencil import gaussian_blur
from pixelweave.schemas import frame_keys, movie_keys, val
from pixelweave.session import attach, cut_lineage


def _phase_peak(fixed: np.ndarray, moving: np.ndarray, reach: int | None = None) -> tuple[int, int]:
    """The cyclic (dy, dx) at which ``moving`` lies over ``fixed``, from the peak of their phase correlation.

    Offsets beyond half the extent count as negative ones; of equal peaks the
    shortest offset wins, so images without structure stay in place.
    """
    spectrum = np.conj(np.fft.fft2(fixed)) * np.fft.fft2(moving)
    size = np.abs(spectrum)
    corr = np.fft.ifft2(spectrum / np.maximum(size, max(size.max(), 1.0) * 1e-12)).real
    dy, dx = (np.where(np.arange(n) > n // 2, np.arange(n) - n, np.arange(n)) for n in corr.shape)
    cost = dy[:, None] ** 2 + dx[None] ** 2
    if reach is not None:
        corr = np.where((np.abs(dy)[:, None] <= reach) & (np.abs(dx)[None] <= reach), corr, -np.inf)
    top = np.flatnonzero(corr.ravel() >= corr.max() - 1e-9)
    y, x = np.unravel_index(top[np.argmin(cost.ravel()[top])], corr.shape)
    return int(dy[y]), int(dx[x])


def _register(keys: list[str], types: dict[str, str], reach: int | None):
    """Task code: one group of pixels (y, x, value, _ref) to one row (keys, dy, dx)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = (pdf[c].to_numpy().astype(int) for c in ("y", "x"))
        fixed, moving = np.zeros((2, y.max() + 1, x.max() + 1))
        fixed[y, x], moving[y, x] = pdf["_ref"].fillna(0.0), pdf["value"].fillna(0.0)
        dy, dx = _phase_peak(fixed, moving, reach)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "dy": [dy], "dx": [dx]})

    return run, ", ".join([*(f"{k} {types[k]}" for k in keys), "dy int", "dx int"])


def frame_shifts(df: DataFrame, reference_frame: int = 0, max_shift: int | None = None) -> DataFrame:
    """(frame keys, dy, dx): how far each frame has moved against the reference, over the whole frame.

    A frame and the reference pixels beside it are one group, so a group never
    exceeds an image. ``max_shift`` restricts the search where a bound is known.
    """
    keys, movie = frame_keys(df), movie_keys(df)
    ref = df.where(F.col("frame") == reference_frame).select(*movie, "y", "x", val().cast("double").alias("_ref"))
    both = df.select(*keys, "y", "x", val().cast("double").alias("value")).join(ref, [*movie, "y", "x"])
    run, schema = _register(keys, dict(df.dtypes), max_shift)
    return both.groupBy(*keys).applyInPandas(run, schema)


def motion_correction(df: DataFrame, reference_frame: int = 0, max_shift: int | None = None) -> DataFrame:
    """Move every frame by its integer shift; uncovered pixels become 0."""
    keys = frame_keys(df)
    shifts = cut_lineage(frame_shifts(df, reference_frame, max_shift))
    moved = attach(df.select(*keys, "y", "x", "value"), shifts, keys).select(
        *keys, (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), val().alias("_v"))
    return df.drop("value").join(moved, [*keys, "y", "x"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0))).drop("_v").select(*df.columns)


def _zoomed(df: DataFrame, scale: float) -> DataFrame:
    """Frames scaled with their corners held, then cut or padded with 0 around the middle to their old size.

    A target t of n' = round(n scale) reads position t (n - 1) / (n' - 1); each
    source pixel adds its weight to the targets that lie between its neighbours.
    """
    def targets(axis: str, size: str) -> Column:
        new = F.greatest(F.bround(F.col(size) * scale).cast("int"), F.lit(1))
        step = F.when(new > 1, (F.col(size) - 1) / (new - 1)).otherwise(0.0)
        off = F.floor((F.col(size) - new) / 2) if scale < 1 else -F.floor((new - F.col(size)) / 2)
        lo = F.when(step > 0, F.greatest(F.floor((F.col(axis) - 1) / step), F.lit(0))).otherwise(0).cast("int")
        hi = F.when(step > 0, F.least(F.ceil((F.col(axis) + 1) / step), new - 1)).otherwise(0).cast("int")
        spots = F.transform(F.sequence(lo, hi), lambda t: F.struct((t + off).cast("int").alias("t"), (1 - F.abs(t * step - F.col(axis))).alias("wt")))
        return F.filter(spots, lambda s: (s["wt"] > 0) & (s["t"] >= 0) & (s["t"] < F.col(size)))

    rows = df.withColumn("_y", F.explode(targets("y", "h"))).withColumn("_x", F.explode(targets("x", "w")))
    scaled = rows.groupBy(*frame_keys(df), F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg(F.sum(val() * F.col("_y.wt") * F.col("_x.wt")).alias("_v"))
    return df.join(scaled, [*frame_keys(df), "y", "x"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0))).select(*df.columns)


def _rotated(df: DataFrame, degrees: float) -> DataFrame:
    """Frames turned about their middle, at their old size: a target reads its source position, interpolated linearly, 0 outside.

    Every target asks for the at most four source pixels around its position,
    so the turn is one explode, one join and one combinable sum.
    """
    quarter = round(degrees / 90.0)
    exact = degrees == quarter * 90.0  # keeps whole positions whole
    c = (1, 0, -1, 0)[quarter % 4] if exact else math.cos(math.radians(degrees))
    s = (0, 1, 0, -1)[quarter % 4] if exact else math.sin(math.radians(degrees))
    keys = frame_keys(df)
    cy, cx = (F.col("h") - 1) / 2, (F.col("w") - 1) / 2
    dy, dx = F.col("y") - cy, F.col("x") - cx
    asked = df.select(*keys, F.col("y").alias("_ty"), F.col("x").alias("_tx"), "h", "w",
                      (c * dy + s * dx + cy).alias("_py"), (c * dx - s * dy + cx).alias("_px"))
    inside = (F.col("_py") >= 0) & (F.col("_py") <= F.col("h") - 1) & (F.col("_px") >= 0) & (F.col("_px") <= F.col("w") - 1)

    def taps(axis: str, place: str) -> Column:
        low = F.floor(place)
        both = F.array(F.struct(low.cast("int").alias(axis), (low + 1 - F.col(place)).alias(f"_w{axis}")),
                       F.struct((low + 1).cast("int").alias(axis), (F.col(place) - low).alias(f"_w{axis}")))
        return F.inline(F.filter(both, lambda t: t[f"_w{axis}"] > 0))

    asked = asked.where(inside).select("*", taps("y", "_py")).select("*", taps("x", "_px"))
    turned = (asked.join(df.select(*keys, "y", "x", val().alias("_v")), [*keys, "y", "x"])
              .groupBy(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(F.sum(F.col("_v") * F.col("_wy") * F.col("_wx")).alias("_v")))
    return df.join(turned, [*keys, "y", "x"], "left").withColumn("value", F.coalesce("_v", F.lit(0.0))).select(*df.columns)


def channel_alignment(red: DataFrame, green: DataFrame, x_shift: int = 0, y_shift: int = 0, scale: float = 1.0,
                      background: bool = False, bleach: bool = False, match_intensity: bool = False, rotation: float = 0.0) -> DataFrame:
    """v1 (red) and v2 (scaled, turned by ``rotation`` degrees, shifted green) on their common extent.

    Options remove each channel's frame minimum, scale frames to the movie mean,
    and bring green to red's mean. Scaling interpolates linearly, and the middle
    of the scaled image keeps its place and extent (0 where it is too small).
    """
    from pixelweave.operators.aggregate import bleach_ratio

    keys = [*frame_keys(red), "y", "x"]
    fk = frame_keys(red)

    def prepared(df):
        if background:
            low = df.groupBy(*fk).agg(F.min("value").alias("_lo"))
            df = attach(df, low, fk).withColumn("value", val() - F.col("_lo")).drop("_lo")
        return bleach_ratio(df) if bleach else df

    a, b = prepared(red), prepared(green)
    if scale != 1.0:
        b = _zoomed(b, scale)
    if rotation:
        b = _rotated(b, rotation)
    b = b.withColumn("y", (F.col("y") + y_shift).cast("int")).withColumn("x", (F.col("x") + x_shift).cast("int"))
    both = a.select(*keys, val().alias("v1")).join(b.select(*keys, val().alias("v2")), keys)
    if match_intensity:
        movie = movie_keys(red)
        means = both.groupBy(*movie).agg(F.avg("v1").alias("_a"), F.avg("v2").alias("_b"))
        both = attach(both, means, movie).withColumn("v2", F.when(F.col("_b") != 0, F.col("v2") * F.col("_a") / F.col("_b")).otherwise(F.col("v2"))).drop("_a", "_b")
    return both


def stitch_images(a: DataFrame, b: DataFrame, overlap: int, direction: str = "horizontal", blend: bool = True) -> DataFrame:
    """Join b to the right of (below) a where their last and first ``overlap`` columns (rows) fit best.

    The strips of the first frame are registered in both directions, over their
    whole extent, and the one shift found holds for the stack. Where the
    images overlap b fades in linearly over the overlapping part, or covers a
    without ``blend``. Coordinates start at 0; places neither covers have no row.
    """
    along, across, size, side = ("x", "y", "w", "h") if direction == "horizontal" else ("y", "x", "h", "w")
    keys, movie = frame_keys(a), movie_keys(a)
    first = a.groupBy(*movie).agg(F.min("frame").alias("frame"))
    left = a.join(first, keys).where(F.col(along) >= F.col(size) - overlap).select(*keys, F.col(across), (F.col(along) - F.col(size) + overlap).alias(along), val().alias("_ref"))
    right = b.join(first, keys).where(F.col(along) < overlap).select(*keys, across, along, "value")
    run, schema = _register(keys, dict(a.dtypes), None)
    found = left.join(right, [*keys, "y", "x"]).groupBy(*keys).applyInPandas(run, schema)
    step, slide = ("dx", "dy") if direction == "horizontal" else ("dy", "dx")
    extent = a.groupBy(*movie).agg(F.max(size).alias("_wa"), F.max(side).alias("_ha"))
    offset = found.join(extent, movie).select(*movie, "_wa", (F.col("_wa") - overlap - F.col(step)).alias("_o"), (-F.col(slide)).alias("_p"))
    placed = b.join(offset, movie).select(*keys, (F.col(along) + F.col("_o")).alias(along), (F.col(across) + F.col("_p")).alias(across), val().alias("_b"))
    both = a.select(*keys, "y", "x", val().alias("_a")).join(placed, [*keys, "y", "x"], "full").join(offset, movie)
    pos = F.least(F.greatest((F.col(along) - F.col("_o") + 0.5) / (F.col("_wa") - F.col("_o")), F.lit(0.0)), F.lit(1.0)) if blend else F.lit(1.0)
    value = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") * (1 - pos) + F.col("_b") * pos)
    start = {along: F.least(F.lit(0), F.col("_o")), across: F.least(F.lit(0), F.col("_p"))}
    return both.select(*keys, *((F.col(c) - start[c]).cast("int").alias(c) for c in ("y", "x")), value.alias("value"))


def linescan(df: DataFrame, points: list[tuple[float, float]], width: int = 1, integration: str = "Mean") -> DataFrame:
    """Profile along a poly-line per frame; Mean, Max or Min across its width."""
    agg = {"Mean": F.avg, "Max": F.max, "Min": F.min}[integration]
    samples = sample_values(df, sample_points(df.sparkSession, points, width))
    return samples.groupBy(*frame_keys(df), "pos").agg(agg("value").alias("value"))


def kymograph(df: DataFrame, points: list[tuple[float, float]], width: int = 1, temporal_binning: int = 1,
              detrend: bool = False, gaussian_sigma: float = 0.0, normalize: bool = False) -> DataFrame:
    """Line profile per (binned) frame: rows (movie, bin, pos, value).

    A last bin of fewer frames is left out, unless it is the only one.
    Detrending takes the least-squares line of every position off, mean included.
    """
    movie = movie_keys(df)
    profile = linescan(df, points, width).withColumn("bin", F.floor(F.col("frame") / temporal_binning).cast("int"))
    kymo = profile.groupBy(*movie, "bin", "pos").agg(F.avg("value").alias("value"))
    if temporal_binning > 1:
        whole = profile.groupBy(*movie).agg(F.floor((F.max("frame") + 1) / temporal_binning).cast("int").alias("_whole"))
        kymo = kymo.join(whole, movie).where((F.col("bin") < F.col("_whole")) | (F.col("_whole") == 0)).drop("_whole")
    if detrend:
        keys = [*movie, "pos"]
        t = F.col("bin").cast("double")
        line = kymo.groupBy(*keys).agg(F.regr_slope("value", t).alias("_k"), F.avg(t).alias("_t"), F.avg("value").alias("_m"))
        fitted = F.col("_m") + F.coalesce("_k", F.lit(0.0)) * (F.col("bin") - F.col("_t"))
        kymo = attach(kymo, line, keys).withColumn("value", val() - fitted).drop("_k", "_t", "_m")
    if gaussian_sigma > 0:
        size = kymo.groupBy(*movie).agg((F.max("bin") + 1).alias("h"), (F.max("pos") + 1).alias("w"))
        image = attach(kymo, size, movie).withColumnsRenamed({"bin": "y", "pos": "x"}).withColumn("frame", F.lit(0))
        kymo = gaussian_blur(image, gaussian_sigma, mode="reflect").select(*movie, F.col("y").alias("bin"), F.col("x").alias("pos"), "value")
    if normalize:
        ext = kymo.groupBy(*movie).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        kymo = attach(kymo, ext, movie).withColumn("value", F.when(F.col("_hi") > F.col("_lo"), (val() - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")
    return kymo
