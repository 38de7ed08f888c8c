"""Track tables: summaries, kinematics, geometry, diffusion, direction.

Input: rows with track_id, frame, x, y and usually intensity, one row per
(track, frame). Every ordered step goes through the block helpers, every
per-track value is a combinable aggregate, so one very long track spreads over
many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelweave.operators.blocks import (
    BLOCK, block_window, core, dense_index, exact_quantiles, halo, lag_square_sums, lagged_pairs)
from pixelweave.schemas import track_keys
from pixelweave.session import attach, cut_lineage


# -- shared building blocks -------------------------------------------------

def indexed(df: DataFrame) -> DataFrame:
    """Add idx (0-based point number) and n (track length) if missing."""
    if {"idx", "n"} <= set(df.columns):
        return df
    order = ["frame", *[c for c in ("id",) if c in df.columns]]
    return dense_index(df, track_keys(df), order, F.floor(F.col("frame") / F.lit(BLOCK)))


def with_points(df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Add the coordinates of neighbouring points: x_m1, y_m1, .. x_p1, y_p1."""
    rows = halo(indexed(df), "idx", before, after)
    w = block_window(track_keys(df), "idx")
    added = {}
    for k in range(1, before + 1):
        added |= {f"x_m{k}": F.lag("x", k).over(w), f"y_m{k}": F.lag("y", k).over(w)}
    for k in range(1, after + 1):
        added |= {f"x_p{k}": F.lead("x", k).over(w), f"y_p{k}": F.lead("y", k).over(w)}
    return core(rows.withColumns(added))


def _dist(x1: str, y1: str, x2: str, y2: str) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return F.sqrt(dx * dx + dy * dy)


def _origin(df: DataFrame) -> DataFrame:
    """First frame and first point of each track."""
    first = F.min_by(F.struct("frame", "x", "y"), F.col("frame")).alias("_o")
    return df.groupBy(*track_keys(df)).agg(first).select(
        *track_keys(df), F.col("_o.frame").alias("frame0"), F.col("_o.x").alias("x0"), F.col("_o.y").alias("y0"))


# -- table model ------------------------------------------------------------

def track_summary(df: DataFrame) -> DataFrame:
    return df.where("track_id >= 0").groupBy(*track_keys(df)).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"), F.avg("intensity").alias("mean_intensity"))


def particle_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_localizations"),
        F.countDistinct(F.when(F.col("track_id") >= 0, F.col("track_id"))).alias("n_tracks"),
        F.countDistinct("frame").alias("n_frames"))


def frame_locs(df: DataFrame, frame: int) -> DataFrame:
    return df.where(F.col("frame") == frame)


def track_locs(df: DataFrame, track_id: int) -> DataFrame:
    return df.where(F.col("track_id") == track_id)


def track_ids(df: DataFrame) -> DataFrame:
    return df.where("track_id >= 0").select("track_id").distinct().orderBy("track_id")


def min_track_length(df: DataFrame, n: int) -> DataFrame:
    keys = track_keys(df)
    long_enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return attach(df, long_enough, keys, "left_semi")


def set_tracks(locs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Assign track_id from a table of (track_id, members array of row ids).

    Unknown members are ignored; points in no list get -1.
    """
    members = tracks.select("track_id", F.explode("members").alias("id"))
    return (locs.drop("track_id").join(members, "id", "left")
            .withColumn("track_id", F.coalesce("track_id", F.lit(-1).cast("long"))))


def track_array(locs: DataFrame, links: DataFrame) -> DataFrame:
    """Localizations with their track_id from an (id, track_id) table, -1 if unlinked."""
    return locs.join(links, "id", "left").withColumn("track_id", F.coalesce("track_id", F.lit(-1).cast("long")))


def track_feature_broadcast(df: DataFrame, features: DataFrame) -> DataFrame:
    return attach(df, features, track_keys(df), "left")


def track_order(df: DataFrame, by: str) -> DataFrame:
    """Tracks ordered by "id", "start", "intensity" (brightest first) or "length" (longest first)."""
    summary = track_summary(df)
    order = {"id": [F.col("track_id")], "start": [F.col("first_frame")],
             "intensity": [F.col("mean_intensity").desc()], "length": [F.col("n_points").desc()]}[by]
    return summary.orderBy(*order, "track_id")


def linking_stats(df: DataFrame) -> DataFrame:
    """One row of linking statistics over a table with track_id (-1 = unlinked)."""
    lengths = df.where("track_id >= 0").groupBy(*track_keys(df)).agg(F.count(F.lit(1)).alias("length"))
    totals = df.agg(F.count(F.lit(1)).alias("total_points"),
                    F.sum(F.when(F.col("track_id") >= 0, 1).otherwise(0)).alias("linked_points"))
    stats = lengths.agg(
        F.count(F.lit(1)).alias("num_tracks"), F.avg("length").alias("mean_track_length"),
        F.max("length").alias("max_track_length"), F.min("length").alias("min_track_length"),
        F.stddev_pop("length").alias("std_track_length"),
        F.sum(F.when(F.col("length") == 1, 1).otherwise(0)).alias("singletons"),
        F.sum(F.when(F.col("length") >= 10, 1).otherwise(0)).alias("long_tracks"))
    median = exact_quantiles(lengths, [], "length", {"median_track_length": 0.5})
    return (attach(attach(stats, totals, []), median, [])
            .withColumn("unlinked_points", F.col("total_points") - F.col("linked_points"))
            .withColumn("linking_efficiency", F.col("linked_points") / F.col("total_points")))


def length_histogram(df: DataFrame, max_bins: int = 50) -> DataFrame:
    """Histogram of track lengths over (1, max_len + 1) with min(max_len, max_bins) bins."""
    lengths = df.where("track_id >= 0").groupBy(*track_keys(df)).agg(F.count(F.lit(1)).alias("length"))
    counted = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    top = counted.agg(F.max("length").alias("m"))
    nbins = F.least(F.col("m"), F.lit(max_bins))
    bin_ = F.least(F.floor((F.col("length") - 1) / (F.col("m") / nbins)), nbins - 1)
    return attach(counted, top, []).groupBy(bin_.cast("int").alias("bin")).agg(F.sum("c").alias("n_tracks"))


# -- kinematics -------------------------------------------------------------

def lag_displacements(df: DataFrame) -> DataFrame:
    return (with_points(df, before=1).where("idx > 0")
            .select(*track_keys(df), "idx", _dist("x", "y", "x_m1", "y_m1").alias("step")))


def velocity_analysis(df: DataFrame, dt: float = 1.0) -> DataFrame:
    speed = F.col("step") / F.lit(dt)
    return lag_displacements(df).groupBy(*track_keys(df)).agg(
        F.avg(speed).alias("mean_velocity"), F.max(speed).alias("max_velocity"))


def diffusion_columns(df: DataFrame) -> DataFrame:
    """Zeroed coordinates, frame offset, distance from the first point, squares."""
    rows = attach(with_points(df, after=1), _origin(df), track_keys(df))
    return (rows.withColumn("lag", _dist("x_p1", "y_p1", "x", "y"))
            .withColumn("zeroed_x", F.col("x") - F.col("x0")).withColumn("zeroed_y", F.col("y") - F.col("y0"))
            .withColumn("lag_number", F.col("frame") - F.col("frame0"))
            .withColumn("distance_from_origin", _dist("x", "y", "x0", "y0"))
            .withColumn("d_squared", F.col("distance_from_origin") * F.col("distance_from_origin"))
            .withColumn("lag_squared", F.col("lag") * F.col("lag"))
            .drop("x_p1", "y_p1", "x0", "y0", "frame0"))


def velocity_columns(df: DataFrame, frame_length: float = 1.0) -> DataFrame:
    """Gap-aware velocity: the forward lag of a row over the frame gap behind it."""
    rows = halo(diffusion_columns(df), "idx", 1, 0)
    w = block_window(track_keys(df), "idx")
    degrees = F.degrees(F.atan2("zeroed_y", "zeroed_x"))
    rows = core(rows.withColumn("dt", (F.col("frame") - F.lag("frame").over(w)) * F.lit(frame_length)))
    rows = (rows.withColumn("velocity", F.when(F.col("dt") > 0, F.col("lag") / F.col("dt")))
            .withColumn("direction_relative_to_origin", F.when(degrees < 0, degrees + 360).otherwise(degrees)))
    means = rows.groupBy(*track_keys(df)).agg(F.avg("velocity").alias("mean_velocity"))
    return attach(rows, means, track_keys(df))


def distance_from_origin(df: DataFrame) -> DataFrame:
    return (attach(df, _origin(df), track_keys(df))
            .withColumn("distance_from_origin", _dist("x", "y", "x0", "y0")).drop("x0", "y0", "frame0"))


def track_intensity_stats(df: DataFrame, population: bool = False) -> DataFrame:
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*track_keys(df)).agg(F.avg("intensity").alias("track_intensity_mean"),
                                            std("intensity").alias("track_intensity_std"))
    return attach(df, stats, track_keys(df))


def step_angles(df: DataFrame) -> DataFrame:
    """Angle of each step (y inverted, 0-360) and the change from the step before."""
    rows = with_points(df, before=2).where("idx > 0")

    def angle(x2, y2, x1, y1):
        a = F.degrees(F.atan2(-(F.col(y2) - F.col(y1)), F.col(x2) - F.col(x1)))
        return F.when(a < 0, a + 360).otherwise(a)

    here, before = angle("x", "y", "x_m1", "y_m1"), angle("x_m1", "y_m1", "x_m2", "y_m2")
    change = F.abs(here - before)
    return rows.select(*track_keys(df), "idx", here.alias("direction_deg"),
                       F.when(F.col("idx") > 1, F.when(change > 180, 360 - change).otherwise(change)).alias("direction_change"))


def direction_analysis(df: DataFrame) -> DataFrame:
    return step_angles(df).groupBy(*track_keys(df)).agg(
        F.avg("direction_deg").alias("mean_direction"),
        F.coalesce(1 - F.avg("direction_change") / 180, F.lit(0.0)).alias("directional_persistence"))


# -- diffusion --------------------------------------------------------------

def default_max_lag(n: Column) -> Column:
    return F.least(F.greatest(F.floor(n / F.lit(4)), F.lit(2)), n - 1)


def msd_single(df: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Mean squared displacement per track and index lag."""
    rows = indexed(df)
    limit = default_max_lag(F.col("n")) if max_lag is None else F.least(F.lit(max_lag), F.col("n") - 1)
    sums = lag_square_sums(rows, track_keys(df), "idx", "x", "y", limit)
    return sums.groupBy(*track_keys(df), "lag").agg((F.sum("sq") / F.sum("n")).alias("msd"), F.sum("n").alias("n_pairs"))


def msd_ensemble(df: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Count-weighted mean over tracks and its standard error."""
    per_track = msd_single(df, max_lag)
    w, v = F.col("n_pairs"), F.col("msd")
    mean = F.sum(w * v) / F.sum(w)
    spread = per_track.groupBy("lag").agg(
        mean.alias("msd_mean"), (F.sum(w * v * v) / F.sum(w)).alias("_m2"), F.count(F.lit(1)).alias("n_tracks"))
    variance = F.greatest(F.col("_m2") - F.col("msd_mean") * F.col("msd_mean"), F.lit(0.0))
    return spread.select("lag", "msd_mean", F.when(F.col("n_tracks") > 1, F.sqrt(variance / F.col("n_tracks")))
                         .otherwise(0.0).alias("msd_sem"), "n_tracks")


def msd_pooled(df: DataFrame, max_lag: int) -> DataFrame:
    sums = lag_square_sums(indexed(df), track_keys(df), "idx", "x", "y", F.least(F.lit(max_lag), F.col("n") - 1))
    return sums.groupBy("lag").agg((F.sum("sq") / F.sum("n")).alias("msd"), F.sum("n").alias("n_pairs"))


def _linear_terms(ndim: int) -> Column:
    early = F.col("lag") <= 10
    slope = F.regr_slope(F.when(early, F.col("msd")), F.when(early, F.col("lag").cast("double")))
    return F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(
        F.greatest(slope / (2.0 * ndim), F.lit(0.0))).alias("diffusion_coefficient")


def _anomalous_terms(ndim: int) -> tuple[Column, Column]:
    ok = F.col("msd") > 0
    y, x = F.when(ok, F.ln("msd")), F.when(ok, F.ln(F.col("lag").cast("double")))
    enough = (F.count(F.lit(1)) >= 3) & (F.count(y) >= 2)
    return (F.when(enough, F.regr_slope(y, x)).otherwise(1.0).alias("anomalous_exponent"),
            F.when(enough, F.exp(F.regr_intercept(y, x)) / (2.0 * ndim)).otherwise(0.0).alias("anomalous_diffusion"))


def fit_msd_linear(msd: DataFrame, keys: list[str], ndim: int = 2) -> DataFrame:
    """D from the slope of the first ten lags, floored at 0."""
    return msd.groupBy(*keys).agg(_linear_terms(ndim))


def fit_msd_anomalous(msd: DataFrame, keys: list[str], ndim: int = 2) -> DataFrame:
    return msd.groupBy(*keys).agg(*_anomalous_terms(ndim))


def msd_analysis(df: DataFrame, max_lag: int | None = None, min_points: int = 5) -> DataFrame:
    """Both fits per track; tracks shorter than min_points get D = 0, alpha = 1."""
    keys = track_keys(df)
    rows = indexed(df)
    fits = msd_single(rows.where(F.col("n") >= min_points), max_lag).groupBy(*keys).agg(
        _linear_terms(2), _anomalous_terms(2)[0])
    tracks = rows.where("idx = 0").select(*keys)
    return tracks.join(fits, keys, "left").na.fill({"diffusion_coefficient": 0.0, "anomalous_exponent": 1.0})


# -- geometry ---------------------------------------------------------------

def _tensor_features(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over rows with the backward step: gyration tensor, step
    moments, path sums and end points.

    Skewness and kurtosis of the steps along the dominant axis are polynomials
    in the raw step moments, so the axis need not be joined back to the rows.
    """
    dx, dy = F.col("x") - F.col("x_m1"), F.col("y") - F.col("y_m1")
    step = F.sqrt(dx * dx + dy * dy)
    powers = [F.avg(_power(dx, i) * _power(dy, j)).alias(f"_m{i}{j}")
              for i in range(5) for j in range(5 - i) if i + j]
    first, last = F.min_by(F.struct("x", "y"), F.col("idx")), F.max_by(F.struct("x", "y"), F.col("idx"))
    agg = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.var_pop("x").alias("_sxx"), F.var_pop("y").alias("_syy"), F.covar_pop("x", "y").alias("_sxy"),
        F.sum(step).alias("path_length"), F.avg(step).alias("mean_step"), F.max(step).alias("max_step"),
        F.sum(dx * dx + dy * dy).alias("_ss"), first.alias("_first"), last.alias("_last"), *powers)
    trace, diff = F.col("_sxx") + F.col("_syy"), F.col("_sxx") - F.col("_syy")
    root = F.sqrt(diff * diff + 4 * F.col("_sxy") * F.col("_sxy"))
    agg = agg.withColumn("_l1", (trace + root) / 2).withColumn("_l2", (trace - root) / 2)
    # dominant axis, oriented towards +x (towards +y when vertical)
    ax = F.when(F.col("_sxy") == 0, F.when(diff >= 0, 1.0).otherwise(0.0)).otherwise(F.col("_l1") - F.col("_syy"))
    ay = F.when(F.col("_sxy") == 0, F.when(diff >= 0, 0.0).otherwise(1.0)).otherwise(F.col("_sxy"))
    norm = F.sqrt(ax * ax + ay * ay)
    agg = agg.withColumn("_ax", ax / norm).withColumn("_ay", ay / norm)

    def raw(k: int) -> Column:
        return sum((math.comb(k, i) * _power(F.col("_ax"), i) * _power(F.col("_ay"), k - i) * F.col(f"_m{i}{k - i}")
                    for i in range(1, k + 1)), _power(F.col("_ay"), k) * F.col(f"_m0{k}"))

    agg = agg.withColumns({f"_r{k}": raw(k) for k in range(1, 5)})
    m, r2, r3, r4 = (F.col(f"_r{k}") for k in range(1, 5))
    c2 = r2 - m * m
    c3 = r3 - 3 * m * r2 + 2 * m * m * m
    c4 = r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m
    long_ = F.col("n_points") >= 3
    spread = 2 * trace * trace
    gap = F.col("_l1") - F.col("_l2")
    net_x, net_y = F.col("_last.x") - F.col("_first.x"), F.col("_last.y") - F.col("_first.y")
    net2 = net_x * net_x + net_y * net_y
    return agg.select(
        *keys, "n_points", "path_length", "mean_step", "max_step",
        F.col("_first.x").alias("first_x"), F.col("_first.y").alias("first_y"),
        F.col("_last.x").alias("last_x"), F.col("_last.y").alias("last_y"),
        F.when(long_, F.sqrt(trace)).otherwise(0.0).alias("radius_gyration"),
        F.when(long_ & (spread > 0), -F.ln(1 - gap * gap / spread)).otherwise(0.0).alias("asymmetry"),
        F.when(long_ & (c2 > 0), c3 / F.pow(c2, F.lit(1.5))).when(~long_, 0.0).alias("skewness"),
        F.when(long_ & (c2 > 0), c4 / (c2 * c2) - 3).when(~long_, 0.0).alias("kurtosis"),
        F.when(F.col("n_points") >= 2, F.sqrt(net2)).otherwise(0.0).alias("net_displacement"),
        F.when(F.col("n_points") < 2, 0.0).when(F.col("n_points") < 3, 1.0)
         .when(F.col("_ss") > 0, net2 / ((F.col("n_points") - 1) * F.col("_ss"))).otherwise(0.0).alias("efficiency"))


def _power(c: Column, k: int) -> Column:
    out = F.lit(1.0)
    for _ in range(k):
        out = out * c
    return out


def radius_of_gyration(df: DataFrame) -> DataFrame:
    keys = track_keys(df)
    return _tensor_features(with_points(df, before=1), keys).select(
        *keys, "radius_gyration", "asymmetry", "skewness", "kurtosis")


def rg_simple(df: DataFrame) -> DataFrame:
    """sqrt(var x + var y) over complete points; null below two points."""
    keys = track_keys(df)
    ok = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return ok.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, F.sqrt(F.var_pop("x") + F.var_pop("y"))).alias("rg"))


def scaled_rg(df: DataFrame) -> DataFrame:
    """sqrt(pi/2) * Rg / mean step."""
    keys = track_keys(df)
    f = _tensor_features(with_points(df, before=1), keys)
    return f.select(*keys, F.when(F.col("mean_step") != 0, math.sqrt(math.pi / 2) * F.col("radius_gyration") / F.col("mean_step")).alias("scaled_rg"))


def rg_scaled(df: DataFrame) -> DataFrame:
    """Rg over mean lag, segment count and track length; 0 on a zero divisor."""
    keys = track_keys(df)
    f = _tensor_features(with_points(df, before=1), keys)
    return f.select(*keys, *[_ratio("radius_gyration", d).alias(o) for d, o in (
        ("mean_step", "rg_scaled"), ("n_points", "rg_scaled_segments"), ("path_length", "rg_scaled_length"))])


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b).isNull() | (F.col(b) == 0), 0.0).otherwise(F.col(a) / F.col(b))


def net_displacement_efficiency(df: DataFrame) -> DataFrame:
    keys = track_keys(df)
    return _tensor_features(with_points(df, before=1), keys).select(*keys, "net_displacement", "efficiency")


def straightness(df: DataFrame) -> DataFrame:
    """Mean cosine and sine of the turn angles after dropping repeated points."""
    keys = track_keys(df)
    rows = with_points(df, before=1)
    moved = rows.where((F.col("idx") == 0) | (F.col("x") != F.col("x_m1")) | (F.col("y") != F.col("y_m1")))
    again = dense_index(moved.select(*keys, F.col("idx").alias("_i"), "x", "y"), keys, ["_i"],
                        F.floor(F.col("_i") / F.lit(BLOCK)))
    turns = with_points(again, before=2)
    ax, ay = F.col("x_m1") - F.col("x_m2"), F.col("y_m1") - F.col("y_m2")
    bx, by = F.col("x") - F.col("x_m1"), F.col("y") - F.col("y_m1")
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return turns.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(size > 0, (ax * bx + ay * by) / size)), F.lit(0.0)).alias("mean_cos"),
        F.coalesce(F.avg(F.when(size > 0, (ax * by - ay * bx) / size)), F.lit(0.0)).alias("mean_sin"))


_POINTS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull vertices of an (n, 2) array, collinear points left out."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _point_lists(points: pa.Array) -> Iterator[np.ndarray]:
    """The (n, 2) points of every row, cut from one flat array."""
    xy = np.column_stack([points.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype(float, copy=False)
    ends = points.offsets.to_numpy()
    return (xy[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


@F.arrow_udf(_POINTS)
def _hull_udf(points: pa.Array) -> pa.Array:
    hulls = [_hull(p) for p in _point_lists(points)]
    flat = np.concatenate([*hulls, np.empty((0, 2))])
    ends = np.append(0, np.cumsum([len(h) for h in hulls])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in (0, 1)], names=["x", "y"]))


@F.arrow_udf(DoubleType())
def _diameter_udf(points: pa.Array) -> pa.Array:
    def widest(p: np.ndarray) -> float:
        a = _hull(p)
        return max(float(np.sqrt(((a - v) ** 2).sum(axis=1)).max()) for v in a)

    return pa.array([widest(p) for p in _point_lists(points)], pa.float64())


def track_diameter(df: DataFrame, block: int = BLOCK, fan_in: int = 64) -> DataFrame:
    """Largest distance between two points of a track.

    Only hull vertices can realise it, so blocks are reduced to their hulls and
    merged ``fan_in`` at a time; no pair of points crosses a shuffle.
    """
    keys = track_keys(df)
    rows = indexed(df).withColumn("_blk", F.floor(F.col("idx") / F.lit(block)))
    hulls = rows.groupBy(*keys, "_blk").agg(F.collect_list(F.struct("x", "y")).alias("_p"))
    longest = rows.where("idx = 0").agg(F.max("n")).first()[0] or 0
    blocks = math.ceil(longest / block)
    while blocks > fan_in:
        hulls = (hulls.withColumn("_p", _hull_udf("_p")).withColumn("_blk", F.floor(F.col("_blk") / F.lit(fan_in)))
                 .groupBy(*keys, "_blk").agg(F.flatten(F.collect_list("_p")).alias("_p")))
        blocks = math.ceil(blocks / fan_in)
    if blocks > 1:
        hulls = (hulls.withColumn("_p", _hull_udf("_p"))
                 .groupBy(*keys).agg(F.flatten(F.collect_list("_p")).alias("_p")))
    return hulls.select(*keys, _diameter_udf("_p").alias("diameter"))


def fractal_dimension(df: DataFrame) -> DataFrame:
    """log n / log(n * diameter / path length); 1 for short or collinear tracks."""
    keys = track_keys(df)
    rows = attach(with_points(df, before=1), _origin(df), keys)
    away = (F.col("x") != F.col("x0")) | (F.col("y") != F.col("y0"))
    vertical = away & (F.col("x") == F.col("x0"))
    slope = F.when(away & ~vertical, F.try_divide(F.col("y") - F.col("y0"), F.col("x") - F.col("x0")))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(_dist("x", "y", "x_m1", "y_m1")).alias("_len"),
        F.count(F.when(away, 1)).alias("_away"), F.count(F.when(vertical, 1)).alias("_vert"),
        F.min(slope).alias("_s0"), F.max(slope).alias("_s1"))
    collinear = (F.col("_vert") == F.col("_away")) | ((F.col("_vert") == 0) & (F.col("_s0") == F.col("_s1")))
    flat = (F.col("_n") < 3) | (F.col("_away") < 2) | collinear
    n = F.col("_n").cast("double")
    return agg.join(track_diameter(df), keys).select(*keys, F.when(flat, 1.0).otherwise(
        F.ln(n) / F.ln(n * F.col("diameter") / F.col("_len"))).alias("fractal_dimension"))


def linear_motion_class(df: DataFrame, directionality: float = 0.8, perpendicular: float = 0.15) -> DataFrame:
    keys = track_keys(df)
    ok = df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    rows = with_points(ok, before=1)
    ends = _tensor_features(rows, keys).select(*keys, "n_points", "path_length", "net_displacement",
                                               "first_x", "first_y", "last_x", "last_y")
    joined = attach(rows, ends, keys)
    # distance from the chord = |cross product| / chord length
    cross = ((F.col("last_x") - F.col("first_x")) * (F.col("y") - F.col("first_y"))
             - (F.col("last_y") - F.col("first_y")) * (F.col("x") - F.col("first_x")))
    perp = F.when(F.col("net_displacement") > 0, F.abs(cross) / F.col("net_displacement"))
    agg = joined.groupBy(*keys).agg(
        F.first("n_points").alias("_n"), F.first("path_length").alias("_len"),
        F.first("net_displacement").alias("_net"), F.avg(perp).alias("_perp"))
    usable = (F.col("_n") >= 3) & (F.col("_len") > 0)
    ratio = F.when(usable, F.col("_net") / F.col("_len"))
    norm = F.when(usable & (F.col("_net") > 0), F.col("_perp") / F.col("_net"))
    straight = F.coalesce(norm <= perpendicular, F.lit(False))
    return agg.select(
        *keys,
        F.when(~F.coalesce(usable, F.lit(False)), "unclassified").when(straight & (ratio >= directionality), "linear_unidirectional")
         .when(straight, "linear_bidirectional").otherwise("non_linear").alias("classification"),
        ratio.alias("directionality_ratio"),
        F.when(usable, F.col("_perp")).alias("mean_perpendicular_distance"),
        norm.alias("normalized_perpendicular_distance"))


# -- feature tables ---------------------------------------------------------

def track_features(df: DataFrame, frame_interval: float = 1.0) -> DataFrame:
    """All features per track; null for tracks below three points."""
    keys = track_keys(df)
    rows = cut_lineage(indexed(df))  # read by five feature groups
    base = _tensor_features(with_points(rows, before=1), keys)
    out = (base.join(fractal_dimension(rows), keys).join(straightness(rows), keys)
           .join(msd_analysis(rows), keys).join(direction_analysis(rows), keys, "left"))
    long_ = F.col("n_points") >= 3

    def when(c, name):
        return F.when(long_, c).alias(name)

    return out.select(
        *keys, "n_points", when(F.col("radius_gyration"), "radius_gyration"), when(F.col("asymmetry"), "asymmetry"),
        when(F.col("skewness"), "skewness"), when(F.col("kurtosis"), "kurtosis"),
        when(F.col("fractal_dimension"), "fractal_dimension"), when(F.col("net_displacement"), "net_displacement"),
        when(F.col("efficiency"), "efficiency"), when(F.col("mean_cos"), "straightness"),
        when(F.col("mean_step") / frame_interval, "mean_velocity"), when(F.col("max_step") / frame_interval, "max_velocity"),
        when(F.col("diffusion_coefficient"), "diffusion_coefficient"),
        when(F.col("anomalous_exponent"), "anomalous_exponent"),
        when(F.col("directional_persistence"), "directional_persistence"),
        when(F.col("mean_direction"), "mean_direction"))


def track_features_rows(df: DataFrame, min_segments: int = 0, rounded: bool = True) -> DataFrame:
    """Row-level feature table for tracks with more than min_segments points,
    rounded half-even to the fixed number of digits."""
    keys = track_keys(df)
    rows = indexed(df)
    if min_segments:
        rows = rows.where(F.col("n") > min_segments)
    rows = cut_lineage(rows)
    base = _tensor_features(with_points(rows, before=1), keys)
    light = rows.groupBy(*keys).agg(F.avg("intensity").alias("track_intensity_mean"),
                                    F.stddev_pop("intensity").alias("track_intensity_std"))
    per_track = (base.join(fractal_dimension(rows), keys).join(straightness(rows), keys).join(light, keys)
                 .withColumn("track_length", F.coalesce("path_length", F.lit(0.0))))
    forward = with_points(rows, after=1).withColumn("lag", _dist("x_p1", "y_p1", "x", "y"))
    out = attach(forward, per_track, keys)
    digits = {
        "track_length": F.col("track_length"), "radius_gyration": F.col("radius_gyration"),
        "asymmetry": F.col("asymmetry"), "skewness": F.col("skewness"), "kurtosis": F.col("kurtosis"),
        "radius_gyration_scaled": F.try_divide("radius_gyration", "mean_step"),
        "radius_gyration_scaled_n_segments": F.col("radius_gyration") / F.col("n"),
        "radius_gyration_scaled_track_length": F.try_divide("radius_gyration", "track_length"),
        "lag": F.col("lag"), "mean_lag": F.col("mean_step"), "fractal_dimension": F.col("fractal_dimension"),
        "net_displacement": F.col("net_displacement"), "straightness": F.col("mean_cos")}

    def cut(c, places):
        return F.bround(c, places) if rounded else c

    return out.select(
        *keys, "frame", "x", "y", "intensity", F.col("n").alias("n_segments"),
        *[cut(c, 3).alias(k) for k, c in digits.items()],
        *[cut(F.col(k), 2).alias(k) for k in ("track_intensity_mean", "track_intensity_std")])


def per_point_features(df: DataFrame, frame_interval: float = 1.0) -> DataFrame:
    """Forward lag and distance from origin per point, with the track features."""
    keys = track_keys(df)
    rows = attach(with_points(df, after=1), _origin(df), keys)
    points = rows.select(*keys, "frame", "x", "y", "intensity",
                         _dist("x", "y", "x0", "y0").alias("distance_from_origin"),
                         _dist("x_p1", "y_p1", "x", "y").alias("lag"))
    return attach(points, track_features(df, frame_interval), keys)


# -- direction autocorrelation ---------------------------------------------

def _displacements(df: DataFrame) -> DataFrame:
    keys = track_keys(df)
    rows = with_points(df, before=1).where("idx > 0")
    return rows.select(*keys, (F.col("idx") - 1).alias("idx"), "n", (F.col("x") - F.col("x_m1")).alias("dx"),
                       (F.col("y") - F.col("y_m1")).alias("dy"))


def _cosine() -> Column:
    a, b = F.col("a"), F.col("b")
    na = F.sqrt(a.dx * a.dx + a.dy * a.dy)
    nb = F.sqrt(b.dx * b.dx + b.dy * b.dy)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a.dx * b.dx + a.dy * b.dy) / (na * nb)))
    return F.when((na > 1e-15) & (nb > 1e-15), cos)


def direction_autocorrelation_tracks(df: DataFrame, n_intervals: int = 25, min_track_length: int = 4) -> DataFrame:
    """Mean cosine between displacements ``lag`` apart, per track."""
    disp = _displacements(df).where(F.col("n") >= min_track_length)
    pairs = lagged_pairs(disp, track_keys(df), "idx", ["dx", "dy"], F.least(F.lit(n_intervals), F.col("n") - 2))
    return pairs.groupBy(*track_keys(df), "lag").agg(F.coalesce(F.avg(_cosine()), F.lit(0.0)).alias("correlation"))


def direction_autocorrelation(df: DataFrame, n_intervals: int = 25, min_track_length: int = 4) -> DataFrame:
    n = F.count(F.lit(1))
    std = F.when(n > 1, F.stddev_samp("correlation")).otherwise(0.0)
    return direction_autocorrelation_tracks(df, n_intervals, min_track_length).groupBy("lag").agg(
        F.avg("correlation").alias("mean_correlation"), (std / F.sqrt(n)).alias("sem_correlation"),
        std.alias("std_correlation"), n.alias("n_tracks"))


def direction_autocorrelation_pooled(df: DataFrame, n_intervals: int = 25) -> DataFrame:
    """Scalar products of unit displacement vectors pooled over tracks of at
    least three points, with the fixed (1, 0) entry at interval 0."""
    disp = _displacements(df).where("n >= 3")
    pairs = lagged_pairs(disp, track_keys(df), "idx", ["dx", "dy"], F.least(F.lit(n_intervals), F.col("n") - 2))
    pooled = (pairs.select("lag", _cosine().alias("p")).where("p is not null").groupBy("lag")
              .agg(F.avg("p").alias("avg"), (F.stddev_samp("p") / F.sqrt(F.count("p"))).alias("sem")))
    zero = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("lag"), F.lit(1.0).alias("avg"), F.lit(0.0).alias("sem"))
    return pooled.unionByName(zero)


def persistence_index(df: DataFrame, lag: int = 1, n_intervals: int = 25, min_track_length: int = 4) -> DataFrame:
    return (direction_autocorrelation(df, n_intervals, min_track_length).where(F.col("lag") == lag)
            .select(F.col("mean_correlation").alias("persistence_index")))


# -- track analytics --------------------------------------------------------

def track_quality(df: DataFrame) -> DataFrame:
    """0.4 completeness + 0.3 smoothness + 0.3 min(n / 20, 1); 0 for single points."""
    keys = track_keys(df)
    rows = with_points(df, before=2)
    vx, vy = F.col("x") - F.col("x_m1"), F.col("y") - F.col("y_m1")
    ax, ay = vx - (F.col("x_m1") - F.col("x_m2")), vy - (F.col("y_m1") - F.col("y_m2"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("frame") - F.min("frame") + 1).alias("_span"),
        F.avg(F.sqrt(ax * ax + ay * ay)).alias("_acc"), F.avg(F.sqrt(vx * vx + vy * vy)).alias("_vel"))
    smooth = F.when(F.col("_n") >= 3, 1 / (1 + F.col("_acc") / F.greatest("_vel", F.lit(1e-6)))).otherwise(0.5)
    score = (0.4 * F.col("_n") / F.greatest("_span", F.lit(1)) + 0.3 * smooth
             + 0.3 * F.least(F.col("_n") / 20.0, F.lit(1.0)))
    return agg.select(*keys, F.when(F.col("_n") < 2, 0.0).otherwise(score).alias("quality"))


def velocity_persistence(df: DataFrame) -> DataFrame:
    """Mean dot product of successive unit steps; zero steps count as 0."""
    keys = track_keys(df)
    rows = with_points(df, before=2).where("n >= 3 and idx > 0")
    vx, vy = F.col("x") - F.col("x_m1"), F.col("y") - F.col("y_m1")
    ux, uy = F.col("x_m1") - F.col("x_m2"), F.col("y_m1") - F.col("y_m2")
    nv, nu = F.sqrt(vx * vx + vy * vy), F.sqrt(ux * ux + uy * uy)
    dot = F.when((nv > 1e-12) & (nu > 1e-12), (vx * ux + vy * uy) / (nv * nu)).otherwise(0.0)
    agg = rows.groupBy(*keys).agg(F.avg(F.when(F.col("idx") > 1, dot)).alias("_p"),
                                  F.count(F.when(nv > 1e-12, 1)).alias("_valid"))
    return agg.select(*keys, F.when(F.col("_valid") < 2, 0.0).otherwise(F.col("_p")).alias("persistence"))


def step_length_stats(df: DataFrame) -> DataFrame:
    steps = lag_displacements(df)
    return attach(steps.agg(F.count("step").alias("n_steps"), F.avg("step").alias("mean_step")),
                  exact_quantiles(steps, [], "step", {"median_step": 0.5}), [])


def flower_summary(df: DataFrame) -> DataFrame:
    """Mean end point relative to the start and spread of the end distances."""
    keys = track_keys(df)
    ends = df.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "frame").alias("a"), F.max_by(F.struct("x", "y"), "frame").alias("b"))
    ends = ends.select((F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"))
    return ends.agg(F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"),
                    F.stddev_pop(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("sigma"))


def track_normalise(df: DataFrame) -> DataFrame:
    """Per-track min-max of the intensity; a flat track gives 0."""
    keys = track_keys(df)
    ext = df.groupBy(*keys).agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (attach(df, ext, keys)
            .withColumn("normalized", F.when(span > 0, (F.col("intensity") - F.col("_lo")) / span).otherwise(0.0))
            .drop("_lo", "_hi"))


def track_mean_trace(df: DataFrame) -> DataFrame:
    """Mean intensity per frame relative to the start of each track."""
    keys = track_keys(df)
    start = df.groupBy(*keys).agg(F.min("frame").alias("_f0"))
    return (attach(df, start, keys).groupBy((F.col("frame") - F.col("_f0")).alias("rel_frame"))
            .agg(F.avg("intensity").alias("mean_intensity"), F.count(F.lit(1)).alias("n_tracks")))


def track_heatmap(df: DataFrame, frames: list[int]) -> DataFrame:
    """Intensity per track (rows) and relative frame (columns)."""
    keys = track_keys(df)
    start = df.groupBy(*keys).agg(F.min("frame").alias("_f0"))
    return (attach(df, start, keys).withColumn("rel", F.col("frame") - F.col("_f0"))
            .groupBy(*keys).pivot("rel", frames).agg(F.avg("intensity")))
