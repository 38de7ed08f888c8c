"""Aggregates over stacks, traces and pixel pairs.

Statistics of a movie, frame or pixel are combinable aggregates; they return
to the rows through ``attach``, which broadcasts them only when counted small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.blocks import exact_quantiles
from pixelweave.operators.masks import roi_trace
from pixelweave.schemas import frame_keys, movie_keys, pixel_keys, val
from pixelweave.session import attach, cut_lineage



def ratio_baseline(df: DataFrame, first_frame: int, n_frames: int, kind: str = "average", black_level: float = 0.0) -> DataFrame:
    """(v - black) / baseline per pixel; a zero baseline takes the smallest
    non-zero magnitude among the movie's baselines."""
    stat = {"average": F.avg, "standard deviation": F.stddev_pop}[kind]
    keys, movie = pixel_keys(df), movie_keys(df)
    base = df.where(F.col("frame").between(first_frame, first_frame + n_frames - 1)).groupBy(*keys).agg(
        stat(val() - black_level).alias("_b"))
    least = base.groupBy(*movie).agg(F.min(F.when(F.col("_b") != 0, F.abs("_b"))).alias("_least"))
    base = attach(base, least, movie).withColumn("_b", F.when(F.col("_b") == 0, F.col("_least")).otherwise(F.col("_b"))).drop("_least")
    return attach(df, base, keys).withColumn("value", (val() - black_level) / F.col("_b")).drop("_b")


def dff_image(df: DataFrame, start: int = 0, stop: int | None = None, method: str = "mean") -> DataFrame:
    """Per-pixel dF/F; by default the baseline is the first tenth of the frames."""
    keys, movie = pixel_keys(df), movie_keys(df)
    if stop is None:
        length = df.groupBy(*movie).agg((F.max("frame") + 1).alias("_n"))
        rows = attach(df, length, movie).where(F.col("frame") < F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    else:
        rows = df.where((F.col("frame") >= start) & (F.col("frame") < stop))
    agg = F.percentile("value", F.lit(0.5)) if method == "median" else F.avg("value")
    f0 = rows.groupBy(*keys).agg(agg.alias("_f0"))
    f0 = f0.withColumn("_f0", F.when(F.abs("_f0") > 1e-12, F.col("_f0")).otherwise(1e-12))
    return attach(df, f0, keys).withColumn("value", (val() - F.col("_f0")) / F.col("_f0")).drop("_f0")


def background_stat(df: DataFrame, method: str = "Mean", per_frame: bool = True) -> DataFrame:
    """Mean, Median, Mode (3 median - 2 mean), 5th or 25th percentile per frame or movie."""
    keys = frame_keys(df) if per_frame else movie_keys(df)
    means = df.groupBy(*keys).agg(F.avg("value").alias("_mean"))
    if method == "Mean":
        return means.withColumnRenamed("_mean", "background")
    p = {"Median": 0.5, "Mode": 0.5, "5th Percentile": 0.05, "25th Percentile": 0.25}[method]
    q = exact_quantiles(df, keys, "value", {"_q": p})
    if method != "Mode":
        return q.withColumnRenamed("_q", "background")
    return q.join(means, keys).select(*keys, (3 * F.col("_q") - 2 * F.col("_mean")).alias("background"))


def background_auto_roi(df: DataFrame, width: int, height: int, stride: int, top_n: int = 10) -> DataFrame:
    """Per movie the steadiest of the top_n darkest windows of the max projection."""
    movie = movie_keys(df)
    proj = df.groupBy(*pixel_keys(df), "h", "w").agg(F.max("value").alias("value"))

    def origins(axis: str, size: str, extent: int) -> Column:
        last = F.floor((F.col(size) - extent) / stride)
        lo = F.greatest(F.ceil((F.col(axis) - extent + 1) / stride), F.lit(0))
        hi = F.least(F.floor(F.col(axis) / stride), last)
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda i: (i * stride).cast("int"))).otherwise(F.array().cast("array<int>"))

    def windows(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("wy", F.explode(origins("y", "h", height)))
                .withColumn("wx", F.explode(origins("x", "w", width))))

    means = windows(proj).groupBy(*movie, "wy", "wx").agg(F.avg("value").alias("mean_intensity"))
    dark = Window.partitionBy(*movie).orderBy("mean_intensity", "wy", "wx")
    best = means.withColumn("_r", F.row_number().over(dark)).where(F.col("_r") <= top_n).drop("_r")
    inside = attach(windows(df), best, [*movie, "wy", "wx"], "inner")
    per_frame = inside.groupBy(*movie, "wy", "wx", "mean_intensity", "frame").agg(F.avg("value").alias("_m"))
    steady = per_frame.groupBy(*movie, "wy", "wx", "mean_intensity").agg(F.stddev_pop("_m").alias("temporal_std"))
    order = Window.partitionBy(*movie).orderBy("temporal_std", "mean_intensity", "wy", "wx")
    return (steady.withColumn("_r", F.row_number().over(order)).where("_r = 1")
            .select(*movie, "wy", "wx", F.lit(width).alias("roi_w"), F.lit(height).alias("roi_h"), "mean_intensity", "temporal_std"))


def background_roi(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Subtract the mean of the ROI traces frame by frame."""
    keys = frame_keys(df)
    trace = roi_trace(df, mask).groupBy(*keys).agg(F.avg("value").alias("_bg"))
    return attach(df, trace, keys).withColumn("value", val() - F.col("_bg")).drop("_bg")


def background_subtract(df: DataFrame, method: str = "stat", stat: str = "Mean", per_frame: bool = True,
                        mask: DataFrame | None = None, roi: tuple[int, int, int, int] = (10, 10, 5, 10)) -> DataFrame:
    """Statistic ("stat"), given ROIs ("roi") or detected window ("auto")."""
    if method == "roi":
        return background_roi(df, mask)
    if method == "auto":
        width, height, stride, top_n = roi
        movie = movie_keys(df)
        found = attach(df, background_auto_roi(df, width, height, stride, top_n).select(*movie, "wy", "wx"), movie)
        inside = F.col("y").between(F.col("wy"), F.col("wy") + height - 1) & F.col("x").between(F.col("wx"), F.col("wx") + width - 1)
        bg = found.where(inside).groupBy(*frame_keys(df)).agg(F.avg("value").alias("background"))
        keys = frame_keys(df)
    else:
        bg = background_stat(df, stat, per_frame)
        keys = frame_keys(df) if per_frame else movie_keys(df)
    return attach(df, bg, keys).withColumn("value", val() - F.col("background")).drop("background")


def bleach_ratio(df: DataFrame) -> DataFrame:
    """Scale each frame to the movie mean; frames with a mean of at most 1e-10 stay."""
    keys, movie = frame_keys(df), movie_keys(df)
    frames = cut_lineage(df.groupBy(*keys).agg(F.avg("value").alias("_fm"), F.sum("value").alias("_s"), F.count("value").alias("_c")))
    whole = frames.groupBy(*movie).agg((F.sum("_s") / F.sum("_c")).alias("_gm"))
    scale = attach(frames, whole, movie).select(*keys, F.when(F.col("_fm") > 1e-10, F.col("_gm") / F.col("_fm")).otherwise(1.0).alias("_k"))
    return attach(df, scale, keys).withColumn("value", val() * F.col("_k")).drop("_k")


def bleach_histogram(df: DataFrame) -> DataFrame:
    """Match each frame's value distribution to that of frame 0.

    Distinct values carry their cumulative share; a frame's share is looked up
    in the reference distribution by linear interpolation. The reference
    breakpoints are joined per frame through a union and a running last/first,
    so no pair of values is formed.
    """
    keys, movie = frame_keys(df), movie_keys(df)
    counts = df.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("value")
    cdf = counts.withColumn("_q", F.sum("_c").over(w) / F.sum("_c").over(Window.partitionBy(*keys)))
    ref = cdf.where("frame = 0").select(*movie, F.col("value").alias("_rv"), F.col("_q").alias("_rq"))
    frames = cdf.where("frame > 0").select(*keys).distinct()
    points = attach(frames, ref, movie, "inner").select(*keys, F.lit(None).cast("double").alias("value"), F.col("_rq").alias("_q"), "_rv")
    asked = cdf.where("frame > 0").select(*keys, "value", "_q", F.lit(None).cast("double").alias("_rv"))
    order = Window.partitionBy(*keys).orderBy("_q", F.col("_rv").isNull())
    both = asked.unionByName(points)
    lo = F.last(F.when(F.col("_rv").isNotNull(), F.struct("_q", "_rv")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(F.when(F.col("_rv").isNotNull(), F.struct("_q", "_rv")), True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_lo", lo).withColumn("_hi", hi).where("value is not null")
    mapped = (F.when(F.col("_lo").isNull(), F.col("_hi._rv")).when(F.col("_hi").isNull() | (F.col("_lo._q") == F.col("_q")), F.col("_lo._rv"))
              .otherwise(F.col("_lo._rv") + (F.col("_q") - F.col("_lo._q")) / (F.col("_hi._q") - F.col("_lo._q")) * (F.col("_hi._rv") - F.col("_lo._rv"))))
    table = both.select(*keys, "value", mapped.alias("_new"))
    return (df.join(table, [*keys, "value"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new"))


def histogram_equalize(df: DataFrame, nbins: int = 256) -> DataFrame:
    """Per frame: value -> cumulative share, linear between bin centres, flat outside."""
    keys = frame_keys(df)
    ext = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # a flat frame gets the unit-wide range around its value
    ext = (ext.withColumn("_flat", F.col("_lo") == F.col("_hi"))
           .select(*keys, (F.col("_lo") - F.when(F.col("_flat"), 0.5).otherwise(0.0)).alias("_lo"),
                   (F.col("_hi") + F.when(F.col("_flat"), 0.5).otherwise(0.0)).alias("_hi")))
    rows = attach(df, ext, keys)
    width = (F.col("_hi") - F.col("_lo")) / nbins
    bin_ = F.least(F.floor((val() - F.col("_lo")) / width), F.lit(nbins - 1))
    counts = rows.groupBy(*keys, bin_.cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    cum = counts.withColumn("_cdf", F.sum("_c").over(w) / F.sum("_c").over(Window.partitionBy(*keys)))
    held = F.array_sort(F.collect_list(F.struct("_bin", "_cdf")))
    table = cum.groupBy(*keys).agg(held.alias("_held"))
    # one entry per bin: the share reached at the last occupied bin up to it
    dense = F.transform(F.sequence(F.lit(0), F.lit(nbins - 1)), lambda b: F.element_at(
        F.filter("_held", lambda e: e["_bin"] <= b), -1)["_cdf"])
    table = table.select(*keys, dense.alias("_table"))
    # position in bin-centre units, then the share at the two neighbouring centres
    pos = F.least(F.greatest((val() - F.col("_lo")) / width - 0.5, F.lit(0.0)), F.lit(float(nbins - 1)))
    k = F.floor(pos).cast("int")

    out = attach(rows, table, keys).withColumn("_k", k).withColumn("_f", pos - k)
    lo = F.get("_table", F.col("_k"))
    hi = F.get("_table", F.least(F.col("_k") + 1, F.lit(nbins - 1)))
    return out.withColumn("value", lo + (hi - lo) * F.col("_f")).drop("_lo", "_hi", "_table", "_k", "_f")


# -- histograms -------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int, keys: list[str] | None = None,
              bounds: tuple[float, float] | None = None) -> DataFrame:
    """Counts in equal bins, last edge closed; over fixed bounds or the extent of each key."""
    keys = keys or []
    c = F.col(column).cast("double")
    ok = df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if bounds is None:
        ext = ok.groupBy(*keys).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
        ok = attach(ok, ext, keys)
        flat = F.col("_lo") == F.col("_hi")
        lo, hi = F.col("_lo") - F.when(flat, 0.5).otherwise(0.0), F.col("_hi") + F.when(flat, 0.5).otherwise(0.0)
    else:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
        ok = ok.where((c >= lo) & (c <= hi))
    b = F.least(F.floor((c - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return ok.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def roi_histogram(df: DataFrame, mask: DataFrame, frame: int, bins: int) -> DataFrame:
    inside = attach(df.where(F.col("frame") == frame), mask.select("y", "x").distinct(), ["y", "x"], "left_semi")
    return histogram(inside, "value", bins, movie_keys(df))


# -- pixel pairs ------------------------------------------------------------

def _x() -> Column:
    return F.col("v1")


def _y() -> Column:
    return F.col("v2")


def pearson(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, F.corr("v1", "v2")).alias("pearson"))


def manders(pairs: DataFrame, keys: list[str], t1: float = 0.0, t2: float = 0.0) -> DataFrame:
    def share(v, cond):
        return F.when(F.sum(v) != 0, F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0)) / F.sum(v)).otherwise(0.0)

    return pairs.groupBy(*keys).agg(share(_x(), _y() > t2).alias("m1"), share(_y(), _x() > t1).alias("m2"))


def li_icq(pairs: DataFrame, keys: list[str]) -> DataFrame:
    means = pairs.groupBy(*keys).agg(F.avg("v1").alias("_m1"), F.avg("v2").alias("_m2"))
    product = (_x() - F.col("_m1")) * (_y() - F.col("_m2"))
    return attach(pairs, means, keys).groupBy(*keys).agg((F.avg((product > 0).cast("double")) - 0.5).alias("icq"))


def costes_threshold(pairs: DataFrame, keys: list[str], iterations: int = 64) -> DataFrame:
    """Regression line, then bisection for the threshold where the correlation
    of brighter pixels vanishes; all movies step together, each step one
    aggregate over the materialised pairs."""
    pairs = cut_lineage(pairs.select(*keys, "v1", "v2"))
    state = cut_lineage(pairs.groupBy(*keys).agg(
        F.regr_slope("v2", "v1").alias("slope"), F.regr_intercept("v2", "v1").alias("intercept"),
        F.min("v1").alias("lo"), F.max("v1").alias("hi"), F.min("v1").alias("best"),
        (F.max("v1") - F.min("v1")).alias("span"), F.lit(1.0).alias("best_r"), F.lit(False).alias("done")))
    for _ in range(iterations):
        live = state.where("not done").withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
        if live.isEmpty():
            break
        above = attach(pairs, live.select(*keys, "mid"), keys, "inner").where(_x() > F.col("mid")).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.corr("v1", "v2").alias("_r"))
        step = live.join(above, keys, "left")
        r = F.when((F.col("_n") >= 2) & ~F.isnan("_r"), F.col("_r"))
        better = F.coalesce(F.abs(r) < F.abs(F.col("best_r")), F.lit(False))
        lo = F.when(F.coalesce(r > 0, F.lit(False)), F.col("mid")).otherwise(F.col("lo"))
        hi = F.when(F.coalesce(r > 0, F.lit(False)), F.col("hi")).otherwise(F.col("mid"))
        moved = step.select(*keys, "slope", "intercept", lo.alias("lo"), hi.alias("hi"),
                            F.when(better, F.col("mid")).otherwise(F.col("best")).alias("best"), "span",
                            F.when(better, r).otherwise(F.col("best_r")).alias("best_r"),
                            (r.isNotNull() & ((hi - lo) < 1e-6 * (F.col("span") + 1e-12))).alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved))
    above, below = _x() > F.col("best"), _x() <= F.col("best")

    def corr(cond):
        return F.when(F.count(F.when(cond, 1)) >= 2, F.corr(F.when(cond, _x()), F.when(cond, _y())))

    return attach(pairs, state, keys).groupBy(*keys).agg(
        F.first("best").alias("threshold1"), (F.first("slope") * F.first("best") + F.first("intercept")).alias("threshold2"),
        corr(above).alias("pearson_above"), corr(below).alias("pearson_below"))


def fret_stats(df: DataFrame, keys: list[str], column: str = "e") -> DataFrame:
    ok = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    base = ok.groupBy(*keys).agg(F.avg(column).alias("mean_e"), F.stddev_pop(column).alias("std_e"), F.count(F.lit(1)).alias("n_pixels"))
    median = exact_quantiles(ok, keys, column, {"median_e": 0.5})
    return base.join(median, keys) if keys else attach(base, median, [])


def frap_normalize(traces: DataFrame, pre_frames: int, bleach_frame: int) -> DataFrame:
    """(I - min post) / (mean pre - min post); zeros when the two coincide."""
    pre = F.when(F.col("t").between(max(0, bleach_frame - pre_frames), bleach_frame - 1), val())
    stats = traces.groupBy("trace_id").agg(
        F.coalesce(F.avg(pre), F.min_by("value", "t")).alias("_pre"),
        F.coalesce(F.min(F.when(F.col("t") >= bleach_frame, val())), F.lit(0.0)).alias("_post"))
    d = F.col("_pre") - F.col("_post")
    return attach(traces, stats, ["trace_id"]).withColumn(
        "normalized", F.when(F.abs(d) < 1e-12, 0.0).otherwise((val() - F.col("_post")) / d)).drop("_pre", "_post")


# -- regions and texture ----------------------------------------------------

def region_properties(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Shape and intensity of labelled regions.

    Input rows: keys, label > 0, y, x and optionally value. The perimeter
    counts pixels with a 4-neighbour outside their region, from one aggregate
    over the pixels and their shifted copies.
    """
    rows = labels.where("label > 0")
    group = [*keys, "label"]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(int(dy == 0 and dx == 0)).alias("own"))
                      for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    cover = (rows.select(*group, "y", "x", F.inline(steps))
             .groupBy(*group, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
             .agg(F.sum("own").alias("_own"), F.count(F.lit(1)).alias("_n")))
    edge = cover.where("_own = 1").groupBy(*group).agg(F.sum((F.col("_n") < 5).cast("long")).alias("_edge"))
    intensity = [] if "value" not in labels.columns else [
        F.avg("value").alias("mean_intensity"), F.max("value").alias("max_intensity"), F.min("value").alias("min_intensity"),
        F.stddev_pop("value").alias("std_intensity"), F.sum("value").alias("total_intensity")]
    agg = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        F.min("y").alias("bbox_y0"), F.min("x").alias("bbox_x0"), F.max("y").alias("bbox_y1"), F.max("x").alias("bbox_x1"),
        F.var_samp("y").alias("_vy"), F.var_samp("x").alias("_vx"), F.covar_samp("y", "x").alias("_vxy"), *intensity)
    agg = agg.join(edge, group).withColumn("perimeter", F.when(F.col("_edge") == 0, F.col("area")).otherwise(F.col("_edge")).cast("double"))
    root = F.sqrt((F.col("_vy") - F.col("_vx")) * (F.col("_vy") - F.col("_vx")) + 4 * F.col("_vxy") * F.col("_vxy"))
    half = F.col("_vy") + F.col("_vx")
    many = F.col("area") >= 2
    box = (F.col("bbox_y1") - F.col("bbox_y0") + 1) * (F.col("bbox_x1") - F.col("bbox_x0") + 1)
    agg = (agg.withColumn("major_axis", F.when(many, 4 * F.sqrt(F.greatest((half + root) / 2, F.lit(0.0)))).otherwise(1.0))
           .withColumn("minor_axis", F.when(many, 4 * F.sqrt(F.greatest((half - root) / 2, F.lit(0.0)))).otherwise(1.0))
           .withColumn("orientation", F.when(many, 0.5 * F.atan2(2 * F.col("_vxy"), F.col("_vy") - F.col("_vx"))).otherwise(0.0)))
    share = F.col("minor_axis") / F.col("major_axis")
    return (agg.withColumn("eccentricity", F.when(F.col("major_axis") > 0, F.sqrt(F.greatest(1 - share * share, F.lit(0.0)))).otherwise(0.0))
            .withColumn("circularity", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
            .withColumn("equivalent_diameter", F.sqrt(4 * F.col("area") / math.pi))
            .withColumn("extent", F.col("area") / box).withColumn("solidity", F.col("area") / box)
            .withColumn("aspect_ratio", F.when(F.col("minor_axis") > 0, F.col("major_axis") / F.col("minor_axis")).otherwise(1.0))
            .drop("_edge", "_vy", "_vx", "_vxy"))


def roi_shape(mask: DataFrame) -> DataFrame:
    """Perimeter, eccentricity, circularity, axes and orientation per ROI."""
    rows = mask.select("roi_id", F.lit(1).alias("label"), "y", "x")
    return region_properties(rows, ["roi_id"]).select(
        "roi_id", "area", "perimeter", "eccentricity", "circularity", "major_axis", "minor_axis", "orientation")


def texture_glcm(df: DataFrame, n_bins: int = 32) -> DataFrame:
    """Texture of each frame from the co-occurrence of horizontal neighbours.

    Neighbours meet by aggregating each pixel under its own and its left
    position, and the matrix is at most n_bins^2 rows per frame.
    """
    keys = frame_keys(df)
    ext = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = attach(df, ext, keys).where(F.col("_hi") - F.col("_lo") >= 1e-12)
    q = F.least(F.floor((val() - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (n_bins - 1)), F.lit(n_bins - 1)).cast("int")
    w = Window.partitionBy(*keys, "y").orderBy("x")
    pairs = rows.withColumn("_i", q).withColumn("_j", F.lead("_i").over(w)).where("_j is not null")
    glcm = pairs.groupBy(*keys, "_i", "_j").agg(F.count(F.lit(1)).alias("_c"))
    total = glcm.groupBy(*keys).agg(F.sum("_c").alias("_t"), (F.sum(F.col("_i") * F.col("_c")) / F.sum("_c")).alias("_mi"),
                                    (F.sum(F.col("_j") * F.col("_c")) / F.sum("_c")).alias("_mj"))
    p, d = F.col("_c") / F.col("_t"), F.abs(F.col("_i") - F.col("_j"))
    di, dj = F.col("_i") - F.col("_mi"), F.col("_j") - F.col("_mj")
    agg = glcm.join(total, keys).groupBy(*keys).agg(
        F.sum(d * d * p).alias("contrast"), F.sum(d * p).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"),
        F.sum(p * p).alias("energy"), (-F.sum(p * F.log2(p))).alias("entropy"),
        F.sum(di * dj * p).alias("_cov"), F.sum(di * di * p).alias("_vi"), F.sum(dj * dj * p).alias("_vj"))
    out = agg.withColumn("correlation", F.when((F.col("_vi") > 0) & (F.col("_vj") > 0), F.col("_cov") / F.sqrt(F.col("_vi") * F.col("_vj")))).drop("_cov", "_vi", "_vj")
    flat = ext.where(F.col("_hi") - F.col("_lo") < 1e-12).select(
        *keys, *[F.lit(v).cast("double").alias(n) for n, v in (("contrast", 0), ("dissimilarity", 0), ("homogeneity", 1), ("energy", 1), ("entropy", 0), ("correlation", None))])
    return out.unionByName(flat)


def hu_moments(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Seven invariants of the binary shape of each key, from power sums."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def p(c, k):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * c
        return out

    raw = mask.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_m00"), *[
        F.avg(p(x, i) * p(y, j)).alias(f"_e{i}{j}") for i in range(4) for j in range(4 - i) if i + j])
    e = {(i, j): F.col(f"_e{i}{j}") for i in range(4) for j in range(4 - i) if i + j}
    cx, cy = e[1, 0], e[0, 1]
    mu = {
        (2, 0): e[2, 0] - cx * cx, (0, 2): e[0, 2] - cy * cy, (1, 1): e[1, 1] - cx * cy,
        (3, 0): e[3, 0] - 3 * cx * e[2, 0] + 2 * cx * cx * cx, (0, 3): e[0, 3] - 3 * cy * e[0, 2] + 2 * cy * cy * cy,
        (2, 1): e[2, 1] - 2 * cx * e[1, 1] - cy * e[2, 0] + 2 * cx * cx * cy,
        (1, 2): e[1, 2] - 2 * cy * e[1, 1] - cx * e[0, 2] + 2 * cy * cy * cx}
    rows = raw.withColumns({f"n{i}{j}": m * F.col("_m00") / F.pow("_m00", F.lit((i + j) / 2.0 + 1)) for (i, j), m in mu.items()})
    n = {k: F.col(f"n{k[0]}{k[1]}") for k in mu}
    a, b = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    c, d = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    s = n[2, 0] - n[0, 2]
    hu = [n[2, 0] + n[0, 2], s * s + 4 * n[1, 1] * n[1, 1], c * c + d * d, a * a + b * b,
          c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
          s * (a * a - b * b) + 4 * n[1, 1] * a * b,
          d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)]
    return rows.select(*keys, *[v.alias(f"hu_{i + 1}") for i, v in enumerate(hu)])


def count_summary(markers: DataFrame, categories: list[str], by_frame: bool = True) -> DataFrame:
    """Markers per category, per frame with zero fill and a total column, or overall with a total row."""
    if not by_frame:
        rolled = markers.rollup("category").agg(F.count(F.lit(1)).alias("n"))
        return rolled.select(F.coalesce("category", F.lit("Total")).alias("category"), "n")
    ext = markers.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    spine = ext.select(F.explode(F.sequence("lo", "hi")).alias("frame"))
    counts = markers.groupBy("frame").pivot("category", categories).count()
    filled = spine.join(counts, "frame", "left").na.fill(0, categories)
    return filled.withColumn("total", sum((F.col(c) for c in categories[1:]), F.col(categories[0])))
