"""Particle detection: candidates, background, closed-form localisation."""

from __future__ import annotations

import ast
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.columns import adu_to_photons, localization_precision
from pixelweave.operators.blocks import exact_quantiles
from pixelweave.operators.components import connected_components
from pixelweave.operators.stencil import FILTERS, Tiles, convolve2d, gaussian_derivative
from pixelweave.schemas import frame_keys, val
from pixelweave.session import attach


# -- noise and background ---------------------------------------------------

def _mad(df: DataFrame, keys: list[str]) -> DataFrame:
    """median and median absolute deviation of the value per key."""
    centre = exact_quantiles(df, keys, "value", {"median": 0.5})
    dev = attach(df, centre, keys).withColumn("value", F.abs(val() - F.col("median")))
    return centre.join(exact_quantiles(dev, keys, "value", {"mad": 0.5}), keys)


def estimate_noise(df: DataFrame) -> DataFrame:
    """1.4826 MAD of the Laplacian over sqrt(20) per frame, at least 1e-6."""
    keys = frame_keys(df)
    residual = convolve2d(df, [[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    return _mad(residual, keys).select(*keys, F.greatest(F.col("mad") * 1.4826 / math.sqrt(20.0), F.lit(1e-6)).alias("noise"))


def background_global(df: DataFrame) -> DataFrame:
    """25th percentile and 1.4826 MAD (at least 1) per frame."""
    keys = frame_keys(df)
    low = exact_quantiles(df, keys, "value", {"background": 0.25})
    return low.join(_mad(df, keys), keys).select(*keys, "background", F.greatest(F.col("mad") * 1.4826, F.lit(1.0)).alias("noise"))


def background_local(df: DataFrame, candidates: DataFrame, inner: int = 4, outer: int = 8, min_pixels: int = 8) -> DataFrame:
    """Mean and population std (at least 1) of the annulus inner <= r <= outer
    around each candidate (id, y, x); thin annuli fall back to the frame."""
    keys = frame_keys(df)
    ring = [(dy, dx) for dy in range(-outer, outer + 1) for dx in range(-outer, outer + 1) if inner ** 2 <= dy * dy + dx * dx <= outer ** 2]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ring])
    asked = candidates.select(*keys, "id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.inline(offsets))
    asked = asked.select(*keys, "id", (F.col("_y") + F.col("dy")).alias("y"), (F.col("_x") + F.col("dx")).alias("x"))
    local = asked.join(df.select(*keys, "y", "x", "value"), [*keys, "y", "x"]).groupBy(*keys, "id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    both = attach(candidates.join(local, [*keys, "id"], "left"), background_global(df), keys)
    enough = F.col("_n") >= min_pixels
    return (both.withColumn("background", F.when(enough, F.col("_m")).otherwise(F.col("background")))
            .withColumn("noise", F.when(enough, F.greatest("_s", F.lit(1.0))).otherwise(F.col("noise"))).drop("_n", "_m", "_s"))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution by bisection on erf."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def significance_test(candidates: DataFrame, alpha: float = 0.05, min_intensity: float = 0.0) -> DataFrame:
    """Keep candidates (value, background, noise) with a one-sided p below alpha."""
    z = (F.col("value") - F.col("background")) / F.col("noise")
    return candidates.where((z > normal_quantile(1 - alpha)) & (F.col("value") >= min_intensity))


# -- thresholds -------------------------------------------------------------

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: lambda a, b: F.pow(a, b)}
_STATS = {"std": F.stddev_pop, "mean": F.avg, "max": F.max, "min": F.min, "median": F.median}


def threshold_expression(expression: str | float, raw: str = "raw", filtered: str = "value") -> Column:
    """Aggregate column for expressions such as "1.5*std(Wave.F1)".

    I1 is the raw image, F1 the filtered one; std, mean, median, max, min, abs
    and sqrt are known. Anything else falls back to the std of F1.
    """
    fallback = F.stddev_pop(filtered)
    if isinstance(expression, (int, float)):
        return F.lit(float(expression))
    names = {"I1": F.col(raw), "F1": F.col(filtered)}

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1:
            known = {**_STATS, "abs": F.abs, "sqrt": F.sqrt}
            if node.func.id in known:
                return known[node.func.id](build(node.args[0]))
        raise ValueError(expression)

    try:
        return build(ast.parse(expression.replace("Wave.F1", "F1"), mode="eval").body)
    except (ValueError, SyntaxError):
        return fallback


def frame_threshold(filtered: DataFrame, expression: str | float) -> DataFrame:
    """Threshold of every frame of a table with ``raw`` and filtered ``value``."""
    return filtered.groupBy(*frame_keys(filtered)).agg(threshold_expression(expression).cast("double").alias("threshold"))


# -- candidate detectors ----------------------------------------------------

def border_filter(df: DataFrame, border: int) -> DataFrame:
    return df.where((F.col("y") >= border) & (F.col("y") < F.col("h") - border) & (F.col("x") >= border) & (F.col("x") < F.col("w") - border))


def local_max_detector(df: DataFrame, threshold: float | Column, min_distance: int = 1, border: int | None = None) -> DataFrame:
    """Pixels equal to the (2 d + 1)^2 maximum and above threshold, border removed."""
    d = min_distance
    top = Tiles(df, d, d).extreme("_top", F.max, d, d).done("_top")
    return border_filter(top.where((val() == F.col("_top")) & (val() > threshold)).drop("_top"), max(3, d) if border is None else border)


def nms_detector(df: DataFrame, threshold: float | Column, connectivity: int = 2, border: int = 3) -> DataFrame:
    """Pixels equal to the maximum of their 3 x 3 (or cross) neighbourhood and above threshold."""
    t = Tiles(df, 1, 1)
    if connectivity > 1:
        t.extreme("_top", F.max, 1, 1)
    else:
        t.put(_h=F.max("value").over(t.wx.rowsBetween(-1, 1)))
        t.put(_top=F.greatest(F.col("_h"), t.at("value", -1, t.wy), t.at("value", 1, t.wy)))
    return border_filter(t.done("_top").where((val() == F.col("_top")) & (val() > threshold)).drop("_top"), border)


def centroid_detector(df: DataFrame, threshold: float, connectivity: int = 2, min_area: int = 1, border: int = 3) -> DataFrame:
    """Intensity-weighted centroids (y, x) of the components above threshold."""
    keys = frame_keys(df)
    labels = connected_components(df.withColumn("label", (val() > threshold).cast("int")), connectivity)
    cen = labels.groupBy(*keys, "label", "h", "w").agg(
        F.count(F.lit(1)).alias("area"), F.sum("value").alias("_t"),
        F.sum(F.col("y") * val()).alias("_y"), F.sum(F.col("x") * val()).alias("_x"))
    cen = cen.where((F.col("area") >= min_area) & (F.col("_t") > 0)).select(
        *keys, "label", "area", "h", "w", (F.col("_y") / F.col("_t")).alias("y"), (F.col("_x") / F.col("_t")).alias("x"))
    return border_filter(cen, border)


def grid_detector(df: DataFrame, threshold: float, spacing: int = 10, border: int | None = None) -> DataFrame:
    b = spacing // 2 if border is None else border
    on = ((F.col("y") - b) % spacing == 0) & ((F.col("x") - b) % spacing == 0)
    return border_filter(df.where(on & (val() > threshold)), b)


def peak_local_max(df: DataFrame, min_distance: int = 1, threshold: float = 0.0, num_peaks: int | None = None) -> DataFrame:
    """Maxima of their (2 d + 1)^2 neighbourhood at least min_distance from the
    edge; of close equal peaks only the first stays, then the brightest num_peaks
    of each frame (raster order on ties)."""
    from pyspark.sql import Window

    from pixelweave.operators.spatial import range_join

    keys = frame_keys(df)
    d = min_distance
    t = Tiles(df, d, d).extreme("_top", F.max, d, d)
    peaks = border_filter(t.done("_top").where((val() == F.col("_top")) & (val() > threshold)).drop("_top"), d)
    rank = peaks.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("y").alias("py"), F.col("x").alias("px"))
    near = range_join(rank, rank, d * math.sqrt(2), keys).where(
        (F.greatest(F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y"))) <= d)
        & (F.struct("b.py", "b.px") < F.struct("a.py", "a.px")))
    later = near.select(*keys, F.col("a.py").alias("y"), F.col("a.px").alias("x")).distinct()
    peaks = peaks.join(later, [*keys, "y", "x"], "left_anti")
    if num_peaks is None:
        return peaks
    order = Window.partitionBy(*keys).orderBy(val().desc(), "y", "x")
    return peaks.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= num_peaks).drop("_r")


def blob_log(df: DataFrame, min_sigma: float = 1.0, max_sigma: float = 4.0, num_sigma: int = 4, threshold: float = 0.05) -> DataFrame:
    """Maxima over space and scale of the sigma-normalised Laplacian of Gaussian."""
    sigmas = np.linspace(min_sigma, max_sigma, num_sigma)
    reach = len(gaussian_derivative(float(sigmas[-1]), 0)) // 2
    t = Tiles(df, reach, reach)
    for i, s in enumerate(sigmas):
        g, d2 = gaussian_derivative(float(s), 0), gaussian_derivative(float(s), 2)
        t.separable("_a", d2, g).separable("_b", g, d2)
        t.put(**{f"_s{i}": -(F.col("_a") + F.col("_b")) * float(s) ** 2})
    rows = t.done(*[f"_s{i}" for i in range(num_sigma)])
    peak = Tiles(rows, 1, 1, "nearest")
    for i in range(num_sigma):
        peak.extreme(f"_t{i}", F.max, 1, 1, f"_s{i}")
    hits = []
    for i, s in enumerate(sigmas):
        near = [F.col(f"_t{j}") for j in (i - 1, i, i + 1) if 0 <= j < num_sigma]
        top = F.greatest(*near) if len(near) > 1 else near[0]
        hits.append(F.when((F.col(f"_s{i}") >= top) & (F.col(f"_s{i}") > threshold),
                           F.struct(F.lit(float(s)).alias("sigma"), F.col(f"_s{i}").alias("response"))))
    found = peak.put(_hits=F.array_compact(F.array(*hits))).done("_hits").where(F.size("_hits") > 0)
    return found.select(*frame_keys(df), "y", "x", F.inline("_hits")).withColumn("radius", F.col("sigma") * math.sqrt(2))


# -- localisation -----------------------------------------------------------

def _windows(df: DataFrame, candidates: DataFrame, size: int) -> DataFrame:
    """Pixels of the size x size window of each candidate (id, cy, cx), clipped to the image.

    Row and column indices r, c count from the clipped corner (r0, c0).
    """
    keys = frame_keys(df)
    half = size // 2
    span = F.sequence(F.lit(-half), F.lit(half))
    asked = (candidates.select(*keys, "id", F.col("y").cast("int").alias("cy"), F.col("x").cast("int").alias("cx"), F.explode(span).alias("_dy"))
             .withColumn("_dx", F.explode(span))
             .select(*keys, "id", "cy", "cx", (F.col("cy") + F.col("_dy")).alias("y"), (F.col("cx") + F.col("_dx")).alias("x")))
    hit = asked.join(df.select(*keys, "y", "x", "value", "h", "w"), [*keys, "y", "x"])
    return (hit.withColumn("r0", F.greatest(F.col("cy") - half, F.lit(0))).withColumn("c0", F.greatest(F.col("cx") - half, F.lit(0)))
            .withColumn("nr", F.least(F.col("cy") + half, F.col("h") - 1) - F.col("r0") + 1)
            .withColumn("nc", F.least(F.col("cx") + half, F.col("w") - 1) - F.col("c0") + 1)
            .withColumn("r", F.col("y") - F.col("r0")).withColumn("c", F.col("x") - F.col("c0")))


def _finish(agg: DataFrame, sigma: float, peak: bool) -> DataFrame:
    light = (F.col("_max") - F.col("background")) if peak else F.greatest(F.col("_sum") - F.col("background") * F.col("_n"), F.lit(0.0))
    return (agg.withColumn("intensity", light).withColumn("sigma_x", F.lit(sigma)).withColumn("sigma_y", F.lit(sigma)).drop("_max", "_sum", "_n"))


def _common():
    return [F.min("value").alias("background"), F.max("value").alias("_max"), F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n")]


def localize_centroid(df: DataFrame, candidates: DataFrame, size: int = 7) -> DataFrame:
    """Intensity-weighted centroid; windows whose sum is not positive are dropped."""
    keys = frame_keys(df)
    win = _windows(df, candidates, size)
    agg = win.groupBy(*keys, "id").agg(F.sum(F.col("c") * val()).alias("_x"), F.sum(F.col("r") * val()).alias("_y"),
                                       F.first("c0").alias("_c0"), F.first("r0").alias("_r0"), *_common()).where("_sum > 0")
    agg = agg.withColumn("x", F.col("_x") / F.col("_sum") + F.col("_c0")).withColumn("y", F.col("_y") / F.col("_sum") + F.col("_r0"))
    return _finish(agg, 1.0, True).drop("_x", "_y", "_c0", "_r0")


def localize_phasor(df: DataFrame, candidates: DataFrame, size: int = 7) -> DataFrame:
    """Angle of the first Fourier coefficient of the row and column sums, sign as defined there."""
    keys = frame_keys(df)
    win = _windows(df, candidates, size)
    ax, ay = -2 * math.pi * F.col("c") / F.col("nc"), -2 * math.pi * F.col("r") / F.col("nr")
    agg = win.groupBy(*keys, "id").agg(
        F.sum(val() * F.cos(ax)).alias("_xr"), F.sum(val() * F.sin(ax)).alias("_xi"), F.sum(val() * F.cos(ay)).alias("_yr"), F.sum(val() * F.sin(ay)).alias("_yi"),
        F.first("c0").alias("_c0"), F.first("r0").alias("_r0"), F.first("nc").alias("_nc"), F.first("nr").alias("_nr"), *_common())

    def turn(im, re):
        a = F.atan2(im, re)
        return F.when(a < 0, a + 2 * math.pi).otherwise(a)

    agg = (agg.withColumn("x", turn("_xi", "_xr") * F.col("_nc") / (2 * math.pi) + F.col("_c0"))
           .withColumn("y", turn("_yi", "_yr") * F.col("_nr") / (2 * math.pi) + F.col("_r0")))
    return _finish(agg, 1.5, False).drop("_xr", "_xi", "_yr", "_yi", "_c0", "_r0", "_nc", "_nr")


def localize_radial(df: DataFrame, candidates: DataFrame, size: int = 7) -> DataFrame:
    """Point of maximal radial symmetry: weighted fit of the gradient lines.

    The window of a candidate is a bounded array; diagonal differences, their
    3 x 3 mean and the five weighted sums are array expressions over it.
    """
    keys = frame_keys(df)
    win = _windows(df, candidates, size)
    per = win.groupBy(*keys, "id", "r0", "c0", "nr", "nc").agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("r") * 1000 + F.col("c")).alias("k"), "value"))).alias("_m"), *_common())
    per = per.where("nr >= 3 and nc >= 3")
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.col("nr") - 2), lambda i: F.transform(F.sequence(F.lit(0), F.col("nc") - 2), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    grid = per.select(*keys, "id", "r0", "c0", "nr", "nc", "background", "_max", "_sum", "_n", "_m", F.inline(cells))

    def at(di, dj):
        return F.element_at("_m", ((F.col("i") + di) * 1000 + F.col("j") + dj).cast("int"))

    grid = grid.withColumn("_du", at(1, 1) - at(0, 0)).withColumn("_dv", at(1, 0) - at(0, 1)).drop("_m")
    from pyspark.sql import Window

    # uniform 3 x 3 mean with reflected edges = mean over rows of means over columns
    def smooth(c, order, fixed):
        w = Window.partitionBy(*keys, "id", fixed).orderBy(order)
        return (F.coalesce(F.lag(c).over(w), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))) / 3

    wide = (F.col("nr") >= 4) & (F.col("nc") >= 4)
    for c in ("_du", "_dv"):
        grid = grid.withColumn(c, F.when(wide, smooth(c, "j", "i")).otherwise(F.col(c)))
    for c in ("_du", "_dv"):
        grid = grid.withColumn(c, F.when(wide, smooth(c, "i", "j")).otherwise(F.col(c)))
    den = F.col("_du") - F.col("_dv")
    ok = F.abs(den) > 1e-6
    m = -(F.col("_du") + F.col("_dv")) / F.when(ok, den)
    b = F.col("i") + 0.5 - m * (F.col("j") + 0.5)
    w = F.when(ok, F.col("_du") * F.col("_du") + F.col("_dv") * F.col("_dv"))
    sums = grid.groupBy(*keys, "id", "r0", "c0", "background", "_max", "_sum", "_n").agg(
        F.count(F.when(ok, 1)).alias("_ok"), F.sum(w).alias("_w"), F.sum(m * w).alias("_mw"), F.sum(m * m * w).alias("_mmw"), F.sum(b * w).alias("_bw"), F.sum(m * b * w).alias("_mbw"))
    sums = sums.where("_ok >= 3 and _w >= 1e-30")
    smw, smmw, sbw, smbw = (F.col(c) / F.col("_w") for c in ("_mw", "_mmw", "_bw", "_mbw"))
    det = smmw - smw * smw
    # every line is y = m x + b; the weighted least-squares point solves
    # smmw x - smw y + smbw = 0 and smw x - y + sbw = 0
    fit = (sums.where(F.abs(det) >= 1e-30).withColumn("x", (smw * sbw - smbw) / det + F.col("c0"))
           .withColumn("y", (smmw * sbw - smw * smbw) / det + F.col("r0")))
    return _finish(fit, 1.5, False).drop("_ok", "_w", "_mw", "_mmw", "_bw", "_mbw", "r0", "c0")


LOCALIZERS = {"centroid": localize_centroid, "phasor": localize_phasor, "radial_symmetry": localize_radial}
DETECTORS = {"local_max": local_max_detector, "nms": nms_detector, "grid": grid_detector}


def detect_particles(df: DataFrame, image_filter: str = "wavelet", filter_args: dict | None = None, detector: str = "local_max",
                     threshold: str | float = "std(Wave.F1)", localizer: str = "centroid", roi_size: int = 7, fit_radius: int = 3,
                     baseline: float = 0.0, emccd: bool = False, pixel_size: float | None = None) -> DataFrame:
    """Camera baseline, filter, per-frame threshold, candidates off the border,
    localisation in the raw window, bounds check and precision, per frame."""
    keys = frame_keys(df)
    image = df.withColumn("value", adu_to_photons(val(), baseline) if baseline else val())
    raw = image.withColumn("raw", val())
    filtered = FILTERS[image_filter](raw, **(filter_args or {}))
    rows = attach(filtered, frame_threshold(filtered, threshold), keys)
    border = max(5, int(1.5 * fit_radius))
    found = border_filter(DETECTORS[detector](rows, F.col("threshold"), border=0), border)
    raster = (F.col("frame").cast("long") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")
    candidates = found.select(*keys, raster.alias("id"), "y", "x")
    fits = LOCALIZERS[localizer](image, candidates, max(roi_size, 3))
    size = df.select(*keys, "h", "w").distinct()
    fits = attach(fits, size, keys)
    inside = (F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h"))
    fits = fits.where(inside).withColumn("uncertainty", localization_precision(
        F.col("intensity"), F.col("background"), (F.col("sigma_x") + F.col("sigma_y")) / 2, 1.0, False, emccd))
    if pixel_size is not None:
        fits = fits.withColumns({c: F.col(c) * pixel_size for c in ("x", "y", "sigma_x", "sigma_y", "uncertainty")})
    return fits.select(*keys, "id", "x", "y", "intensity", "sigma_x", "sigma_y", "background", "uncertainty")


def localization_filter(df: DataFrame, min_intensity: float | None = None, max_intensity: float | None = None,
                        min_sigma: float | None = None, max_sigma: float | None = None, max_uncertainty: float | None = None) -> DataFrame:
    """Quality gates by column name; gates on a missing column are skipped."""
    gates = [("intensity", min_intensity, operator.ge), ("intensity", max_intensity, operator.le),
             ("sigma_x", min_sigma, operator.ge), ("sigma_x", max_sigma, operator.le), ("uncertainty", max_uncertainty, operator.le)]
    for column, bound, test in gates:
        if bound is not None and column in df.columns:
            df = df.where(test(F.col(column), bound))
    return df

