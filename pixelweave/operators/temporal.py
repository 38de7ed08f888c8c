"""Filters and events along time: pixel stacks and traces.

Windows run per (pixel, time block) with a halo; padded edge frames are copies
of real ones, made while the halo is made.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelweave.operators.blocks import block_window, core, dense_index, exact_quantiles, halo, pad_axis, prefix_sum
from pixelweave.schemas import frame_keys, movie_keys, pixel_keys, val
from pixelweave.session import attach, cut_lineage



def _time_windows(df: DataFrame, before: int, after: int, mode: str, block: int = 1024):
    """Rows padded and blocked along time, and the window over them."""
    rows = df
    if mode != "none":
        keys = movie_keys(df)
        length = df.groupBy(*keys).agg((F.max("frame") + 1).alias("_frames"))
        rows = attach(df, length, keys)
    rows = pad_axis(rows, "frame", F.col("_frames"), before, after, mode, "_t") if mode != "none" else rows.withColumn("_t", F.col("frame"))
    rows = rows.withColumn("_p", F.col("_t") + before)
    return halo(rows, "_p", before, after, block), block_window(pixel_keys(df), "_p")


def _finish(rows: DataFrame) -> DataFrame:
    return core(rows.where("_t = frame")).drop("_t", "_p", "_frames")


def _filter(df: DataFrame, before: int, after: int, mode: str, make) -> DataFrame:
    rows, w = _time_windows(df, before, after, mode)
    return _finish(rows.withColumn("_new", make(w))).withColumn("value", F.col("_new")).drop("_new")


def difference_filter(df: DataFrame) -> DataFrame:
    return _filter(df, 1, 0, "none", lambda w: F.coalesce(val() - F.lag("value").over(w), F.lit(0.0)))


def boxcar_differential(df: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """v[t] - min(v[t - max_n : t - min_n]) from frame max_n on, else 0."""
    return _filter(df, max_n, 0, "none", lambda w: F.when(
        F.col("frame") >= max_n, val() - F.min("value").over(w.rowsBetween(-max_n, -(min_n + 1)))).otherwise(0.0))


def mean_filter(df: DataFrame, n: int) -> DataFrame:
    """Moving mean, edges reflected; an even window leans forward."""
    before, after = (n - 1) // 2, n // 2
    return _filter(df, before, after, "reflect", lambda w: F.avg("value").over(w.rowsBetween(-before, after)))


def variance_filter(df: DataFrame, n: int) -> DataFrame:
    """Moving variance, edges held; an even window leans back."""
    before, after = n // 2, (n - 1) // 2

    def make(w):
        frame = w.rowsBetween(-before, after)
        mean = F.avg("value").over(frame)
        return F.greatest(F.avg(val() * val()).over(frame) - mean * mean, F.lit(0.0))

    return _filter(df, before, after, "nearest", make)


def median_filter(df: DataFrame, n: int) -> DataFrame:
    if n % 2 == 0:
        raise ValueError("the median filter needs an odd number of frames")
    r = n // 2
    return _filter(df, r, r, "reflect", lambda w: F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-r, r)))


# -- flashes ----------------------------------------------------------------

def frame_means(df: DataFrame) -> DataFrame:
    return df.groupBy(*frame_keys(df)).agg(F.avg("value").alias("value"))


def flash_detect(df: DataFrame, window_size: int = 50) -> DataFrame:
    """First and last frame whose mean leaves a zero-padded moving mean by more
    than three population standard deviations; (0, 0) when there is none."""
    keys = movie_keys(df)
    means = frame_means(df)
    back, ahead = window_size // 2, (window_size - 1) // 2
    rows = halo(means, "frame", back, ahead, 4096)
    w = block_window(keys, "frame").rowsBetween(-back, ahead)
    dev = core(rows.withColumn("_dev", val() - F.sum("value").over(w) / window_size))
    stats = dev.groupBy(*keys).agg((F.stddev_pop("_dev") * 3).alias("_limit"), F.count(F.lit(1)).alias("_n"))
    hit = (F.abs(F.col("_dev")) > F.col("_limit")) & (F.col("_n") >= window_size)
    return attach(dev, stats, keys).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(hit, F.col("frame"))), F.lit(0)).alias("flash_start"),
        F.coalesce(F.max(F.when(hit, F.col("frame"))), F.lit(0)).alias("flash_end"))


def _with_flash(df: DataFrame, flashes: DataFrame) -> DataFrame:
    keys = movie_keys(df)
    last = df.groupBy(*keys).agg(F.max("frame").alias("_last"))
    return attach(df, flashes.join(last, keys), keys, "inner")


def flash_interpolate(df: DataFrame, flashes: DataFrame) -> DataFrame:
    """Blend the frames before and after each movie's flash across it."""
    rows = _with_flash(df, flashes)
    pre = F.greatest(F.col("flash_start") - 1, F.lit(0))
    post = F.least(F.col("flash_end") + 1, F.col("_last"))
    keys = pixel_keys(df)
    ends = rows.where((F.col("frame") == pre) | (F.col("frame") == post)).groupBy(*keys).agg(
        F.max(F.when(F.col("frame") == pre, val())).alias("_pre"), F.max(F.when(F.col("frame") == post, val())).alias("_post"))
    n = F.col("flash_end") - F.col("flash_start") + 1
    alpha = (F.col("frame") - F.col("flash_start") + 1) / (n + 1)
    inside = F.col("frame").between(F.col("flash_start"), F.col("flash_end"))
    whole = (pre == F.col("flash_start")) & (post == F.col("flash_end"))
    return (attach(rows, ends, keys).withColumn("value", F.when(
        inside & ~whole, alpha * F.col("_post") + (1 - alpha) * F.col("_pre")).otherwise(val()))
        .drop("_pre", "_post", "_last", "flash_start", "flash_end"))


def flash_noise_scale(df: DataFrame, flashes: DataFrame, window_size: int = 50) -> DataFrame:
    """Standardise flash frames and rescale them to the surrounding baseline."""
    rows = _with_flash(df, flashes)
    f, s, e = F.col("frame"), F.col("flash_start"), F.col("flash_end")
    inside = f.between(s, e)
    around = (f.between(s - window_size, s - 1) | f.between(e + 1, e + window_size))
    keys, fkeys = pixel_keys(df), frame_keys(df)
    baseline = rows.where(around).groupBy(*keys).agg(F.avg("value").alias("_bm"), F.stddev_pop("value").alias("_bs"))
    frames = rows.where(inside).groupBy(*fkeys).agg(F.avg("value").alias("_fm"), F.stddev_pop("value").alias("_fs"))
    out = attach(attach(rows, baseline, keys), frames, fkeys)
    scaled = F.col("_bm") + F.when(F.col("_fs") > 0, (val() - F.col("_fm")) / F.col("_fs") * F.when(F.col("_bs") == 0, 1.0).otherwise(F.col("_bs"))).otherwise(0.0)
    return (out.withColumn("value", F.when(inside & F.col("_bm").isNotNull(), scaled).otherwise(val()))
            .drop("_bm", "_bs", "_fm", "_fs", "_last", "flash_start", "flash_end"))


def flash_remover(df: DataFrame, method: str = "Linear Interpolation", flashes: DataFrame | None = None,
                  window_size: int = 50) -> DataFrame:
    """Detect (unless a (movie, flash_start, flash_end) table is given) and repair flashes.

    Movies without a detected flash are returned as they are.
    """
    if flashes is None:
        flashes = flash_detect(df, window_size)
        flashes = flashes.withColumns({k: F.when((F.col("flash_start") == 0) & (F.col("flash_end") == 0), -1).otherwise(F.col(k))
                                       for k in ("flash_start", "flash_end")})
    if method == "Linear Interpolation":
        return flash_interpolate(df, flashes)
    if method == "Noise Scaling":
        return flash_noise_scale(df, flashes, window_size)
    raise ValueError(method)


# -- spectra ----------------------------------------------------------------

def fourier_filter(df: DataFrame, frame_rate: float, low: float, high: float) -> DataFrame:
    """Keep DFT bins with low <= |f| <= high along time.

    Each pixel's series crosses the shuffle once as an array and is transformed
    in Arrow batches; series are as long as their movie has frames.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def band(series: pd.Series) -> pd.Series:
        def one(v):
            v = np.asarray(v, dtype=float)
            f = np.abs(np.fft.fftfreq(len(v), d=1.0 / frame_rate))
            spectrum = np.fft.fft(v)
            spectrum[(f < low) | (f > high)] = 0
            return np.fft.ifft(spectrum).real

        return series.map(one)

    keys = [c for c in df.columns if c not in ("frame", "value")]
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("_s"))
    moved = series.withColumn("_new", band(F.col("_s.value")))
    return moved.select(*keys, F.inline(F.arrays_zip(F.col("_s.frame").alias("frame"), F.col("_new").alias("value"))))


def _fft_udf():
    out = ArrayType(StructType([StructField("re", DoubleType()), StructField("im", DoubleType())]))

    @F.pandas_udf(out)
    def fft(re: pd.Series, im: pd.Series) -> pd.Series:
        def one(a, b):
            z = np.fft.fft(np.asarray(a, dtype=float) + 1j * np.asarray(b, dtype=float))
            return [{"re": x, "im": y} for x, y in zip(z.real, z.imag)]

        return pd.Series([one(a, b) for a, b in zip(re, im)])

    return fft


def power_spectrum(traces: DataFrame, dt: float = 1.0, direct: int = 1 << 16) -> DataFrame:
    """Squared DFT magnitude of the last 2^floor(log2 n) samples, bins 1..N/2-1.

    A long trace is split as N = N1 * N2: transforms of N1 interleaved samples,
    a twiddle, then transforms of N2, so no task holds more than about sqrt(N)
    samples once N exceeds ``direct``. N follows the longest trace, as a shared
    frequency axis needs.
    """
    n_max = traces.groupBy("trace_id").agg((F.max("t") + 1).alias("n")).agg(F.max("n")).first()[0]
    bits = int(math.floor(math.log2(n_max)))
    n = 1 << bits
    n2 = 1 if n <= direct else 1 << (bits // 2)
    n1 = n // n2
    fft = _fft_udf()
    length = traces.groupBy("trace_id").agg((F.max("t") + 1).alias("_n"))
    # a trace shorter than N is used whole, on its own shorter axis
    own_n = F.least(F.lit(n), F.col("_n"))
    rows = (attach(traces, length, ["trace_id"]).withColumn("_j", F.col("t") - (F.col("_n") - own_n)).where("_j >= 0")
            .withColumn("_short", own_n < n))
    split = F.when(F.col("_short"), 1).otherwise(n2)
    first = (rows.groupBy("trace_id", "_n", (F.col("_j") % split).alias("_n2"))
             .agg(F.array_sort(F.collect_list(F.struct("_j", "value"))).alias("_s"))
             .select("trace_id", "_n", "_n2", F.posexplode(fft(F.col("_s.value"), F.transform("_s", lambda s: F.lit(0.0)))).alias("_k1", "_z")))
    own = F.least(F.lit(n), F.col("_n"))
    angle = -2 * math.pi * F.col("_n2") * F.col("_k1") / own
    re = F.col("_z.re") * F.cos(angle) - F.col("_z.im") * F.sin(angle)
    im = F.col("_z.re") * F.sin(angle) + F.col("_z.im") * F.cos(angle)
    second = (first.select("trace_id", "_n", "_n2", "_k1", re.alias("re"), im.alias("im"))
              .groupBy("trace_id", "_n", "_k1").agg(F.array_sort(F.collect_list(F.struct("_n2", "re", "im"))).alias("_s"))
              .select("trace_id", "_n", "_k1", F.posexplode(fft(F.col("_s.re"), F.col("_s.im"))).alias("_k2", "_z")))
    k = F.col("_k1") + F.lit(n1) * F.col("_k2")
    return (second.withColumn("bin", k.cast("int")).where((F.col("bin") >= 1) & (F.col("bin") < F.floor(own / 2)))
            .select("trace_id", "bin", (F.col("bin") / (own * dt)).alias("frequency"),
                    (F.col("_z.re") * F.col("_z.re") + F.col("_z.im") * F.col("_z.im")).alias("power")))


# -- calcium ----------------------------------------------------------------

def dff_trace(traces: DataFrame, start: int | None = None, stop: int | None = None, method: str = "mean",
              percentile: float = 10.0) -> DataFrame:
    """(F - F0) / F0; F0 from frames start..stop-1, by default the first tenth."""
    key = ["trace_id"]
    if stop is None:
        length = traces.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        base = attach(traces, length, key).where(F.col("t") < F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    else:
        base = traces.where((F.col("t") >= (start or 0)) & (F.col("t") < stop))
    if method == "mean":
        f0 = base.groupBy(*key).agg(F.avg("value").alias("_f0"))
    else:
        f0 = exact_quantiles(base, key, "value", {"_f0": 0.5 if method == "median" else percentile / 100.0})
    return attach(traces, f0, key).withColumn(
        "dff", F.when(F.abs(F.col("_f0")) < 1e-12, 0.0).otherwise((val() - F.col("_f0")) / F.col("_f0"))).drop("_f0")


def calcium_events(traces: DataFrame, threshold: float = 2.0, min_duration: int = 3, min_interval: int = 5,
                   block: int = 4096) -> DataFrame:
    """Runs above threshold * baseline std with their peak, rise, decay and area.

    Runs come from block-wise start flags and a running sum. The interval rule
    looks at the last accepted run, but a gap of min_interval from the run
    before always accepts, so the sequential fold only spans clusters of runs
    closer than that.
    """
    key = ["trace_id"]
    length = traces.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_all"))
    rows = attach(traces, length, key)
    quiet = rows.where(F.col("t") < F.greatest(F.lit(3), F.floor(F.col("_n") / 10)))
    base = quiet.groupBy(*key).agg(F.stddev_pop("value").alias("_q"), F.first("_all").alias("_a"), F.first("_n").alias("_len"))
    std = F.when(F.col("_q") >= 1e-12, F.col("_q")).when(F.col("_a") >= 1e-12, F.col("_a"))
    limits = base.where(F.col("_len") >= min_duration).select(*key, (std * threshold).alias("_limit"))
    rows = attach(traces, limits, key, "inner").withColumn("_above", F.coalesce(val() > F.col("_limit"), F.lit(False)))
    marked = halo(rows, "t", 1, 0, block)
    w = block_window(key, "t")
    marked = core(marked.withColumn("_start", (F.col("_above") & ~F.coalesce(F.lag("_above").over(w), F.lit(False))).cast("int")))
    runs = prefix_sum(marked, key, "t", "_start", "_run", block).where("_above")
    events = runs.groupBy(*key, "_run").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.max("value").alias("amplitude"),
        F.max_by("t", F.struct("value", -F.col("t"))).alias("peak"), F.count(F.lit(1)).alias("duration"),
        (F.sum("value") - (F.min_by("value", "t") + F.max_by("value", "t")) / 2).alias("area"))
    events = cut_lineage(events.where(F.col("duration") >= min_duration))
    listed = halo(_listed(events), "_i", 1, 0, block)
    gap = F.col("start") - F.lag("end").over(block_window(key, "_i"))
    listed = core(listed.withColumn("_new", F.when(gap < min_interval, 0).otherwise(1)))
    events = prefix_sum(listed, key, "_i", "_new", "_cluster", block)
    fields = ["start", "peak", "end", "amplitude", "duration", "area"]
    clusters = events.groupBy(*key, "_cluster").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_e"))
    first = F.col("_e")[0]
    kept = F.aggregate(
        F.slice("_e", 2, F.greatest(F.size("_e") - 1, F.lit(1))), F.array(first),
        lambda acc, e: F.when(e["start"] - F.element_at(acc, -1)["end"] < min_interval, acc).otherwise(F.concat(acc, F.array(e))))
    return clusters.select(*key, F.inline(kept)).select(
        *key, "start", "peak", "end", "amplitude", "duration",
        (F.col("peak") - F.col("start")).alias("rise_time"), (F.col("end") - F.col("peak")).alias("decay_time"), "area")


def _listed(events: DataFrame) -> DataFrame:
    """Events numbered along their trace."""
    return dense_index(events, ["trace_id"], ["start"], F.floor(F.col("start") / F.lit(4096)), "_i", None)


def calcium_stats(events: DataFrame) -> DataFrame:
    rows = halo(_listed(cut_lineage(events)), "_i", 0, 1)
    gap = F.lead("start").over(block_window(["trace_id"], "_i")) - F.col("end")
    return core(rows.withColumn("_gap", gap)).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("amplitude").alias("mean_amplitude"),
        F.avg("duration").alias("mean_duration"), F.avg("rise_time").alias("mean_rise_time"),
        F.avg("decay_time").alias("mean_decay_time"), F.avg("area").alias("mean_area"),
        (F.count(F.lit(1)) / (F.max("end") - F.min("start") + 1)).alias("frequency"), F.avg("_gap").alias("mean_interval"))


# -- smoothing --------------------------------------------------------------

def _trace_windows(traces: DataFrame, r: int, mode: str):
    length = traces.groupBy("trace_id").agg((F.max("t") + 1).alias("_n"))
    rows = pad_axis(attach(traces, length, ["trace_id"]), "t", F.col("_n"), r, r, mode, "_t")
    rows = halo(rows.withColumn("_p", F.col("_t") + r), "_p", r, r)
    return rows, block_window(["trace_id"], "_p")


def _trace_finish(rows: DataFrame) -> DataFrame:
    return core(rows.where("_t = t")).drop("_t", "_p", "_n")


def _weighted(w, weights, column: str = "value") -> Column:
    r = len(weights) // 2
    terms = [float(c) * (F.lag(column, r - i).over(w) if i != r else F.col(column)) for i, c in enumerate(weights) if c]
    return sum(terms[1:], terms[0])


def savgol_weights(window: int, order: int, at: int | None = None) -> np.ndarray:
    """Least-squares polynomial weights evaluated at sample ``at`` of the window."""
    x = np.arange(window) - window // 2
    design = np.vander(x, order + 1, increasing=True)
    where = (window // 2 if at is None else at) - window // 2
    return np.vander([where], order + 1, increasing=True)[0] @ np.linalg.pinv(design)


def smooth_savgol(traces: DataFrame, window: int = 7, order: int = 3) -> DataFrame:
    """Savitzky-Golay smoothing; the polynomial of the end window serves the
    edges, and traces shorter than the window pass unchanged."""
    window += 1 - window % 2
    r = window // 2
    length = traces.groupBy("trace_id").agg((F.max("t") + 1).alias("_n"))
    rows = halo(attach(traces, length, ["trace_id"]), "t", window - 1, window - 1)
    w = block_window(["trace_id"], "t")

    def at(offset: int) -> Column:
        return val() if offset == 0 else (F.lag("value", -offset).over(w) if offset < 0 else F.lead("value", offset).over(w))

    def fit(position: int) -> Column:
        weights = savgol_weights(window, order, position)
        return sum((float(c) * at(i - position) for i, c in enumerate(weights)), F.lit(0.0))

    t, n = F.col("t"), F.col("_n")
    new = F.when(n < window, val())
    for p in range(r):
        new = new.when(t == p, fit(p)).when(t == n - 1 - p, fit(window - 1 - p))
    return core(rows.withColumn("_new", new.otherwise(fit(r)))).withColumn("value", F.col("_new")).drop("_new", "_n")


def smooth_median(traces: DataFrame, window: int = 5) -> DataFrame:
    window += 1 - window % 2
    r = window // 2
    rows, w = _trace_windows(traces, r, "reflect")
    return _trace_finish(rows.withColumn("_new", F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-r, r)))).withColumn("value", F.col("_new")).drop("_new")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def smooth_gaussian(traces: DataFrame, window: int = 7) -> DataFrame:
    """Gaussian of sigma = window / 6, edges reflected."""
    weights = gaussian_weights(window / 6.0)
    rows, w = _trace_windows(traces, len(weights) // 2, "reflect")
    return _trace_finish(rows.withColumn("_new", _weighted(w, weights))).withColumn("value", F.col("_new")).drop("_new")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Sorted finite values with k / n; equal values take successive steps.

    Ranks come from counts per distinct value, so ties cost one row each.
    """
    ok = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    counted = ok.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.lit(0))
    extent = counted.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.sum("_c").alias("_n"))
    chunk = F.floor((F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * 4096)
    ranked = dense_index(attach(counted, extent, []), ["_g"], ["value"], chunk, "_i", None)
    upto = prefix_sum(ranked, ["_g"], "_i", "_c", "_upto")
    step = F.explode(F.sequence(F.col("_upto") - F.col("_c") + 1, F.col("_upto")))
    return upto.select("value", "_n", step.alias("_k")).select("value", (F.col("_k") / F.col("_n")).alias("fraction"))
