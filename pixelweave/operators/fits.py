"""Exponential and step-length fits by grid search over the one or two
non-linear parameters; the linear ones follow in closed form from sums.

For a fixed rate, a exp(-k t) + c is a straight line in exp(-k t). Traces of
bounded length are fitted inside a task. For longer ones every rate of a grid
adds its own set of sums to one combinable aggregate, so a fit reads its trace
once per refinement, whatever the trace length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.temporal import frame_means
from pixelweave.schemas import frame_keys, movie_keys
from pixelweave.session import attach, cut_lineage, spread

GRID = 24


#: Samples up to which a trace is fitted in one task.
SHORT = 16_384


def _grid_fit(df: DataFrame, keys: list[str], t: str, y: str, low: Column, high: Column, rounds: int = 4, falling: bool = True) -> DataFrame:
    """Least squares of y = a exp(-k t) + c: keys, k, a, c, sse, sst, n.

    ``low`` and ``high`` bound log k per key (columns of the key's extent);
    each round splits the bracket into GRID steps and keeps the best two. Without
    ``falling`` a is 0 at most: where the best line falls, the best allowed one is flat.

    Traces of up to SHORT samples meet in one task, which runs all rounds;
    longer ones are summed up rate by rate, round by round.
    """
    base = df.select(*keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y")).where("_y is not null")
    base = cut_lineage(base)
    ext = base.groupBy(*keys).agg(F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.count(F.lit(1)).alias("n")).where("n >= 3 and t1 > t0")
    bracket = cut_lineage(ext.select(*keys, "n", low.alias("_lo"), high.alias("_hi")))
    names = ("k", "a", "c", "sse", "sst")
    short = attach(base, bracket.where(F.col("n") <= SHORT).drop("n"), keys, "inner")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys).schema)
    found = spread(short, *keys).groupBy(*keys).applyInArrow(_fitted(keys, rounds, falling), f"{kinds}, {', '.join(f'{c} double' for c in names)}, n long")
    long = bracket.where(F.col("n") > SHORT).drop("n")
    if long.isEmpty():
        return cut_lineage(found)
    return cut_lineage(found.unionByName(_summed_fit(base, long, keys, rounds, falling)))


def _fitted(keys: list[str], rounds: int, falling: bool):
    """The fit of one trace (keys, _t, _y, _lo, _hi), as ``_summed_fit`` makes it."""
    def run(table: pa.Table) -> pa.Table:
        t, y = (table.column(c).to_numpy() for c in ("_t", "_y"))  # a missing time is NaN here
        low, high = (table.column(c)[0].as_py() for c in ("_lo", "_hi"))
        known = ~np.isnan(t)
        t, y = t[known], y[known]
        dy = y - y.mean()
        sst = float(dy @ dy)
        for _ in range(rounds):
            best = None
            for i in range(GRID + 1):
                k = float(np.exp(low + (high - low) * i / GRID))
                g = np.exp(-k * t)
                dg = g - g.mean()
                sxx, sxy = float(dg @ dg), float(dg @ dy)
                if sxx == 0:
                    continue
                a = sxy / sxx
                c, sse = float(y.mean() - a * g.mean()), max(sst - a * sxy, 0.0)
                if not falling and a > 0:
                    a, c, sse = 0.0, float(y.mean()), sst
                if best is None or sse < best[3]:
                    best = (k, a, c, sse, sst)
            if best is None:
                break
            step, middle = (high - low) / GRID, math.log(best[0])
            low, high = middle - step, middle + step
        rows = table.select(keys).slice(0, 1 if best else 0)
        for name, v in zip(("k", "a", "c", "sse", "sst"), best or (None,) * 5, strict=True):
            rows = rows.append_column(name, pa.array([v] if best else [], pa.float64()))
        return rows.append_column("n", pa.array([len(table)] if best else [], pa.int64()))

    return run


def _summed_fit(base: DataFrame, bracket: DataFrame, keys: list[str], rounds: int, falling: bool) -> DataFrame:
    """The fit of long traces: every rate of the grid adds its sums to one aggregate."""
    best = None
    for _ in range(rounds):
        rows = attach(base, bracket, keys, "inner")
        grid = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.struct(i.alias("i"), F.exp(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / GRID).alias("k")))
        rows = rows.select(*keys, "_t", "_y", "_lo", "_hi", F.inline(grid))
        g = F.exp(-F.col("k") * F.col("_t"))
        sums = rows.groupBy(*keys, "i", "k", "_lo", "_hi").agg(
            F.regr_slope("_y", g).alias("a"), F.regr_intercept("_y", g).alias("c"), F.regr_syy("_y", g).alias("sst"),
            F.regr_sxy("_y", g).alias("_sxy"), F.avg(g).alias("_mean"), F.count(F.lit(1)).alias("n"))
        sums = sums.withColumn("sse", F.greatest(F.col("sst") - F.col("a") * F.col("_sxy"), F.lit(0.0))).where("a is not null")
        if not falling:
            flat = F.col("a") > 0
            sums = sums.withColumns({"c": F.when(flat, F.col("c") + F.col("a") * F.col("_mean")).otherwise(F.col("c")),
                                     "sse": F.when(flat, F.col("sst")).otherwise(F.col("sse"))}).withColumn("a", F.least("a", F.lit(0.0)))
        best = cut_lineage(sums.groupBy(*keys).agg(F.min_by(F.struct("k", "a", "c", "sse", "sst", "n", "i", "_lo", "_hi"), F.struct("sse", "i")).alias("b")).select(*keys, "b.*"))
        step = (F.col("_hi") - F.col("_lo")) / GRID
        bracket = best.select(*keys, (F.ln("k") - step).alias("_lo"), (F.ln("k") + step).alias("_hi"))
    return best.select(*keys, "k", "a", "c", "sse", "sst", "n")


def _rate_bounds() -> tuple[Column, Column]:
    span = F.col("t1") - F.col("t0")
    return F.ln(0.01 / span), F.ln(5.0 * F.col("n") / span)


def _r2() -> Column:
    return F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r_squared")


def fit_exp_decay(traces: DataFrame, keys: list[str] | None = None, t: str = "t", y: str = "value") -> DataFrame:
    """a exp(-k t) + c per trace with R squared."""
    keys = keys or ["trace_id"]
    return _grid_fit(traces, keys, t, y, *_rate_bounds()).select(
        *keys, F.col("a").alias("amplitude"), F.col("k").alias("rate"), F.col("c").alias("offset"), _r2())


def fit_exp_recovery(traces: DataFrame, keys: list[str] | None = None, t: str = "t", y: str = "value") -> DataFrame:
    """A (1 - exp(-t / tau)) + c per trace; the mobile fraction is the plateau A + c.

    The same line in exp(-t / tau): A = -a, 0 at least, and the plateau is the intercept.
    """
    keys = keys or ["trace_id"]
    return _grid_fit(traces, keys, t, y, *_rate_bounds(), falling=False).select(
        *keys, (1 / F.col("k")).alias("tau"), (-F.col("a")).alias("amplitude"), (F.col("c") + F.col("a")).alias("offset"),
        F.col("c").alias("mobile_fraction"), (1 - F.col("c")).alias("immobile_fraction"), _r2())


def bleach_exponential(df: DataFrame) -> DataFrame:
    """Scale each frame by fit(0) / fit(frame), floored at 1e-10; movies that
    cannot be fitted use mean(0) / mean(frame)."""
    keys, movie = frame_keys(df), movie_keys(df)
    means = cut_lineage(frame_means(df))
    fit = fit_exp_decay(means, movie, "frame", "value")
    first = means.where("frame = 0").select(*movie, F.col("value").alias("_m0"))
    rows = attach(attach(means, fit, movie), first, movie)

    def curve(t):
        return F.greatest(F.col("amplitude") * F.exp(-F.col("rate") * t) + F.col("offset"), F.lit(1e-10))

    scale = F.coalesce(curve(F.lit(0)) / curve(F.col("frame")), F.col("_m0") / F.greatest("value", F.lit(1e-10)))
    return attach(df, rows.select(*keys, scale.alias("_k")), keys).withColumn("value", F.col("value") * F.col("_k")).drop("_k")


def _distribution(steps: DataFrame, edges: list[float], n: int) -> DataFrame:
    """(r2, f): the share of squared steps up to each edge."""
    ends = [-float("inf"), *(math.nextafter(e, math.inf) for e in edges), float("inf")]
    slots = Bucketizer(splits=ends, inputCol="r2", outputCol="i").transform(steps.select(F.col("r2").cast("double").alias("r2")).where("r2 is not null"))
    counts = {int(r["i"]): r["n"] for r in slots.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per edge
    total, rows = 0, []
    for i, e in enumerate(edges):
        total += counts.get(i, 0)
        rows.append((float(e), total / n))
    return steps.sparkSession.createDataFrame(rows, "r2 double, f double")


def cdf_diffusion(steps: DataFrame, dt: float, components: int = 1, bins: int = 500) -> DataFrame:
    """Diffusion coefficients from the distribution of squared steps ``r2``.

    The distribution is taken at ``bins`` of its own quantiles, so far steps do
    not coarsen the rest. Candidates on a log grid of D around the median, or of
    (D1 < D2) with the fraction in closed form, are scored by squared error
    there and refined around the best. Fewer than five steps give no row.
    """
    two = components == 2
    schema = "d1 double, sse double, n_steps long" + (", d2 double, f1 double, f2 double" if two else "")
    probs = [(i + 1) / bins for i in range(bins)]
    ext = steps.agg(F.percentile_approx("r2", probs, 20 * bins).alias("q"), F.percentile_approx("r2", 0.5, 10_000).alias("middle"),
                    F.avg("r2").alias("mean"), F.count("r2").alias("n")).first()
    if ext["n"] < 5 or not ext["mean"]:
        return steps.sparkSession.createDataFrame([], schema)
    curve = _distribution(steps, sorted(set(ext["q"])), ext["n"])
    guess = math.log((ext["middle"] / math.log(2) if ext["middle"] > 0 else ext["mean"]) / (4 * dt))
    lo, hi, lo2, hi2 = guess - 5, guess + 5, guess - 5, guess + 5
    best = None
    for _ in range(4):
        def axis(a, b):
            return F.explode(F.array(*[F.lit(math.exp(a + (b - a) * i / GRID)) for i in range(GRID + 1)]))

        grid = curve.select("*", axis(lo, hi).alias("d1"))
        e1 = 1 - F.exp(-F.col("r2") / (4 * F.col("d1") * dt))
        if components == 1:
            err = F.col("f") - e1
            row = grid.groupBy("d1").agg(F.sum(err * err).alias("sse")).agg(F.min_by(F.struct("d1", "sse"), "sse").alias("b")).first()["b"]
            at = (row["d1"], None)
        else:
            grid = grid.select("*", axis(lo2, hi2).alias("d2")).where("d1 < d2")
            e2 = 1 - F.exp(-F.col("r2") / (4 * F.col("d2") * dt))
            # f = w e1 + (1 - w) e2 is linear in w
            u, v = e1 - e2, F.col("f") - e2
            sums = grid.groupBy("d1", "d2").agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"))
            w = F.least(F.greatest(F.col("uv") / F.col("uu"), F.lit(0.01)), F.lit(0.99))
            sums = sums.where("uu > 0").withColumn("w", w).withColumn("sse", F.col("vv") - 2 * w * F.col("uv") + w * w * F.col("uu"))
            row = sums.agg(F.min_by(F.struct("d1", "d2", "w", "sse"), "sse").alias("b")).first()["b"]
            at = (row["d1"], row["d2"])
        s1, s2 = (hi - lo) / GRID, (hi2 - lo2) / GRID
        lo, hi = math.log(at[0]) - s1, math.log(at[0]) + s1
        if at[1]:
            lo2, hi2 = math.log(at[1]) - s2, math.log(at[1]) + s2
        best = row
    row = (best["d1"], best["sse"], ext["n"], *((best["d2"], best["w"], 1 - best["w"]) if two else ()))
    return steps.sparkSession.createDataFrame([row], schema)
