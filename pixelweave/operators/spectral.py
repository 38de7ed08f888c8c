"""Spectral unmixing on array-valued pixels (pixel_id, data)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pixelweave.functions.columns import normalize_spectrum
from pixelweave.session import attach, cut_lineage


def normalize_spectra(df: DataFrame) -> DataFrame:
    return df.withColumn("data", normalize_spectrum(F.col("data")))


def _combination(weights, data: str) -> Column:
    terms = [F.col(data)[i] * float(w) for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def non_negative(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows a >= 0 that minimise a.gram.a - 2 a.b, for the rows of ``b``, by active sets.

    A row's free components solve their normal equations; while one of them is
    negative the row steps back to the first that reaches zero and fixes it
    there, and when none is, the fixed component that would lower the cost most
    becomes free. Rows with the same free components are solved together.
    """
    n, k = b.shape
    a, free = np.zeros((n, k)), np.zeros((n, k), bool)
    small = 1e-10 * max(1.0, float(np.abs(gram).max()))
    for _ in range(30 * (k + 1)):
        slope = np.where(free, -np.inf, b - a @ gram)
        best = slope.argmax(axis=1)
        todo = np.flatnonzero(slope[np.arange(n), best] > small * np.maximum(1.0, np.abs(b).max(axis=1)))
        if not len(todo):
            break
        free[todo, best[todo]] = True
        while len(todo):
            solved = np.zeros((len(todo), k))
            patterns, which = np.unique(free[todo], axis=0, return_inverse=True)
            for i, p in enumerate(patterns):
                mine, at = which.ravel() == i, np.flatnonzero(p)
                solved[np.ix_(mine, at)] = b[todo[mine]][:, at] @ np.linalg.pinv(gram[np.ix_(at, at)])
            falls = free[todo] & (solved <= 0)
            back = falls.any(axis=1)
            a[todo[~back]] = solved[~back]
            todo, old, new, falls = todo[back], a[todo[back]], solved[back], falls[back]
            if len(todo):
                step = np.where(falls, old / np.maximum(old - new, 1e-300), np.inf).min(axis=1, keepdims=True)
                moved = old + step * (new - old)
                fixed = falls & (moved <= 1e-14 * np.maximum(1.0, np.abs(old).max(axis=1, keepdims=True)))
                fixed[np.arange(len(todo)), np.where(falls, moved, np.inf).argmin(axis=1)] = True
                free[todo] &= ~fixed
                a[todo] = np.where(free[todo], np.maximum(moved, 0.0), 0.0)
    return a


def linear_unmix(df: DataFrame, spectra, method: str = "nnls") -> DataFrame:
    """Abundances of k component spectra (rows of ``spectra``) per pixel.

    Least squares applies a constant pseudo-inverse. The non-negative optimum of
    up to six components is the best of the at most 2^k subset solutions that
    has no negative entry, a fixed expression; more components are solved by
    active sets in Arrow batches.
    """
    s = np.asarray(spectra, dtype=float)
    k = len(s)
    if method == "lstsq":
        p = np.linalg.pinv(s.T)
        return df.withColumn("abundance", F.array(*[_combination(p[i], "data") for i in range(k)]))
    gram = s @ s.T
    if k > 6:
        def solve(batches):
            for batch in batches:
                d = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                found = non_negative(gram, d @ s.T) if batch.num_rows else np.empty((0, k))
                values = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * k, k, dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1), values], names=["row", "abundance"])

        slim = df.select(F.col("data").cast("array<double>").alias("data"), F.struct(*df.columns).alias("row"))
        return slim.mapInArrow(solve, slim.select("row").schema.add("abundance", ArrayType(DoubleType()))).select("row.*", "abundance")
    df = df.withColumn("_b", F.array(*[_combination(s[i], "data") for i in range(k)]))
    options = []
    for size in range(k + 1):
        for support in combinations(range(k), size):
            if not support:
                options.append(F.struct(F.lit(0.0).alias("cost"), F.array(*[F.lit(0.0)] * k).alias("a")))
                continue
            idx = list(support)
            inv = np.linalg.pinv(gram[np.ix_(idx, idx)])
            sol = {c: sum((F.col("_b")[idx[j]] * float(inv[r, j]) for j in range(1, size)), F.col("_b")[idx[0]] * float(inv[r, 0])) for r, c in enumerate(idx)}
            ok = F.lit(True)
            for v in sol.values():
                ok = ok & (v >= 0)
            # residual of a subset solution: |d|^2 - a.b
            gain = sum((sol[c] * F.col("_b")[c] for c in idx[1:]), sol[idx[0]] * F.col("_b")[idx[0]])
            options.append(F.when(ok, F.struct((-gain).alias("cost"), F.array(*[sol.get(c, F.lit(0.0)) for c in range(k)]).alias("a"))))
    return df.withColumn("abundance", F.array_min(F.array_compact(F.array(*options)))["a"]).drop("_b")


def unmix_residual(df: DataFrame, spectra) -> DataFrame:
    """data - abundance . spectra as ``residual``."""
    s = np.asarray(spectra, dtype=float)
    parts = [F.col("data")[i] - _combination(s[:, i], "abundance") for i in range(s.shape[1])]
    return df.withColumn("residual", F.array(*parts))


def residual_rmse(df: DataFrame) -> DataFrame:
    sq = F.aggregate("residual", F.lit(0.0), lambda a, v: a + v * v)
    return df.agg(F.sqrt(F.sum(sq) / F.sum(F.size("residual"))).alias("rmse"))


def endmembers_pca(df: DataFrame, n: int = 3) -> DataFrame:
    """n most extreme non-zero pixels in the space of n principal components:
    the farthest from the centroid, then repeatedly the farthest from those
    chosen. Each pick is one max aggregate."""
    active = df.where(F.aggregate("data", F.lit(0.0), lambda a, v: a + v) > 0)
    vec = active.withColumn("_v", array_to_vector("data"))
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(vec)
    proj = cut_lineage(model.transform(vec).select("pixel_id", "data", vector_to_array("_p").alias("_p")))
    centre = proj.agg(F.array(*[F.avg(F.col("_p")[i]) for i in range(n)]).alias("_c"))

    def dist(p: Column, q) -> Column:
        return sum(((p[i] - q[i]) * (p[i] - q[i]) for i in range(1, n)), (p[0] - q[0]) * (p[0] - q[0]))

    rows = attach(proj, centre, []).withColumn("_d", dist(F.col("_p"), F.col("_c")))
    chosen = []
    for i in range(n):
        free = rows.where(~F.col("pixel_id").isin([c["pixel_id"] for c in chosen])) if chosen else rows
        best = free.agg(F.max_by(F.struct("pixel_id", "data", "_p"), F.struct("_d", -F.col("pixel_id"))).alias("b")).first()["b"]
        chosen.append(best)
        step = dist(F.col("_p"), [F.lit(float(v)) for v in best["_p"]])
        rows = rows.withColumn("_d", step if i == 0 else F.least("_d", step))
    return df.sparkSession.createDataFrame([(i, c["pixel_id"], list(c["data"])) for i, c in enumerate(chosen)], "component int, pixel_id long, data array<double>")
