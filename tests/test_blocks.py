"""The block-wise paths give what a single window or sort would, at tiny block sizes."""

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import blocks as B


def test_exact_quantiles_narrow_brackets(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=400), np.repeat(0.25, 300), [1e9, -1e9]])
    rows = [(g, float(v)) for g in (0, 1) for v in values * (g + 1)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.a, r.b, r.c) for r in B.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.987}, direct=20, bins=8).collect()}
    for g in (0, 1):
        np.testing.assert_allclose(got[g], np.quantile(values * (g + 1), [0.01, 0.5, 0.987]), rtol=1e-12)


def test_dense_index_halo_and_prefix(spark):
    rows = [(k, f * 3, float(f)) for k in (1, 2) for f in range(50)]
    df = spark.createDataFrame(rows, "k int, frame int, v double")
    idx = B.dense_index(df, ["k"], ["frame"], F.floor(F.col("frame") / 16))
    assert {(r.idx, r.n) for r in idx.where("k = 1").collect()} == {(i, 50) for i in range(50)}
    near = B.halo(idx, "idx", 2, 1, block=7)
    w = B.block_window(["k"], "idx")
    got = B.core(near.withColumn("p", F.lag("v", 2).over(w)).withColumn("q", F.lead("v").over(w))).where("k = 2").orderBy("idx").collect()
    assert [r.p for r in got] == [None, None] + [float(i) for i in range(48)]
    assert [r.q for r in got] == [float(i) for i in range(1, 50)] + [None]
    run = B.prefix_sum(idx, ["k"], "idx", "v", "s", block=7).where("k = 1").orderBy("idx").collect()
    np.testing.assert_allclose([r.s for r in run], np.cumsum(np.arange(50.0)))


def test_lagged_pairs_cross_blocks(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(40)], "k int, idx long, v double")
    pairs = B.lagged_pairs(df, ["k"], "idx", ["v"], F.lit(9), block=5)
    got = {(r.lag, r.a.i) for r in pairs.collect()}
    assert got == {(lag, i) for lag in range(1, 10) for i in range(40 - lag)}


def test_pad_axis_reflects_twice(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(3)], "t int, v double")
    for mode, name in (("reflect", "symmetric"), ("nearest", "edge"), ("mirror", "reflect")):
        rows = B.pad_axis(df, "t", F.lit(3), 7, 7, mode, "u").orderBy("u").collect()
        assert [r.v for r in rows] == list(np.pad(np.arange(3.0), 7, mode=name)), mode


def test_lag_sums_of_short_and_long_series(spark):
    """Lag by lag, by transforms in one block, and over many blocks, against differences of the whole series."""
    from pixelweave.operators import tracks

    rng = np.random.default_rng(22)
    series = {1: 1, 2: 2, 3: 9, 4: 600, 5: 1024, 6: 3000}
    walks = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0) + 1e3 for k, n in series.items()}
    walks[7] = np.full((40, 2), 3.5)
    df = spark.createDataFrame([(k, i, float(p[0]), float(p[1])) for k, w in walks.items() for i, p in enumerate(w)], "track_id long, frame int, x double, y double")
    got = {(r.track_id, r.lag): (r.msd, r.n_pairs) for r in tracks.msd_single(df).collect()}
    want = {(k, lag): (((w[lag:] - w[:-lag]) ** 2).sum(axis=1).mean(), len(w) - lag) for k, w in walks.items()
            for lag in range(1, min(max(len(w) // 4, 2), len(w) - 1) + 1)}
    assert got.keys() == want.keys() and all(got[k][1] == v[1] for k, v in want.items())
    assert all(abs(got[k][0] - v[0]) <= 1e-9 * v[0] for k, v in want.items())
