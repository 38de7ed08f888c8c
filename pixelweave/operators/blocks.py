"""Ordered and exact work on groups of any size.

A window over a whole group runs in one task, so a group holding a third of the
table would too. Everything ordered therefore runs per block: a row index comes
from per-chunk counts and their running sum, neighbour access from blocks with
a halo, running totals from block totals, and exact quantiles from repeatedly
narrowed value brackets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pixelweave.session import attach, cut_lineage, spread

BLOCK = 4096


def dense_index(df: DataFrame, keys: list[str], order: list, chunk: Column,
                idx: str = "idx", total: str | None = "n") -> DataFrame:
    """0-based position of each row in its group, and the group size.

    ``chunk`` is a coarse, order-preserving function of the leading order
    column. Rows are ranked inside (group, chunk); the offset of a chunk is the
    running sum of the chunk counts before it.
    """
    chunked = df.withColumn("_chunk", chunk)
    per_group = Window.partitionBy(*keys)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_size").over(
            per_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_size").over(per_group))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (chunked.join(offsets.drop("_size"), [*keys, "_chunk"])
            .withColumn(idx, F.row_number().over(local) - F.lit(1) + F.col("_off"))
            .drop("_chunk", "_off"))


def halo(df: DataFrame, axis: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block.

    Adds ``_blk`` and ``_core``. Inside (keys, _blk) every core row sees its
    ``before`` predecessors and ``after`` successors along a dense axis.
    """
    block = max(block, before, after)
    position = F.col(axis) % F.lit(block)
    own = F.floor(F.col(axis) / F.lit(block))
    copies = [F.struct(own.alias("_blk"), F.lit(True).alias("_core"))]
    if before:
        copies.append(F.when(position >= block - before,
                             F.struct((own + 1).alias("_blk"), F.lit(False).alias("_core"))))
    if after:
        copies.append(F.when((position < after) & (own > 0),
                             F.struct((own - 1).alias("_blk"), F.lit(False).alias("_core"))))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def core(df: DataFrame) -> DataFrame:
    """Drop halo copies once the windows have run."""
    return df.where("_core").drop("_core", "_blk")


def block_window(keys: list[str], axis: str):
    return Window.partitionBy(*keys, "_blk").orderBy(axis)


def prefix_sum(df: DataFrame, keys: list[str], axis: str, value: str, out: str,
               block: int = BLOCK) -> DataFrame:
    """Inclusive running sum along a dense axis, block by block."""
    rows = df.withColumn("_blk", F.floor(F.col(axis) / F.lit(block)))
    totals = rows.groupBy(*keys, "_blk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_blk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    running = Window.partitionBy(*keys, "_blk").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(carried, [*keys, "_blk"])
            .withColumn(out, F.col("_carry") + F.sum(value).over(running)).drop("_blk", "_carry"))


def lagged_pairs(df: DataFrame, keys: list[str], idx: str, fields: list[str],
                 max_lag: Column, block: int = 256) -> DataFrame:
    """All (i, i + lag) pairs of a group for 1 <= lag <= max_lag.

    Only arrays of ``block`` points cross the shuffle: each block is joined
    with itself and the blocks max_lag can reach, and the pairs unroll inside
    the task, where the caller's aggregation combines them at once.
    """
    point = F.struct(F.col(idx).alias("i"), *[F.col(f) for f in fields])
    blocks = (df.withColumn("_limit", max_lag).withColumn("_blk", F.floor(F.col(idx) / F.lit(block)))
              .groupBy(*keys, "_blk")
              .agg(F.array_sort(F.collect_list(point)).alias("_pts"), F.max("_limit").alias("_limit")))
    reach = F.floor((F.col("_limit") + F.lit(block - 1)) / F.lit(block))
    left = blocks.select(*keys, F.col("_pts").alias("_a"), "_limit",
                         F.explode(F.sequence(F.col("_blk"), F.col("_blk") + reach)).alias("_blk"))
    right = blocks.select(*keys, "_blk", F.col("_pts").alias("_b"))
    joined = spread(left, *keys, "_blk").join(spread(right, *keys, "_blk"), [*keys, "_blk"])
    # points are dense and sorted, so the partners of a point are one slice
    first = F.col("_p.i") + 1 - F.col("_b")[0]["i"]
    low = F.greatest(first, F.lit(0)).cast("int")
    high = F.least(first + F.col("_limit") - 1, F.size("_b") - 1).cast("int")
    unrolled = (joined.select(*keys, "_limit", "_b", F.explode("_a").alias("_p"))
                .select(*keys, "_p", F.explode(F.when(high >= low, F.slice("_b", low + 1, high - low + 1))).alias("_q"))
                .withColumn("lag", F.col("_q.i") - F.col("_p.i")))
    return unrolled.select(*keys, "lag", F.col("_p").alias("a"), F.col("_q").alias("b"))


#: Points of a block of a long series, and the longest series whose lags are taken one by one.
LONG_BLOCK, SHORT = 1024, 512
_LAGS = pa.struct([("lag", pa.int64()), ("sq", pa.float64()), ("n", pa.int64())])


def _short_lags(x: np.ndarray, sizes: np.ndarray, limits: np.ndarray):
    """(row, lag, sum of squared displacements, pairs) of padded short series (row, axis, point), lag by lag."""
    for lag in range(1, int(limits.max(initial=0)) + 1):
        rows = np.flatnonzero(limits >= lag)
        if x.shape[2] > lag:
            d = ((x[rows][:, :, lag:] - x[rows][:, :, :-lag]) ** 2).sum(axis=1)
            valid = np.arange(d.shape[1]) < (sizes[rows] - lag)[:, None]
            yield rows, np.full(len(rows), lag), np.where(valid, d, 0.0).sum(axis=1), valid.sum(axis=1)


def _block_lags(a: np.ndarray, b: np.ndarray, first: int, limit: int):
    """(lag, sum, pairs) between blocks a and b (axis, point), b starting ``first`` later: one transform and prefix sums.

    |b - a|^2 is |a|^2 + |b|^2 - 2 a.b, and all products of a lag are one entry
    of a cross correlation. Both are taken from a's first point, so that the
    squares stay as small as the displacements they are for.
    """
    a, b = a - a[:, :1], b - a[:, :1]
    la, lb = a.shape[1], b.shape[1]
    size = 1 << (la + lb - 1).bit_length()
    product = np.fft.irfft((np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size)).sum(axis=0), size)
    lag = np.arange(max(1, first - la + 1), min(limit, first + lb - 1) + 1)
    k = lag - first
    low, high = np.maximum(0, -k), np.minimum(la, lb - k)
    sa, sb = (np.append(0.0, np.cumsum((v * v).sum(axis=0))) for v in (a, b))
    sq = sa[high] - sa[low] + sb[high + k] - sb[low + k] - 2 * product[k % size]
    return lag, np.maximum(sq, 0.0), high - low


def _lag_rows(batches):
    for batch in batches:
        n = batch.num_rows
        limits, first = batch.column("limit").to_numpy(), batch.column("first").to_numpy()
        series = [[batch.column(side).field(f).values.to_numpy() for f in (0, 1)] for side in ("a", "b")]
        ends = [batch.column(side).field(0).offsets.to_numpy() for side in ("a", "b")]
        sizes = np.diff(ends[0])
        out = [[] for _ in range(4)]
        short = np.flatnonzero((first == 0) & (sizes <= SHORT))
        for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes[short], 1))).astype(int)):
            rows = short[(sizes[short] <= width) & (sizes[short] > width // 2)]
            places = np.minimum(ends[0][rows][:, None] + np.arange(width), max(ends[0][-1] - 1, 0))
            x = np.stack([v[places] for v in series[0]], axis=1)
            for at, lag, sq, pairs in _short_lags(x, sizes[rows], limits[rows]):
                for c, v in zip(out, (rows[at], lag, sq, pairs), strict=True):
                    c.append(v)
        for r in np.setdiff1d(np.arange(n), short):
            a, b = (np.stack([v[e[r]:e[r + 1]] for v in s]) for s, e in zip(series, ends, strict=True))
            b = b if b.size else a  # a block with itself comes once
            lag, sq, pairs = _block_lags(a, b, int(first[r]), int(limits[r]))
            for c, v in zip(out, (np.full(len(lag), r), lag, sq, pairs), strict=True):
                c.append(v)
        row, lag, sq, pairs = (np.concatenate([np.empty(0), *c]) for c in out)
        order = np.argsort(row, kind="stable")
        lags = pa.StructArray.from_arrays([pa.array(v[order].astype(t)) for v, t in ((lag, np.int64), (sq, float), (pairs, np.int64))], fields=list(_LAGS))
        offsets = np.append(0, np.cumsum(np.bincount(row.astype(np.int64), minlength=n))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, lags)], names=["key", "lags"])


def lag_square_sums(df: DataFrame, keys: list[str], idx: str, x: str, y: str, max_lag: Column, block: int = LONG_BLOCK) -> DataFrame:
    """(keys, lag, sq, n): sum of |r(i + lag) - r(i)|^2 and the number of pairs, for 1 <= lag <= max_lag.

    Series of one block are worked on where they are gathered; blocks of longer
    ones meet the blocks their lags reach, each pair of blocks by one transform,
    so nothing grows with the number of point pairs and no task sees a series.
    """
    rows = df.withColumn("_limit", max_lag).withColumn("_blk", F.floor(F.col(idx) / F.lit(block)))
    point = F.struct(F.col(idx).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    blocks = rows.groupBy(*keys, "_blk").agg(F.array_sort(F.collect_list(point)).alias("_p"), F.max("_limit").cast("long").alias("_limit"))

    def axes(p):
        return F.struct(F.transform(p, lambda v: v["x"]).alias("x"), F.transform(p, lambda v: v["y"]).alias("y"))

    blocks = blocks.select(*keys, "_blk", "_limit", axes(F.col("_p")).alias("_p"))
    key = F.struct(*keys).alias("key")
    alone = blocks.select(key, F.col("_limit").alias("limit"), F.lit(0).cast("long").alias("first"), F.col("_p").alias("a"), F.when(F.lit(False), F.col("_p")).alias("b"))
    reach = F.floor((F.col("_limit") + F.lit(block - 1)) / F.lit(block))
    left = blocks.where(F.col("_limit") > 0).select(*keys, "_limit", F.col("_p").alias("a"), F.col("_blk").alias("_own"),
                                                   F.explode(F.sequence(F.col("_blk") + 1, F.col("_blk") + F.greatest(reach, F.lit(1)))).alias("_blk"))
    apart = left.join(blocks.where("_blk > 0").select(*keys, "_blk", F.col("_p").alias("b")), [*keys, "_blk"]).select(
        key, F.col("_limit").alias("limit"), ((F.col("_blk") - F.col("_own")) * block).alias("first"), "a", "b")
    pairs = alone.unionByName(apart)
    schema = pairs.select("key").schema.add("lags", ArrayType(StructType([StructField(n, t) for n, t in (("lag", LongType()), ("sq", DoubleType()), ("n", LongType()))])))
    return pairs.mapInArrow(_lag_rows, schema).select("key.*", F.inline("lags"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    direct: int = 200_000, bins: int = 1024, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size.

    Group sizes are counted first: when none exceeds ``direct``, the built-in
    exact percentile holds one group in memory at a time. Otherwise each needed order statistic is held as a value bracket with the count below
    it. Brackets are narrowed by histograms (bounded partial aggregates) until
    at most ``direct`` values remain in each, then the distinct values of the
    bracket are counted and ranked. Repeated values collapse in the counts.
    Null and NaN are left out. A row counts ``weight`` times, once without it.
    """
    tag = keys or ["_all"]
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    times = (F.lit(1) if weight is None else F.col(weight)).cast("long")
    base = base.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v"), times.alias("_m"))
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    largest = base.groupBy(*tag).agg(F.sum("_m").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= direct:
        result = base.groupBy(*tag).agg(*[F.percentile("_v", F.lit(float(p)), F.col("_m")).alias(name) for name, p in probs.items()])
        return result if keys else result.drop("_all")
    stats = base.groupBy(*tag).agg(F.sum("_m").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = []
    for j, p in enumerate(probs.values()):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        for side, pos in ((0, F.floor(h)), (1, F.ceil(h))):
            ranks.append(F.struct(F.lit(2 * j + side).alias("_t"), pos.cast("long").alias("_rank"),
                                  (h - F.floor(h)).alias("_frac")))
    targets = cut_lineage(stats.select(*tag, "_n", "_lo", "_hi", F.inline(F.array(*ranks)))
                          .withColumn("_below", F.lit(0).cast("long")).withColumn("_in", F.col("_n")))
    bracket = ["_t", "_rank", "_frac", "_lo", "_hi", "_below", "_in"]
    for _ in range(64):
        open_ = targets.where((F.col("_in") > direct) & (F.col("_lo") < F.col("_hi")))
        if open_.isEmpty():
            break
        span = F.col("_hi") - F.col("_lo")
        bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / span * bins), F.lit(bins - 1))
        distinct = open_.select(*tag, "_lo", "_hi").distinct()
        hist = (attach(base, distinct, tag, "inner")
                .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*tag, "_lo", "_hi", bin_.alias("_bin"))
                .agg(F.sum("_m").alias("_c"), F.min("_v").alias("_bl"), F.max("_v").alias("_bh")))
        order = Window.partitionBy(*tag, "_lo", "_hi").orderBy("_bin")
        hist = hist.withColumn("_upto", F.sum("_c").over(order))
        narrowed = (open_.join(hist, [*tag, "_lo", "_hi"])
                    .where((F.col("_below") + F.col("_upto") > F.col("_rank"))
                           & (F.col("_below") + F.col("_upto") - F.col("_c") <= F.col("_rank")))
                    .select(*tag, "_n", "_t", "_rank", "_frac", F.col("_bl").alias("_lo"), F.col("_bh").alias("_hi"),
                            (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"),
                            F.col("_c").alias("_in")))
        settled = targets.where((F.col("_in") <= direct) | (F.col("_lo") >= F.col("_hi")))
        targets = cut_lineage(settled.select(*tag, "_n", *bracket).unionByName(narrowed))
    distinct = targets.select(*tag, "_lo", "_hi", "_below").distinct()
    counted = (attach(base, distinct, tag, "inner").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
               .groupBy(*tag, "_lo", "_hi", "_below", "_v").agg(F.sum("_m").alias("_c")))
    order = Window.partitionBy(*tag, "_lo", "_hi", "_below").orderBy("_v")
    counted = counted.withColumn("_upto", F.col("_below") + F.sum("_c").over(order))
    picked = (targets.join(counted, [*tag, "_lo", "_hi", "_below"])
              .where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank"))))
    outs = []
    for j, name in enumerate(probs):
        low = F.max(F.when(F.col("_t") == 2 * j, F.col("_v")))
        high = F.max(F.when(F.col("_t") == 2 * j + 1, F.col("_v")))
        frac = F.max(F.when(F.col("_t") == 2 * j, F.col("_frac")))
        outs.append((low + (high - low) * frac).alias(name))
    result = picked.groupBy(*tag).agg(*outs)
    return result if keys else result.drop("_all")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def pad_axis(df: DataFrame, axis: str, size: Column, before: int, after: int, mode: str, out: str) -> DataFrame:
    """Extend a dense axis 0..size-1 at both ends by copies of existing rows.

    ``out`` holds the position, running from -before to size - 1 + after;
    the original rows keep their own. Modes: "reflect" (d c b a | a b c d),
    "nearest" (a a a a | a b c d), "mirror" (d c b | a b c d), "none".
    """
    if mode == "none" or not (before or after):
        return df.withColumn(out, F.col(axis))
    t, n = F.col(axis), size
    if mode == "nearest":
        def run(lo, hi):
            return F.when(hi >= lo, F.sequence(lo, hi))

        low = F.when(t == 0, F.sequence(F.lit(-before), F.lit(-1))) if before else F.lit(None)
        high = F.when(t == n - 1, F.sequence(n, n - 1 + after)) if after else F.lit(None)
        none = F.array().cast("array<int>")
        targets = F.concat(F.array(t.cast("int")), F.coalesce(low.cast("array<int>"), none), F.coalesce(high.cast("array<int>"), none))
    else:
        period, shift = (2 * n, 1) if mode == "reflect" else (F.greatest(2 * n - 2, F.lit(1)), 0)
        turns = (F.ceil(F.lit(float(max(before, after))) / period) + 1).cast("int")
        images = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(
            (m * period + t).cast("int"), (m * period - shift - t).cast("int"))))
        images = F.array_distinct(F.filter(images, lambda u: (u >= -before) & (u < n + after)))
        edge = (t <= before) | (t >= n - 1 - after)
        targets = F.when(edge, images).otherwise(F.array(t.cast("int")))
    return df.select("*", F.explode(targets).alias(out))
