"""Centroid clustering of integer vectors: every round a vantage-point tree over the centroids is rebuilt and broadcast.

A node of the tree keeps one centroid as its vantage point and, for the
centroids nearer to it than the median and for the rest, the least and largest
distance. A vector opens nodes in the order of its own lower bounds (best first)
and stops once the least bound is above its best distance; equal bounds are
opened, so the smaller number wins a tie. All distances are exact integers. The
searches of a batch run side by side: each step opens one node for each vector
that is still searching.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.text import batch_of
from pixelweave.session import cut_lineage

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components below this in size are squared and summed exactly in 64 bits; larger ones as Python integers.
NARROW = 1 << 27
#: Relative room for the rounding of square roots, so that no bound is too large.
SLACK = 1e-9
LONG = 1 << 63
#: Base in which sums travel.
LIMB = 10**18


@dataclass
class Node:
    """A vantage point (place of a centroid), and per child its number, least and largest distance to the point."""

    point: int
    children: list[tuple[int, float, float]]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to a point."""
    d = rows - point
    return (d * d).sum(axis=1)


def roots(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64))


def vantage_tree(centroids: np.ndarray) -> list[Node]:
    """The nodes of a vantage-point tree, the root first; the smallest number of a node is its vantage point."""
    nodes: list[Node] = []

    def build(places: np.ndarray) -> int:
        number = len(nodes)
        nodes.append(Node(int(places[0]), []))
        rest = places[1:]
        if len(rest):
            far = roots(squared(centroids[rest], centroids[places[0]]))
            order = np.argsort(far, kind="stable")
            half = (len(rest) + 1) // 2
            for part in (order[:half], order[half:]):
                if len(part):
                    low, high = float(far[part].min()), float(far[part].max())
                    nodes[number].children.append((build(np.sort(rest[part])), low * (1 - SLACK), high * (1 + SLACK)))
        return number

    build(np.arange(len(centroids)))
    return nodes


def nearest(rows: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the squared distance, and how many distances were taken."""
    n = len(rows)
    bounds = np.full((n, len(nodes)), np.inf)  # of nodes that are reached and not opened yet
    bounds[:, 0] = 0.0
    best = np.zeros(n, dtype=rows.dtype)
    cluster, taken = np.full(n, -1), np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        turn = bounds[live].argmin(axis=1)
        least = bounds[live, turn]
        reach = np.where(cluster[live] < 0, np.inf, roots(best[live]) * (1 + SLACK))
        on = np.isfinite(least) & (least <= reach)
        live, turn = live[on], turn[on]
        for number in np.unique(turn):
            who = live[turn == number]
            node, held = nodes[number], bounds[who, number]
            bounds[who, number] = np.inf
            d = squared(rows[who], centroids[node.point])
            taken[who] += 1
            better = (cluster[who] < 0) | (d < best[who]) | ((d == best[who]) & (node.point < cluster[who]))
            best[who[better]], cluster[who[better]] = d[better], node.point
            away = roots(d)
            for child, low, high in node.children:
                bounds[who, child] = np.maximum(held, np.maximum(away * (1 - SLACK) - high, low - away * (1 + SLACK)))
    return cluster, best, taken


def _integers(vectors: list, scale: int) -> list[list[int]]:
    """floor(scale * x) as Python integers; where the product overflows a double, x is whole and the integers are multiplied."""
    return [[int(np.floor(x * scale)) if np.isfinite(x * scale) else int(x) * scale for x in v] for v in vectors]


def _rows_of(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The floored rows as doubles, and which of them are below NARROW throughout."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        floored = np.floor(flat * scale)
    return floored, (np.abs(floored) < NARROW).all(axis=1)


def _batches(batches: Iterator[pa.RecordBatch], scale: int):
    """Runs of rows of one kind: batch, row numbers in it, and the rows as int64 or as Python integers."""
    for batch in batches:
        if batch.num_rows:
            values, narrow = _rows_of(batch.column(1), scale)
            yield batch, np.flatnonzero(narrow), values[narrow].astype(np.int64)
            wide = np.flatnonzero(~narrow)
            if len(wide):
                yield batch, wide, np.array(_integers(batch.column(1).take(pa.array(wide)).to_pylist(), scale), dtype=object)


def direct(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``nearest``, with every distance taken: for Python integers, whose roots need not fit a double."""
    every = np.stack([squared(rows, c) for c in centroids.astype(object)], axis=1)
    cluster = np.array([min(range(len(d)), key=d.__getitem__) for d in every], dtype=np.int64)
    return cluster, every[np.arange(len(rows)), cluster], np.full(len(rows), len(centroids))


def _placed(rows: np.ndarray, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centroids, nodes = shared.value
    if rows.dtype == object or nodes is None:
        return direct(rows.astype(object), centroids)
    return nearest(rows, centroids, nodes)


def limbs(value: int) -> list[int]:
    """Digits of an integer in base LIMB, lowest first, each with its sign."""
    out, rest = [], abs(value)
    while rest or not out:
        rest, low = divmod(rest, LIMB)
        out.append(low if value >= 0 else -low)
    return out


def _sums(shared, scale: int):
    """One row per task, centroid, component and limb; component -1 is the count."""
    schema = pa.schema([("cluster", pa.int32()), ("i", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = shared.value
        totals = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=object)
        for _, _, rows in _batches(batches, scale):
            cluster, _, _ = _placed(rows, shared)
            for c in np.unique(cluster):
                totals[c, :-1] += rows[cluster == c].sum(axis=0).astype(object)
                totals[c, -1] += int((cluster == c).sum())
        out = [(c, i if i < centroids.shape[1] else -1, j, s) for c, t in enumerate(totals) if t[-1]
               for i, v in enumerate(t) for j, s in enumerate(limbs(int(v)))]
        yield batch_of(schema, list(zip(*out, strict=True)) or [[]] * 4)

    return run


def _assigned(shared, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("taken", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, rows in _batches(batches, scale):
            cluster, best, taken = _placed(rows, shared)
            distance = [int(v) if v < LONG else None for v in best]
            yield batch_of(schema, [batch.column(0).take(pa.array(places)), cluster, distance, taken])

    return run


def _tree_of(centroids: list[list[int]]) -> tuple[np.ndarray, list[Node] | None]:
    if any(abs(v) >= NARROW for c in centroids for v in c):
        return np.array(centroids, dtype=object), None
    array = np.array(centroids, dtype=np.int64)
    return array, vantage_tree(array)


def cluster(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances``: one row per vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a
    component x becomes floor(scale * x). The ``k`` kept ids with the smallest
    sha256 of ``seed:id`` start, in that order; rows that share an id are
    vectors of their own, and of equal digests the least vector comes first.
    With fewer vectors there are fewer centroids, an empty table gives no rows.
    A row without an id is clustered but never starts.

    Each of ``rounds`` rounds broadcasts k centroids and their tree and adds up
    exact sums, one row per task, centroid and component before the shuffle; k
    times ``dim`` of them reach the driver. Integers of 2^27 or more in size are
    compared with every centroid as Python integers, without the tree.
    A new centroid is the floor of the mean; one that no vector chose stays. A
    squared distance beyond 2^63 - 1 is null and not in the inertias.
    n_distances counts the distances a vector took in the last pass. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
                   .filter((F.size(x) == dim) & whole))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, n_distances long")
    centroids = _integers([r.v for r in first], scale)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(_tree_of(centroids))
        parts = kept.mapInArrow(_sums(shared, scale), "cluster int, i int, limb int, s long")
        found: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect():
            found[r.cluster, r.i] = found.get((r.cluster, r.i), 0) + int(r.s) * LIMB**r.limb
        for (c, i), total in found.items():
            if i >= 0:
                centroids[c][i] = total // found[c, -1]
    shared = spark.sparkContext.broadcast(_tree_of(centroids))
    placed = cut_lineage(kept.mapInArrow(_assigned(shared, scale), "vec_id long, cluster int, distance long, taken long"))
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    inertia = placed.groupBy("cluster").agg(F.coalesce(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(0)).alias("own"))
    every = inertia.agg(F.sum("own")).first()[0]
    side = inertia.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return placed.join(F.broadcast(side), "cluster").select(
        "vec_id", "cluster", "distance", F.col("own").cast("long").alias("cluster_inertia"), F.lit(every).cast("long").alias("inertia"),
        "centroid_sha256", F.col("taken").alias("n_distances"))
