"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Vectors are compared on the unit sphere, where a cosine c is a distance
sqrt(2 - 2c). The top of the tree comes from a bounded sample, taken farthest
first; every vector goes to the cell of its nearest centre, cells are cut into
blocks, and each block covers its vectors with nested balls of halving radius.
Pairs of cells, then of balls, are walked side by side: a pair whose centres are
further apart than both covering radii and the threshold is dropped, a pair that
is wholly closer is counted without looking at its members, other pairs go on to
the next level. Balls of one vector, of which there may be many side by side, are
bounded by a part of their components and the length of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.components import connected_components
from pixelweave.llm.text import batch_of
from pixelweave.session import attach, cut_lineage

#: Vectors the centres are chosen from, and the most centres.
SAMPLE, CENTRES = 4096, 2048
#: Vectors of a block: an eighth of all, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 1024, 1 << 16
#: Radius of the first balls of a block, and of the last; members of a ball compared at once without more levels.
WIDE, NARROW, AT_ONCE = 0.5, 1 / 32, 1 << 22
#: Components that bound the product of two vectors, with the length of the rest; entries of a product at once.
PART, ENTRIES = 16, 1 << 23
#: Room for rounding in bounds (never in the comparison itself).
ROOM = 1e-5


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def apart(cosine: np.ndarray) -> np.ndarray:
    """Distance on the unit sphere."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def farthest_first(u: np.ndarray, k: int) -> np.ndarray:
    """Places of up to ``k`` unit rows, each the farthest from those before: its starts are nets of falling radius."""
    chosen, near = [0], u @ u[0]
    while len(chosen) < min(k, len(u)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        chosen.append(i)
        near = np.maximum(near, u @ u[i])
    return np.array(chosen)


def cover(u: np.ndarray, radius: float) -> np.ndarray:
    """For each unit row the place of its centre: centres are further apart than about ``radius``, members within it."""
    u = u.astype(np.float32)
    least = np.float32(1 - radius * radius / 2)
    owner = np.full(len(u), -1, np.int64)
    centres = np.empty(0, np.int64)
    for start in range(0, len(u), 512):
        here = np.arange(start, min(start + 512, len(u)))
        if len(centres):
            near = u[here] @ u[centres].T
            best = near.argmax(axis=1)
            inside = near[np.arange(len(here)), best] >= least
            owner[here[inside]] = centres[best[inside]]
        rest = here[owner[here] < 0]
        near, new = u[rest] @ u[rest].T, []
        for i, place in enumerate(rest):
            if owner[place] < 0:
                new.append(place)
                owner[rest[(near[i] >= least) & (owner[rest] < 0)]] = place
                owner[place] = place
        centres = np.append(centres, np.array(new, np.int64))
    return owner


class Block:
    """Vectors of one block with their balls; positions are those in the block."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, owner: np.ndarray):
        self.v, self.w = vectors, weights
        self.norm = np.linalg.norm(vectors, axis=1)
        self.u = vectors / self.norm[:, None]
        self.nets: dict[tuple, list[tuple[int, np.ndarray, float]]] = {}
        self.top = self._balls(np.arange(len(vectors)), owner)

    def _balls(self, members: np.ndarray, owner: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
        """(centre, members, covering radius) for the owners, given as places among ``members``."""
        order = np.argsort(owner, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) > 0]) if len(order) else np.empty(0, np.int64)
        balls = []
        for run in np.split(order, starts[1:]):
            if len(run):
                centre, held = int(members[owner[run[0]]]), members[run]
                far = 0.0 if len(held) == 1 else float(apart(self.u[held] @ self.u[centre]).max()) + 1e-7
                balls.append((centre, held, far))
        return balls

    def within(self, ball: tuple[int, np.ndarray, float], radius: float) -> list[tuple[int, np.ndarray, float]]:
        """The balls of the next level in a ball."""
        key = ball[0], radius
        if key not in self.nets:
            self.nets[key] = self._balls(ball[1], cover(self.u[ball[1]], radius))
        return self.nets[key]

    def bound(self, places: np.ndarray) -> np.ndarray:
        """Rows whose products are at least those of the unit vectors: PART components and the length of the rest."""
        u = self.u[places]
        if u.shape[1] <= 2 * PART:
            return u.astype(np.float32)
        rest = np.linalg.norm(u[:, PART:], axis=1, keepdims=True)
        return np.concatenate([u[:, :PART], rest], axis=1).astype(np.float32)


class Traversal:
    """The linked pairs of two blocks, or of one with itself, as link counts and component labels of their vectors."""

    def __init__(self, a: Block, b: Block, threshold: float):
        self.a, self.b, self.same = a, b, a is b
        self.threshold, self.reach = threshold, float(apart(np.float64(threshold)))
        self.shift = 0 if self.same else len(a.v)
        n = len(a.v) + (0 if self.same else len(b.v))
        self.links, self.label = np.zeros(n, np.int64), np.arange(n)
        self.compared = 0

    def run(self) -> None:
        a, b = self.a.top, self.b.top
        thin_a = np.array([x[0] for x in a if len(x[1]) == 1], np.int64)
        thin_b = np.array([x[0] for x in b if len(x[1]) == 1], np.int64)
        self._thin(thin_a, thin_b)
        fat_a, fat_b = [x for x in a if len(x[1]) > 1], [x for x in b if len(x[1]) > 1]
        self._balls(fat_a, b if not self.same else [x for x in b if len(x[1]) == 1], WIDE)
        if self.same:
            self._own(fat_a, WIDE)
        else:
            self._balls([x for x in a if len(x[1]) == 1], fat_b, WIDE)

    def _own(self, balls, radius: float) -> None:
        """All pairs inside one list of balls."""
        for i, ball in enumerate(balls):
            self._balls([ball], balls[i + 1:], radius)
            members, far = ball[1], ball[2]
            if 2 * far <= self.reach - 1e-7:
                self.links[members] += self.a.w[members].sum() - self.a.w[members]
                self._unite(np.full(len(members), members[0]), members)
            elif len(members) ** 2 <= AT_ONCE or radius <= NARROW:
                self._members(members, members)
            else:
                self._own(self.a.within(ball, radius / 2), radius / 2)

    def _balls(self, left, right, radius: float) -> None:
        """Pairs of balls of two lists that have no ball in common."""
        if not left or not right:
            return
        ca, cb = np.array([x[0] for x in left]), np.array([x[0] for x in right])
        ra, rb = np.array([x[2] for x in left]), np.array([x[2] for x in right])
        step = max(1, ENTRIES // len(right))
        for s in range(0, len(left), step):
            d = apart(self.a.u[ca[s:s + step]] @ self.b.u[cb].T)
            self.compared += d.size
            for i, j in zip(*np.nonzero(d <= ra[s:s + step, None] + rb + self.reach + 1e-7), strict=True):
                x, y = left[s + i], right[j]
                if d[i, j] + x[2] + y[2] <= self.reach - 1e-7:
                    self._include(x[1], y[1])
                elif len(x[1]) * len(y[1]) <= AT_ONCE or radius <= NARROW:
                    self._members(x[1], y[1])
                else:
                    self._balls(self.a.within(x, radius / 2), self.b.within(y, radius / 2), radius / 2)

    def _include(self, x: np.ndarray, y: np.ndarray) -> None:
        self.links[x] += self.b.w[y].sum()
        self.links[self.shift + y] += self.a.w[x].sum()
        self._unite(x, np.full(len(x), self.shift + y[0]))
        self._unite(np.full(len(y), x[0]), self.shift + y)

    def _members(self, x: np.ndarray, y: np.ndarray) -> None:
        """Compare every vector of ``x`` with every one of ``y`` (both the same list: each pair once)."""
        step = max(1, ENTRIES // (4 * len(y)))
        own = x is y
        for s in range(0, len(x), step):
            i = x[s:s + step]
            j = y[s:] if own else y
            near = (self.a.v[i] @ self.b.v[j].T) / (self.a.norm[i, None] * self.b.norm[j]) >= self.threshold
            self.compared += near.size
            if own:
                near &= np.arange(len(j)) > np.arange(len(i))[:, None]
            p, q = np.nonzero(near)
            self._link(i[p], j[q])

    def _thin(self, x: np.ndarray, y: np.ndarray) -> None:
        """Balls of one vector against each other: bounded by part of their components, then compared."""
        if not len(x) or not len(y):
            return
        bx, by = self.a.bound(x), self.b.bound(y)
        floor, step = np.float32(self.threshold - ROOM), max(1, ENTRIES // len(y))
        for s in range(0, len(x), step):
            first = s if self.same else 0
            p, q = np.nonzero(bx[s:s + step] @ by[first:].T >= floor)
            self.compared += len(p)
            i, j = x[s + p], y[first + q]
            if self.same:
                later = s + p < first + q
                i, j = i[later], j[later]
            for t in range(0, len(i), 1 << 16):
                m, n = i[t:t + (1 << 16)], j[t:t + (1 << 16)]
                cosine = np.einsum("ij,ij->i", self.a.v[m], self.b.v[n]) / (self.a.norm[m] * self.b.norm[n])
                self._link(m[cosine >= self.threshold], n[cosine >= self.threshold])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            np.add.at(self.links, i, self.b.w[j])
            np.add.at(self.links, self.shift + j, self.a.w[i])
            self._unite(i, self.shift + j)

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of i and j, a label being the least position of its component."""
        while len(i):
            x, y = self.label[i], self.label[j]
            differ = x != y
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (deeper := self.label[self.label] != self.label).any():
                self.label[deeper] = self.label[self.label[deeper]]


_PACKED = pa.schema([("cell", pa.int64()), ("sub", pa.int64()), ("dim", pa.int64()), ("h", pa.binary()), ("g", pa.binary()), ("rep", pa.binary()),
                     ("w", pa.binary()), ("v", pa.binary()), ("owner", pa.binary())])
_PACKED_SQL = "cell long, sub long, dim long, h binary, g binary, rep binary, w binary, v binary, owner binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row for the vectors of a block; components travel as 32 bits where that is exact."""
    cell, sub, dim = (table.column(c)[0].as_py() for c in ("cell", "sub", "dim"))
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    owner = cover(unit(v), WIDE)
    short = v.astype(np.float32)
    body = short.tobytes() if (short == v).all() else v.tobytes()
    longs = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("h", "g", "rep", "w")]
    return pa.Table.from_pylist([dict(zip(_PACKED.names, [cell, sub, dim, *longs, body, owner.tobytes()], strict=True))], schema=_PACKED)


_FOUND = pa.schema([(c, pa.int64()) for c in ("h", "g", "n", "a", "b")])


def _traverse(threshold: float):
    """The linked vectors of one or two blocks: how many links each has in this pair, and a label of its component."""
    def block(row: dict) -> tuple[Block, dict]:
        longs = {c: np.frombuffer(row[c], np.int64) for c in ("h", "g", "rep", "w")}
        n, dim, body = len(longs["h"]), row["dim"], row["v"]
        v = np.frombuffer(body, np.float32 if len(body) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)
        return Block(v, longs["w"], np.frombuffer(row["owner"], np.int64)), longs

    def run(table: pa.Table) -> pa.Table:
        (a, at), *more = [block(r) for r in table.to_pylist()]
        b, bt = more[0] if more else (a, at)
        walk = Traversal(a, b, threshold)
        walk.run()
        every = {c: np.concatenate([at[c], bt[c]]) for c in at} if more else at
        hit = np.flatnonzero(walk.links)
        found = [every["h"][hit], every["g"][hit], walk.links[hit], every["rep"][hit], every["rep"][walk.label[hit]]]
        return pa.Table.from_batches([batch_of(_FOUND, found)])

    return run


def _placed(centres):
    """Cell and distance to its centre of every vector; lengths that the sample lacks have a cell of their own each."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("cell", pa.int64()), ("away", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centres.value
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                v = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                numbers, places = known.get(int(dim), (np.array([-1 - dim]), None))
                if places is None:
                    cell, away = np.repeat(numbers, len(v)), np.full(len(v), 2.0)
                else:
                    near = unit(v) @ places.T
                    best = near.argmax(axis=1)
                    cell, away = numbers[best], apart(near[np.arange(len(v)), best])
                yield batch_of(schema, [rows.column(0), rows.column(1), cell, away])

    return run


def _scaled(v):
    """The vector divided by its largest component, as a power of two, so that no square overflows; this is exact."""
    largest = F.array_max(F.transform(v, F.abs))
    return F.transform(v, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest))))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Vectors are linked where the cosine, in double precision, is at least
    ``threshold``; n_links counts the others that a vector is linked with, the
    component is the smallest id reachable over links, and kept marks it.
    Vectors that are null, empty, zero, or hold null or non-finite components,
    are linked with nothing, nor are vectors of different lengths. Rows of one
    id and one vector are one vector; different vectors under one id are
    compared like all and share their component. A row without an id is linked
    with nothing and kept. An empty table gives no rows. Other columns are not
    read.

    Equal vectors (by a 128-bit hash) are one, with a weight. Nothing is emitted
    per pair: a pair of blocks yields per linked vector its link count and one
    label. Blocks that no bound keeps apart are compared, so vectors that are
    spread evenly cost the square of their number in bounded products, and a
    group of mutual near copies costs no more than its blocks' products.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.filter("vec_id is not null").filter(fine)
    hashed = rows.select("vec_id", F.when(fine & F.col("vec_id").isNotNull(), F.xxhash64("v")).alias("h"), F.xxhash64(F.lit(1), F.reverse("v")).alias("g"))
    keys = valid.select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.reverse("v")).alias("g"), _scaled(F.col("v")).alias("v"))
    once = keys.groupBy("vec_id", "h", "g").agg(F.first("v").alias("v"))
    nodes = cut_lineage(once.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
                            .withColumn("dim", F.size("v").cast("long")))
    total = nodes.count()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-total // 8)))
    sample: dict[int, list] = {}
    for r in nodes.orderBy("h", "g").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r.v), []).append(r.v)
    held, centres = sum(map(len, sample.values())), {}
    for dim, found in sorted(sample.items()):
        u = unit(np.array(found))
        u = u[farthest_first(u, -(-min(CENTRES, -(-total // size)) * len(u) // held))]
        start = sum(len(n) for n, _ in centres.values())
        centres[dim] = np.arange(start, start + len(u)), u
    placed = nodes.select("h", "g", "v", "dim").mapInArrow(_placed(spark.sparkContext.broadcast(centres)), "h long, g long, cell long, away double")
    nodes = cut_lineage(nodes.join(placed, ["h", "g"]))

    cells = cut_lineage(nodes.groupBy("cell", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("far"))
                             .withColumn("subs", F.ceil(F.col("n") / size)))
    far = {r.cell: r.far for r in cells.filter("cell >= 0").collect()}  # CENTRES at most, and one for each length in the sample
    reach, pairs = float(apart(np.float64(threshold))), [(c, c) for c in far]
    for numbers, u in centres.values():
        gap = apart(u @ u.T)
        pairs += [(int(numbers[i]), int(numbers[j])) for i, j in combinations(range(len(u)), 2)
                  if numbers[i] in far and numbers[j] in far and gap[i, j] <= far[numbers[i]] + far[numbers[j]] + reach + 1e-6]
    pairs = spark.createDataFrame(pairs, "cell long, cell_2 long").unionByName(
        cells.filter("cell < 0").select("cell", F.col("cell").alias("cell_2")))

    dealt = attach(nodes, cells.select("cell", "subs"), ["cell"]).withColumn("sub", F.pmod("h", F.col("subs").cast("long")))
    blocks = cut_lineage(dealt.select("cell", "sub", "dim", "h", "g", "rep", "w", "v").groupBy("cell", "sub").applyInArrow(_pack, _PACKED_SQL))
    names = blocks.select("cell", "sub")
    both = pairs.join(names, "cell").join(names.toDF("cell_2", "sub_2"), "cell_2").filter("cell <> cell_2 or sub <= sub_2")
    both = cut_lineage(both.withColumn("pair", F.monotonically_increasing_id()))
    ends = both.select("pair", F.inline(F.array_distinct(F.array(F.struct("cell", "sub"), F.struct(F.col("cell_2").alias("cell"), F.col("sub_2").alias("sub"))))))
    sent = attach(blocks, ends, ["cell", "sub"], "inner").repartition(max(1, min(both.count(), 1 << 16)), "pair")
    found = cut_lineage(sent.groupBy("pair").applyInArrow(_traverse(threshold), "h long, g long, n long, a long, b long"))

    links = found.groupBy("h", "g").agg(F.sum("n").alias("n"))
    same = keys.join(nodes.select("h", "g", "rep"), ["h", "g"]).filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(found.select("a", "b").unionByName(same).distinct())
    counted = nodes.select("h", "g", "w").join(links, ["h", "g"], "left").select("h", "g", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    return (hashed.join(counted, ["h", "g"], "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
                  .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
                  .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
