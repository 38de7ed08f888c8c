"""Gaussian density of points at the points themselves, without pairs.

The kernel is a product of one function of x and one of y, smooth at the scale
of its radius. So the points of a square cell one radius wide act on everything
like weights on a fixed grid of Chebyshev nodes in that cell, and what a cell
feels is a polynomial through its own nodes. A cell costs the same for three
points and for a third of the table: its weights are summed once, in pieces,
and only weights travel between cells. The interpolation is exact to about
1e-13 of the weight nearby; what lies over six radii away (1e-16) is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.session import attach, cut_lineage

#: Nodes of a cell along one axis, cells that a cell acts on to each side, and cells of a block along one axis.
NODES, REACH, BLOCK = 16, 6, 16
#: Positions up to which a cell travels as points, which are then fewer numbers than its weights.
FEW = (NODES * NODES - 1) // 3
#: About how many positions of a crowded cell make one row.
CHUNK = 512

_NODE = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) / 2
_AT_NODES = np.cos(np.arange(NODES) * np.arccos(2 * _NODE)[:, None]) * np.where(np.arange(NODES) == 0, 1.0, 2.0) / NODES


def _basis(place: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of the nodes (columns) at places in cell widths from the middle of the cell (rows)."""
    return np.cos(np.arange(NODES) * np.arccos(np.clip(2 * place, -1, 1))[:, None]) @ _AT_NODES.T


def _bases(points: np.ndarray, cx, cy, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Polynomials in x and in y at rows (x, y, weight) of the cells cx, cy."""
    return _basis(points[:, 0] / radius - cx - 0.5), _basis(points[:, 1] / radius - cy - 0.5)


def _weights(points: np.ndarray, cx, cy, radius: float) -> np.ndarray:
    bx, by = _bases(points, cx, cy, radius)
    return bx.T @ (points[:, 2:] * by)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _double_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0)])))


_CELL = "cx bigint, cy bigint, packed array<double>"
_FELT = "cx bigint, cy bigint, x array<double>, y array<double>, felt array<double>"


def _cell_weights(radius: float, held: int = 4096):
    """Summed weights of crowded cells: at most ``held`` cells wait in a task, each goes out once in most tasks."""
    def packed(sums: dict) -> pa.RecordBatch:
        places = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in places], pa.int64()) for i in (0, 1)] + [_double_lists([w.ravel() for w in sums.values()])], names=["cx", "cy", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for cx, cy, row in zip(batch["cx"].to_numpy(), batch["cy"].to_numpy(), _lists(batch["packed"]), strict=True):
                got = _weights(row.reshape(-1, 3), cx, cy, radius)
                sums[cx, cy] = sums[cx, cy] + got if (cx, cy) in sums else got
                if len(sums) > held:
                    yield packed(sums)
                    sums = {}
        if sums:
            yield packed(sums)

    return run


def _block(radius: float):
    """What the cells of one block feel: density at each point of a sparse cell, the polynomial's node values of a crowded one."""
    def kernel(to: np.ndarray, source: np.ndarray) -> np.ndarray:
        a, b = ((v[:, None] - to[0] + _NODE).ravel() for v in (to, source))
        return np.exp(-np.square(a[:, None] - b))

    def run(table: pa.Table) -> pa.Table:
        bx, by = (table.column(c)[0].as_py() for c in ("bx", "by"))
        cx, cy = (table.column(c).to_numpy() for c in ("cx", "cy"))
        rows = _lists(table.column("packed").combine_chunks())
        inside = (cx // BLOCK == bx) & (cy // BLOCK == by)
        sx, ix = np.unique(cx, return_inverse=True)
        sy, iy = np.unique(cy, return_inverse=True)
        field = np.zeros((len(sx), NODES, len(sy), NODES))
        for k, row in enumerate(rows):
            field[ix[k], :, iy[k], :] += row.reshape(NODES, NODES) if len(row) == NODES * NODES else _weights(row.reshape(-1, 3), cx[k], cy[k], radius)
        tx, ty = np.unique(cx[inside]), np.unique(cy[inside])
        felt = kernel(tx, sx) @ field.reshape(len(sx) * NODES, -1) @ kernel(ty, sy).T if len(tx) else np.empty((0, 0))
        felt = felt.reshape(len(tx), NODES, len(ty), NODES)
        out: dict = {}
        for k in np.flatnonzero(inside):
            place = int(cx[k]), int(cy[k])
            here = felt[np.searchsorted(tx, cx[k]), :, np.searchsorted(ty, cy[k]), :]
            if len(rows[k]) == NODES * NODES:
                out[place] = (np.empty(0), np.empty(0), here.ravel())
            else:
                points = rows[k].reshape(-1, 3)
                px, py = _bases(points, *place, radius)
                out[place] = (points[:, 0], points[:, 1], np.sum((px @ here) * py, axis=1))
        return pa.Table.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)] + [_double_lists([v[i] for v in out.values()]) for i in range(3)], names=["cx", "cy", "x", "y", "felt"])

    return run


def _at_points(radius: float):
    """Density at the points of crowded cells, from the node values of their cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cx, cy, row, here in zip(batch["cx"].to_numpy(), batch["cy"].to_numpy(), _lists(batch["packed"]), _lists(batch["felt"]), strict=True):
                points = row.reshape(-1, 3)
                px, py = _bases(points, cx, cy, radius)
                out.append(np.column_stack([points[:, :2], np.sum((px @ here.reshape(NODES, NODES)) * py, axis=1)]))
            x, y, rho = np.concatenate([*out, np.empty((0, 3))]).T
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(rho)], names=["x", "y", "density"])

    return run


def gaussian_density(positions: DataFrame, radius: float) -> DataFrame:
    """(x, y, density) of distinct positions (x, y, m): the sum of m * exp(-(d / radius)^2) over all positions, itself included.

    Positions without finite coordinates have no row and no weight; an empty table gives none.

    Positions are gathered by cell into rows of about CHUNK, crowded cells are
    reduced to their weights, blocks of cells with a rim of REACH exchange
    weights, and the node values go back to the rows of crowded cells. A block
    holds at most (BLOCK + 2 REACH)^2 cells, whatever is in them.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    pos = positions.where(finite).select("x", "y", F.col("m").cast("double").alias("m"), *[F.floor(F.col(a) / radius).alias(c) for a, c in (("x", "cx"), ("y", "cy"))])
    sizes = pos.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    piece = F.pmod(F.xxhash64("x", "y"), F.when(F.col("n") > FEW, F.ceil(F.col("n") / CHUNK)).otherwise(1))
    rows = attach(pos, sizes, ["cx", "cy"]).groupBy("cx", "cy", (F.col("n") > FEW).alias("crowded"), piece.alias("_piece")).agg(F.sort_array(F.collect_list(F.struct("x", "y", "m"))).alias("p"))
    rows = cut_lineage(rows.select("cx", "cy", "crowded", F.flatten(F.transform("p", lambda p: F.array(p.x, p.y, p.m))).alias("packed")))
    crowded = rows.where("crowded").select("cx", "cy", "packed")
    cells = rows.where("not crowded").select("cx", "cy", "packed").unionByName(crowded.mapInArrow(_cell_weights(radius), _CELL))
    for axis, block in (("cx", "bx"), ("cy", "by")):
        touched = F.sequence(F.floor((F.col(axis) - REACH) / BLOCK), F.floor((F.col(axis) + REACH) / BLOCK))
        cells = cells.select("*", F.explode(touched).alias(block))
    felt = cut_lineage(cells.groupBy("bx", "by").applyInArrow(_block(radius), _FELT))
    sparse = felt.where(F.size("x") > 0).select(F.inline(F.arrays_zip("x", "y", F.col("felt").alias("density"))))
    far = crowded.join(felt.where(F.size("x") == 0).select("cx", "cy", "felt"), ["cx", "cy"])
    return sparse.toDF("x", "y", "density").unionByName(far.select("cx", "cy", "packed", "felt").mapInArrow(_at_points(radius), "x double, y double, density double"))
