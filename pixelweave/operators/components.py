"""Connected components and the label operators built on them.

Pixels first collapse into horizontal runs; edges join touching runs of
neighbouring rows; edges of one area are contracted where they lie, and
alternating large-star and small-star rounds shrink what is left of every
component to a star in logarithmically many steps. Each round is joins and
minimum aggregates and is checkpointed, and no component is ever collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.blocks import dense_index
from pixelweave.operators.stencil import Tiles
from pixelweave.schemas import frame_keys, movie_keys, val
from pixelweave.session import attach, cut_lineage, spread


def _contract(columns: list[str]):
    """Per Arrow batch: replace edges by a star to the smallest node of each local component.

    Any set of edges may be swapped for a spanning star without changing what
    is connected, so this only shortens paths before the distributed rounds.
    """
    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            keys = columns[:-2]
            ends = pd.concat([pdf[[*keys, "u"]].rename(columns={"u": "p"}), pdf[[*keys, "v"]].rename(columns={"v": "p"})])
            nodes = ends.drop_duplicates().sort_values([*keys, "p"]).reset_index(drop=True)
            code = pd.Series(nodes.index.to_numpy(), index=pd.MultiIndex.from_frame(nodes))
            at = code.loc[pd.MultiIndex.from_frame(ends)].to_numpy()
            u, v = at[:len(pdf)], at[len(pdf):]
            label = np.arange(len(nodes))
            while True:
                low = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                np.minimum.at(new, label, new)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            out = nodes.rename(columns={"p": "u"})
            out["v"] = nodes["p"].to_numpy()[label]
            yield out[out.u != out.v][columns]

    return run


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of every node with an edge; root is the smallest node reached.

    ``edges`` has the keys and long node numbers a and b, unique within keys.
    """
    cols = [*keys, "u", "v"]

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def settled(df: DataFrame) -> bool:
        """Every node has one root and no root has a root."""
        ends = df.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("p"), F.lit(1).alias("child")), F.struct(F.col("v").alias("p"), F.lit(0).alias("child")))).alias("e"))
        nodes = ends.groupBy(*keys, "e.p").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("low"))
        return nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("low") == 0))).isEmpty()

    star = oriented(edges.select(*keys, F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")))
    local = spread(star, *keys, F.floor(F.col("u") / 65536)).sortWithinPartitions(*keys, "u")
    star = cut_lineage(oriented(local.mapInPandas(_contract(cols), star.schema)))
    while not settled(star):
        both = star.unionByName(star.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = oriented(both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        lower = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut_lineage(oriented(small.unionByName(lower.select(*keys, "u", F.col("m").alias("v")))))
    return (star.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(star.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _labelled_runs(df: DataFrame, keys: list[str], outer: list[str], connectivity: int) -> DataFrame:
    """Foreground pixels with ``_root``, the raster number of the first pixel of their component.

    ``outer`` are the axes besides x: ("y",) for frames, ("frame", "y") for volumes.
    """
    fg = df.where("label > 0")
    w = Window.partitionBy(*keys, *outer).orderBy("x")
    start = F.when(F.coalesce(F.lag("x").over(w) != F.col("x") - 1, F.lit(True)), F.col("x"))
    line = F.col("y").cast("long") if len(outer) == 1 else F.col("frame").cast("long") * F.col("h") + F.col("y")
    runs = fg.withColumn("_s", start)
    runs = runs.withColumn("_node", line * F.col("w") + F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    deltas = [[]]
    for _ in outer:
        deltas = [d + [k] for d in deltas for k in (-1, 0, 1)]
    steps = [(*d, dx) for d in deltas if tuple(d) > (0,) * len(outer) for dx in (-1, 0, 1)
             if sum(map(abs, d)) + abs(dx) <= connectivity]
    axes = [*outer, "x"]
    offsets = F.array(*[F.struct(*[F.lit(k).alias(f"d_{a}") for a, k in zip(axes, s)]) for s in [(0,) * len(axes), *steps]])
    spread = runs.select(*keys, *axes, "_node", F.inline(offsets))
    own = F.lit(True)
    for a in axes:
        own = own & (F.col(f"d_{a}") == 0)
    met = spread.groupBy(*keys, *[(F.col(a) + F.col(f"d_{a}")).alias(a) for a in axes]).agg(
        F.max(F.when(own, F.col("_node"))).alias("a"), F.collect_set(F.when(~own, F.col("_node"))).alias("_near"))
    edges = met.where("a is not null").select(*keys, "a", F.explode("_near").alias("b"))
    roots = components(edges, keys).select(*keys, F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (runs.join(roots, [*keys, "_node"], "left")
            .withColumn("_root", F.coalesce("_root", "_node")).drop("_node"))


def connected_components(df: DataFrame, connectivity: int = 2, volume: bool = False) -> DataFrame:
    """Foreground rows (label > 0) with ``label`` numbered 1.. in raster order.

    connectivity 1 joins edge neighbours only, 2 diagonal ones too (3: volume corners).
    """
    keys = movie_keys(df) if volume else frame_keys(df)
    outer = ["frame", "y"] if volume else ["y"]
    rows = _labelled_runs(df, keys, outer, connectivity)
    roots = rows.select(*keys, "_root").distinct()
    chunk = F.floor(F.col("_root") / F.lit(65536))
    numbered = dense_index(roots, keys, ["_root"], chunk, "_i", None)
    return (rows.join(numbered, [*keys, "_root"]).withColumn("label", (F.col("_i") + 1).cast("int")).drop("_root", "_i"))


def _foreground(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (val() != 0).cast("int"))


def label_areas(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_area"))


def _write_back(df: DataFrame, chosen: DataFrame, inside: float, outside: Column) -> DataFrame:
    keys = [*frame_keys(df), "y", "x"]
    hit = chosen.select(*keys, F.lit(True).alias("_hit"))
    return (df.join(hit, keys, "left")
            .withColumn("value", F.when(F.col("_hit"), F.lit(inside)).otherwise(outside)).drop("_hit"))


def remove_small_blobs(df: DataFrame, min_size: int, connectivity: int = 1) -> DataFrame:
    """Zero the components with fewer than min_size pixels."""
    keys = frame_keys(df)
    labels = connected_components(_foreground(df), connectivity)
    small = attach(labels, label_areas(labels, keys), [*keys, "label"]).where(F.col("_area") < min_size)
    return _write_back(df, small, 0.0, val())


def remove_small_holes(df: DataFrame, max_size: int, connectivity: int = 1) -> DataFrame:
    """Fill background components of fewer than max_size pixels."""
    inverse = df.withColumn("value", (val() == 0).cast("int"))
    keys = frame_keys(df)
    labels = connected_components(_foreground(inverse), connectivity)
    small = attach(labels, label_areas(labels, keys), [*keys, "label"]).where(F.col("_area") < max_size)
    return _write_back(df, small, 1.0, val())


def hysteresis_threshold(df: DataFrame, low: float, high: float) -> DataFrame:
    """1 on components above low that hold a pixel above high."""
    keys = frame_keys(df)
    labels = connected_components(df.withColumn("label", (val() > low).cast("int")), 2)
    strong = labels.groupBy(*keys, "label").agg(F.max("value").alias("_top")).where(F.col("_top") > high)
    return _write_back(df, attach(labels, strong, [*keys, "label"], "left_semi"), 1.0, F.lit(0.0))


def flood_fill(df: DataFrame, seed_y: int, seed_x: int, tolerance: float, new_value: float) -> DataFrame:
    """Overwrite the region connected to the seed whose values are within tolerance of it."""
    keys = frame_keys(df)
    seed = df.where((F.col("y") == seed_y) & (F.col("x") == seed_x)).select(*keys, val().alias("_seed"))
    near = attach(df, seed, keys).withColumn("label", (F.abs(val() - F.col("_seed")) <= tolerance).cast("int")).drop("_seed")
    labels = connected_components(near, 2)
    chosen = labels.where((F.col("y") == seed_y) & (F.col("x") == seed_x)).select(*keys, "label")
    return _write_back(df, attach(labels, chosen, [*keys, "label"], "left_semi"), new_value, val())


def clear_border(labels: DataFrame, buffer_size: int = 0) -> DataFrame:
    """Drop the labels that come within buffer_size of the image edge."""
    b = buffer_size
    edge = ((F.col("y") <= b) | (F.col("x") <= b) | (F.col("y") >= F.col("h") - 1 - b) | (F.col("x") >= F.col("w") - 1 - b))
    keys = [*frame_keys(labels), "label"]
    return attach(labels, labels.where(edge & (F.col("label") > 0)).select(*keys).distinct(), keys, "left_anti")


def expand_labels(df: DataFrame, distance: float) -> DataFrame:
    """Grow labels into background pixels within ``distance``; the nearest label wins.

    Labels are sent to the disc around each labelled pixel and combine by
    minimum, so the shuffle carries one candidate per target and task.
    """
    r = int(distance)
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= distance * distance]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc])
    keys = [*frame_keys(df), "y", "x"]
    sent = df.where("label > 0").select(*frame_keys(df), "label", F.col("y").alias("_y"), F.col("x").alias("_x"), F.inline(offsets))
    sent = sent.select(*frame_keys(df), (F.col("_y") + F.col("dy")).alias("y"), (F.col("_x") + F.col("dx")).alias("x"),
                       F.struct((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).alias("d"), F.col("label").alias("l")).alias("c"))
    best = sent.groupBy(*keys).agg(F.min("c").alias("_c"))
    return (df.join(best, keys, "left")
            .withColumn("label", F.when(F.col("label") > 0, F.col("label")).otherwise(F.coalesce("_c.l", F.lit(0)))).drop("_c"))


def find_boundaries(df: DataFrame, mode: str = "thick") -> DataFrame:
    """1 where a 4-neighbour carries another label; "inner" keeps labelled pixels only."""
    rows = df.withColumn("value", F.col("label").cast("double"))
    t = Tiles(rows, 1, 1, "nearest")
    t.put(_l=t.at("value", -1, t.wx), _r=t.at("value", 1, t.wx))
    here = F.col("value")
    edge = (F.col("_l") != here) | (F.col("_r") != here) | (t.at("value", -1, t.wy) != here) | (t.at("value", 1, t.wy) != here)
    if mode == "inner":
        edge = edge & (here > 0)
    return t.put(_b=edge.cast("int")).done(value="_b")


def local_maxima(df: DataFrame) -> DataFrame:
    """Rows of the 8-neighbour maxima; a flat plateau counts when nothing around it is higher."""
    keys = frame_keys(df)
    t = Tiles(df, 1, 1, "nearest").extreme("_top", F.max, 1, 1)
    t.put(_l=t.at("value", -1, t.wx), _r=t.at("value", 1, t.wx))
    same = [(t.at(c, k, t.wy) == F.col("value")) for c in ("_l", "value", "_r") for k in (-1, 1)] + [F.col("_l") == F.col("value"), F.col("_r") == F.col("value")]
    flat = sum((s.cast("int") for s in same[1:]), same[0].cast("int")) > 0
    t.put(_flat=flat)
    rows = t.rows.where("_core").select(*df.columns, (F.col("value") == F.col("_top")).alias("_max"), "_flat")
    single = rows.where("_max and not _flat").drop("_max", "_flat")
    # edge pixels repeat themselves outside, so plateaus are settled by true neighbours
    plateau = cut_lineage(rows.where("_flat"))
    if plateau.isEmpty():
        return single
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    spread = plateau.select(*keys, "y", "x", "w", "value", F.inline(offsets))
    own = (F.col("dy") == 0) & (F.col("dx") == 0)
    node = F.col("y").cast("long") * F.col("w") + F.col("x")
    met = spread.groupBy(*keys, (F.col("y") + F.col("dy")).alias("_ty"), (F.col("x") + F.col("dx")).alias("_tx"), "value").agg(
        F.max(F.when(own, node)).alias("a"), F.collect_set(F.when(~own, node)).alias("_near"))
    roots = components(met.where("a is not null").select(*keys, "a", F.explode("_near").alias("b")), keys)
    tagged = (plateau.withColumn("node", node).join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node")).drop("node"))
    good = tagged.groupBy(*keys, "root").agg(F.min(F.col("_max").cast("int")).alias("_ok")).where("_ok = 1").select(*keys, "root")
    kept = tagged.join(good, [*keys, "root"], "left_semi").select(*df.columns)
    return single.unionByName(kept)


def multi_otsu(df: DataFrame, classes: int = 3, bins: int = 256) -> DataFrame:
    """Classes 0..k-1 of each movie by the thresholds that maximise the
    between-class variance over a bounded histogram."""
    keys = movie_keys(df)
    ext = df.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = attach(df, ext, keys)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((val() - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    hist = rows.groupBy(*keys, "_lo", "_hi", b.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    table = hist.groupBy(*keys, "_lo", "_hi").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("_m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    table = table.select(*keys, "_lo", "_hi", counts.alias("_c"))

    def running(step):
        return F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.array(F.lit(0.0)),
                           lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + step(i))))

    table = table.withColumn("_p", running(lambda i: F.get("_c", i))).withColumn("_s", running(lambda i: F.get("_c", i) * (i + 0.5)))
    cut = table
    names = []
    for k in range(classes - 1):
        low = F.lit(1) if k == 0 else F.col(names[-1]) + 1
        name = f"_t{k}"
        cut = cut.withColumn(name, F.explode(F.sequence(low, F.lit(bins - (classes - 1) + k))))
        names.append(name)
    bounds = [F.lit(0), *[F.col(n) for n in names], F.lit(bins)]

    def term(lo, hi):
        p = F.get("_p", hi) - F.get("_p", lo)
        s = F.get("_s", hi) - F.get("_s", lo)
        return F.when(p > 0, s * s / p).otherwise(0.0)

    score = sum((term(bounds[i], bounds[i + 1]) for i in range(1, classes)), term(bounds[0], bounds[1]))
    best = cut.groupBy(*keys).agg(F.max_by(F.struct(*names, "_lo", "_hi"), F.struct(score.alias("s"), *[(-F.col(n)).alias(n) for n in names])).alias("_best"))
    best = best.select(*keys, *[(F.col("_best._lo") + (F.col(f"_best.{n}") - 0.5) * (F.col("_best._hi") - F.col("_best._lo")) / bins).alias(f"threshold{i}") for i, n in enumerate(names)])
    out = attach(df, best, keys)
    level = sum(((val() > F.col(f"threshold{i}")).cast("int") for i in range(1, classes - 1)), (val() > F.col("threshold0")).cast("int"))
    return out.withColumn("value", level)


def region_table(labels: DataFrame, min_area: int = 1, max_area: int | None = None) -> DataFrame:
    """Area gate, renumbering, centroid, bounding box and mean intensity per region."""
    keys = frame_keys(labels)
    agg = labels.where("label > 0").groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        F.min("y").alias("bbox_y0"), F.min("x").alias("bbox_x0"), F.max("y").alias("bbox_y1"), F.max("x").alias("bbox_x1"),
        F.avg("value").alias("mean_intensity"))
    kept = agg.where(F.col("area") >= min_area)
    if max_area is not None:
        kept = kept.where(F.col("area") <= max_area)
    numbered = dense_index(kept.withColumnRenamed("label", "_old"), keys, ["_old"], F.floor(F.col("_old") / F.lit(65536)), "_i", None)
    return numbered.withColumn("label", (F.col("_i") + 1).cast("int")).drop("_i", "_old")


def analyze_particles(df: DataFrame, min_area: int = 1, max_area: int | None = None, intensity: DataFrame | None = None) -> DataFrame:
    """Components of a binary stack as a particle table."""
    labels = connected_components(_foreground(df), 2)
    if intensity is not None:
        keys = [*frame_keys(df), "y", "x"]
        labels = labels.drop("value").join(intensity.select(*keys, "value"), keys)
    return region_table(labels, min_area, max_area)
