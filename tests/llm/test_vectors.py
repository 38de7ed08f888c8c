"""Cover-tree pairs and centroid clustering against all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import centroids, covertree

SF = "/root/testdata/sf0.001"


def all_pairs(v, w, threshold):
    norm = np.linalg.norm(v, axis=1)
    near = (v @ v.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(v)).min(axis=1))
        if (new == label).all():
            return (near * w).sum(axis=1), label
        label = new


@pytest.mark.parametrize("n, noise, groups, dim", [(800, .02, 200, 64), (700, .05, 10, 64), (900, .3, 20, 8), (600, .001, 3, 40), (700, .04, 1, 64), (300, 1, 300, 2)])
def test_traversal_finds_exactly_the_pairs(monkeypatch, n, noise, groups, dim):
    monkeypatch.setattr(covertree, "AT_ONCE", 500)
    draw = np.random.default_rng(n)
    v = draw.normal(size=(groups, dim))[draw.integers(0, groups, n)] + noise * draw.normal(size=(n, dim))
    w, found = draw.integers(1, 4, n), np.zeros(n, int)
    want, label = all_pairs(v, w, .95)

    def block(part):
        return covertree.Block(v[part], w[part], covertree.cover(covertree.unit(v[part]), covertree.WIDE))

    whole = covertree.Traversal(b := block(slice(None)), b, .95)
    whole.run()
    assert (whole.links == want).all() and (whole.label == label).all()
    left, right = block(slice(0, n // 3)), block(slice(n // 3, None))
    for x, y, at in ((left, right, slice(None)), (left, left, slice(0, n // 3)), (right, right, slice(n // 3, None))):
        walk = covertree.Traversal(x, y, .95)
        walk.run()
        found[at] += walk.links
    assert (found == want).all()


def test_tight_clumps_are_counted_without_their_pairs():
    draw = np.random.default_rng(5)
    v = draw.normal(size=(4, 64))[np.repeat(np.arange(4), 2000)] + .001 * draw.normal(size=(8000, 64))
    b = covertree.Block(v, np.ones(8000, int), covertree.cover(covertree.unit(v), covertree.WIDE))
    walk = covertree.Traversal(b, b, .95)
    walk.run()
    assert (walk.links == 1999).all() and walk.compared < 100


def test_balls_hold_their_members():
    draw = np.random.default_rng(6)
    u = covertree.unit(draw.normal(size=(1500, 6)))
    owner = covertree.cover(u, .5)
    assert (owner[owner] == owner).all()
    assert np.linalg.norm(u - u[owner], axis=1).max() <= .5 + 1e-5
    centres = u[np.unique(owner)]
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 2 * np.eye(len(centres))
    assert gaps.min() >= .5 - 1e-5


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        return df.withColumns({c: F.lit(None).cast("int") for c in ("h", "g", "v", "w", "n", "cell", "sub", "rep", "cluster", "distance")})
    return make


def rows_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_near_duplicates_on_awkward_rows(vectors_of):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(5, a, 1), (5, a, 2), (3, b, None), (9, [2.0, 0.0, 0.0], 1), (4, a, 1), (6, [0.0, 1.0, 0.0], 1), (7, None, 1), (8, [0.0, 0.0, 0.0], 1),
            (10, [float("nan"), 1.0, 0.0], 1), (11, [None, 1.0, 0.0], 1), (12, [], 1), (None, a, 1), (13, [1.0, 0.0], 1), (14, [1e300, 1e299, 0.0], 1),
            (15, [float("inf"), 1.0, 0.0], 1), (16, [0.0, 1.0, 0.0], 1), (16, [0.0, 0.0, 1.0], 1), (17, [0.0, 0.01, 1.0], 1)]
    want = [(5, 4, 3, False), (5, 4, 3, False), (3, 4, 3, True), (9, 4, 3, False), (4, 4, 3, False), (14, 4, 3, False), (6, 1, 6, True), (7, 0, 7, True), (8, 0, 8, True),
            (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True), (None, 0, None, True), (13, 0, 13, True), (15, 0, 15, True), (16, 1, 6, False),
            (16, 1, 6, False), (17, 1, 6, False)]
    assert rows_of(covertree.near_duplicates(vectors_of(rows))) == sorted(want, key=str)
    assert covertree.near_duplicates(vectors_of([])).count() == 0


def test_near_duplicates_over_many_cells_and_blocks(spark, vectors_of, monkeypatch):
    monkeypatch.setattr(covertree, "LEAST_BLOCK", 40)
    draw = np.random.default_rng(7)
    v = np.concatenate([draw.normal(size=(60, 16))[draw.integers(0, 60, 500)] + .15 * draw.normal(size=(500, 16)),
                        draw.normal(size=(1, 16)) + .02 * draw.normal(size=(300, 16))])
    want, label = all_pairs(v, np.ones(len(v), int), .95)
    df = vectors_of([(int(i), [float(x) for x in r], 0) for i, r in enumerate(v)])
    assert rows_of(covertree.near_duplicates(df)) == sorted(((i, int(want[i]), int(label[i]), bool(label[i] == i)) for i in range(len(v))), key=str)


@pytest.mark.parametrize("n, k, size, dim", [(2000, 16, 8, 64), (400, 40, 3, 6), (60, 3, 1, 2), (50, 1, 9, 4), (300, 16, 0, 3)])
def test_tree_finds_the_nearest_and_the_smaller_of_ties(n, k, size, dim):
    draw = np.random.default_rng(n)
    rows = draw.integers(-size, size + 1, (n, dim))
    points = rows[:k].copy()
    points[k // 2] = points[0]
    d = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
    for cluster, best, taken in (centroids.nearest(rows, points, centroids.vantage_tree(points)), centroids.direct(rows.astype(object), points)):
        assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and (taken <= k).all()


def test_tree_skips_distances_in_the_plane():
    draw = np.random.default_rng(8)
    points = draw.integers(-10**6, 10**6, (64, 2))
    assert centroids.nearest(draw.integers(-10**6, 10**6, (500, 2)), points, centroids.vantage_tree(points))[2].mean() < 32


def test_limbs():
    for v in (0, 1, -1, 10**18, -(10**40) - 7, 3 * 10**300):
        assert sum(d * centroids.LIMB**i for i, d in enumerate(centroids.limbs(v))) == v


def clustered(rows, k, rounds, seed, scale=64):
    """By all distances, in Python integers: {(vec_id, place): columns}."""
    kept = [(i, [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v], v) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, q) for i, q, v in kept if i is not None)
    points = [q for _, _, q in first[:k]]

    def place(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = {}
        for _, q, _ in kept:
            own.setdefault(place(q)[1], []).append(q)
        points = [[sum(x) // len(own[c]) for x in zip(*own[c])] if c in own else p for c, p in enumerate(points)]
    final = [(i, *place(q)) for i, q, _ in kept]
    inertia = {}
    for _, d, c in final:
        inertia[c] = inertia.get(c, 0) + (d if d < 1 << 63 else 0)
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, c, d if d < 1 << 63 else None, inertia[c], sum(inertia.values()), sha[c]) for i, d, c in final), key=str)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def test_clusters_on_awkward_rows(vectors_of):
    draw = np.random.default_rng(9)
    good = [(i % 70 if i else None, [float(x) for x in draw.choice([-1.5, 0.25, 0.3, 2.0], 4)]) for i in range(90)] + [(100, [0.25] * 4)] * 3
    bad = [(200, [1.0] * 3), (201, None), (202, [None, 1.0, 1.0, 1.0]), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("-inf"), 0.0, 0.0, 0.0]), (205, [])]
    df = vectors_of([(i, v, 0) for i, v in good + bad])
    assert result(centroids.cluster(df, k=8, rounds=3, seed=1, dim=4)) == clustered(good, 8, 3, 1)
    few = good[1:4]
    assert result(centroids.cluster(vectors_of([(i, v, 0) for i, v in few]), k=8, dim=4)) == clustered(few, 8, 3, 1)
    assert centroids.cluster(vectors_of([])).count() == 0


def test_clusters_of_huge_components(vectors_of):
    rows = [(i, [float(x), 1.0]) for i, x in enumerate([1e308, -1e308, 3e9, 2.0, 2.1, 1e300, 0.5, -3e9])]
    assert result(centroids.cluster(vectors_of([(i, v, 0) for i, v in rows]), k=3, dim=2)) == clustered(rows, 3, 3, 1)


@pytest.mark.parametrize("name", ["op12_embedding_near_dedup", "op13_centroid_clustering"])
def test_queries_equal_sql(spark, name):
    from oracle import compare, duck

    from pixelweave.llm.queries import ORACLES, QUERIES

    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None
