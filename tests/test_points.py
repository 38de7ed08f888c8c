import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import boxes as B
from pixelweave.operators import evaluation as E
from pixelweave.operators import fits as FT
from pixelweave.operators import linking as L
from pixelweave.operators import spatial as S
from pixelweave.operators import spectral as SP
from pixelweave.operators import tracks as T
from pixelweave.operators.density import gaussian_density


def points(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, frame int, x double, y double")


def greedy(rows, max_distance, max_gap):
    """Plain sequential linker used as the reference answer."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    free, owner = set(order), {}
    for s in order:
        if s not in free:
            continue
        free.discard(s)
        owner[s], at = s, s
        while at is not None:
            nxt = None
            for dt in range(1, max_gap + 2):
                near = [(np.hypot(rows[j][1] - rows[at][1], rows[j][2] - rows[at][2]), j) for j in free if rows[j][0] == rows[at][0] + dt]
                if near and min(near)[0] < max_distance:
                    nxt = min(near)[1]
                    break
            if nxt is not None:
                free.discard(nxt)
                owner[nxt] = s
            at = nxt
    return owner


@pytest.mark.parametrize("limit", [None, 6])
def test_linking_equals_the_sequential_rule(spark, limit):
    rng = np.random.default_rng(7)
    rows = [(int(f), float(x), float(y)) for f in range(8) for x, y in rng.uniform(0, 12, size=(9, 2))]
    want = greedy(rows, 3.0, 1)
    got = {r.id: r.track_id for r in L.link_greedy(points(spark, rows), 3.0, 1, 1, limit).collect()}
    pairs = itertools.combinations(range(len(rows)), 2)
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a, b in pairs)


def test_linking_over_many_tiles_of_a_percolating_cloud(spark):
    """Candidate edges join nearly all points; tiles of 100 points settle in rounds to the sequential result, movie by movie."""
    rng = np.random.default_rng(17)
    rows = [(int(f), float(x), float(y)) for f in range(16) for x, y in np.concatenate([rng.uniform(0, 36, size=(35, 2)), rng.normal(20, 2, size=(10, 2))])]
    want = greedy(rows, 4.0, 1)
    movies = points(spark, rows).withColumn("movie_id", F.explode(F.array(F.lit("a:1"), F.lit("b"))))
    seeds = {}
    for r in L.link_greedy(movies, 4.0, 1, 1, 100).select("movie_id", "id", "track_id").collect():
        seeds.setdefault((r.movie_id, r.track_id), []).append(want[r.id])
    assert sum(map(len, seeds.values())) == 2 * len(rows) and len(seeds) == 2 * len(set(want.values()))
    assert all(len(set(v)) == 1 for v in seeds.values())


def test_two_tracks_and_a_gap(spark):
    two = [(0, 10.0, 10.0), (0, 50.0, 50.0), (1, 11.0, 10.0), (1, 51.0, 50.0), (2, 12.0, 10.0), (2, 52.0, 50.0)]
    out = L.link_greedy(points(spark, two), 5.0, 0).groupBy("track_id").count().collect()
    assert sorted(r["count"] for r in out) == [3, 3]
    gap = [(0, 10.0, 10.0), (1, 11.0, 10.0), (3, 13.0, 10.0)]
    assert L.link_greedy(points(spark, gap), 5.0, 2).select("track_id").distinct().count() == 1


def test_track_known_answers(spark):
    line = spark.createDataFrame([(1, i, float(i), 0.0, 1.0) for i in range(10)], "track_id long, frame int, x double, y double, intensity double")
    assert T.velocity_analysis(line).first().mean_velocity == 1.0
    assert T.direction_analysis(line).first().directional_persistence > 0.9
    tri = spark.createDataFrame([(1, i, 3.0 * i, 4.0 * i) for i in range(3)], "track_id long, frame int, x double, y double")
    assert [r.distance_from_origin for r in T.distance_from_origin(tri).orderBy("frame").collect()] == [0.0, 5.0, 10.0]
    walk = np.cumsum(np.random.default_rng(42).normal(size=(400, 2)), axis=0)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(walk)], "track_id long, frame int, x double, y double")
    assert 0.5 < T.msd_analysis(df).first().anomalous_exponent < 1.5
    d = max(np.hypot(*(walk[i] - walk).T).max() for i in range(len(walk)))
    assert abs(T.track_diameter(df, block=16, fan_in=3).first().diameter - d) < 1e-9


def test_rows_table_rounds_half_even(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 0.125 + i) for i in range(4)], "track_id long, frame int, x double, y double, intensity double")
    row = T.track_features_rows(df, 2).first()
    assert row.track_intensity_mean == 1.62 and row.lag in (1.0, None)
    assert T.track_features_rows(df, 4).count() == 0


def test_neighbours_with_copies(spark):
    rows = [(0, 0.0, 0.0), (0, 1.0, 0.0), (0, 3.0, 0.0), (0, 10.0, 0.0), (0, 10.0, 0.0), (0, 10.0, 0.0), (1, 5.0, 5.0)]
    got = {r.id: r for r in S.frame_neighbours(points(spark, rows), (1.5, 3)).collect()}
    assert [got[i].nn_dist for i in range(7)] == [1.0, 1.0, 2.0, 0.0, 0.0, 0.0, None]
    assert [got[i].nn_id for i in range(7)] == [1, 0, 1, 4, 3, 3, None]
    assert [got[i]["n_within_1_5"] for i in range(7)] == [1, 1, 0, 2, 2, 2, 0]


def test_nearest_neighbour_on_two_densities_compares_few_pairs(spark, monkeypatch):
    """2000 points inside a thousandth of a pixel among 2000 over a thousand pixels: fewer than 60 candidates a point (all pairs are 4000)."""
    rng = np.random.default_rng(18)
    xy = np.concatenate([500 + rng.uniform(0, 1e-3, size=(2000, 2)), rng.uniform(0, 1000, size=(2000, 2))])
    seen, join = [], S.range_join
    monkeypatch.setattr(S, "range_join", lambda *args: seen.append(args) or join(*args))
    got = {r.id: r.nn_dist for r in S.nearest_neighbour(points(spark, [(0, float(a), float(b)) for a, b in xy]), ["frame"]).select("id", "nn_dist").collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + np.where(np.eye(len(xy)), np.inf, 0)
    assert np.allclose([got[i] for i in range(len(xy))], d.min(axis=1), rtol=1e-12)
    candidates = 0
    for left, right, radius, keys in seen:
        cells = S._cells(left, radius, False).select(*keys, "_cx", "_cy").join(S._cells(right, radius, True).select(*keys, "_cx", "_cy"), [*keys, "_cx", "_cy"])
        candidates += cells.count()
    assert candidates < 60 * len(xy)


def test_density_filter_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 30, size=(150, 2)), np.repeat([[4.0, 4.0]], 20, axis=0)])
    df = points(spark, [(0, float(a), float(b)) for a, b in xy])
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    want = {i for i in range(len(xy)) if (d[i] <= 3).sum() - 1 >= 4}
    assert {r.id for r in S.local_density_filter(df, 3.0, 4).collect()} == want


def test_neighbour_counts_of_clumps_against_all_pairs(spark, monkeypatch):
    """Two clumps a radius apart, a sparse field, copies, whole distances, negative coordinates."""
    rng = np.random.default_rng(22)
    xy = np.concatenate([rng.normal(0, 0.01, size=(700, 2)), rng.normal(0, 0.01, size=(700, 2)) + [3.0, 0.0], rng.uniform(-40, 40, size=(300, 2)),
                         np.repeat([[5.0, 5.0]], 9, axis=0), [[-8.0, 5.0], [-8.0, 8.0], [-8.0, 15.0], [22.0, 5.0]]])
    rows = [(0, float(a), float(b)) for a, b in xy] + [(1, 0.0, 0.0), (1, 3.0, 0.0), (1, None, 1.0)]
    radii = (3, 5, 10, 20, 30)
    calls, plain = [], S.tree_counts
    monkeypatch.setattr(S, "tree_counts", lambda *a: calls.append(a) or plain(*a))
    got = {r.id: [r[S.within_name(v)] for v in radii] for r in S.neighbour_counts(points(spark, rows), ["frame"], radii).collect()}
    assert calls and len(got) == len(xy) + 2
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert all(got[i] == [int((d[i] <= v).sum()) - 1 for v in radii] for i in range(len(xy)))
    assert got[len(xy)] == got[len(xy) + 1] == [1] * 5


def test_gaussian_density_against_all_pairs(spark):
    """A clump in one cell, a heap of copies, a sparse field, negative coordinates and cells far apart."""
    rng = np.random.default_rng(19)
    xy = np.concatenate([rng.normal(0, 0.3, size=(1500, 2)), rng.uniform(-40, 40, size=(400, 2)), [[1e6, 1e6], [1e6, 1e6 + 1], [7.0, 7.0]]])
    m = rng.integers(1, 9, size=len(xy))
    rows = [(float(a), float(b), int(k)) for (a, b), k in zip(xy, m, strict=True)] + [(None, 1.0, 1), (float("nan"), 0.0, 1)]
    got = {(r.x, r.y): r.density for r in gaussian_density(spark.createDataFrame(rows, "x double, y double, m long"), 2.0).collect()}
    assert len(got) == len(xy)
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    want = (np.exp(-d2 / 4.0) * m).sum(axis=1)
    assert np.allclose([got[tuple(p)] for p in xy], want, rtol=0, atol=1e-12 * m.sum())
    assert gaussian_density(spark.createDataFrame([], "x double, y double, m long"), 2.0).count() == 0


def test_density_peaks_against_all_pairs(spark, monkeypatch):
    """Densities, nearest denser points and labels by brute force, and how many candidates the joins met."""
    rng = np.random.default_rng(20)
    xy = np.concatenate([rng.normal(0, 0.01, size=(900, 2)), rng.uniform(-20, 20, size=(900, 2)), np.repeat([[3.0, 3.0]], 30, axis=0)])
    seen, plain = [], S.range_join
    monkeypatch.setattr(S, "range_join", lambda *a: seen.append(a) or plain(*a))
    rows = S.density_peaks(points(spark, [(0, float(a), float(b)) for a, b in xy]), 2.0, min_density=20.0, min_delta=3.0).collect()
    got = {r.id: r for r in rows}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    rho = np.exp(-np.square(d / 2.0)).sum(axis=1) - 1
    assert np.allclose([got[i].rho for i in range(len(xy))], rho, atol=1e-9)
    mine = np.array([got[i].rho for i in range(len(xy))])  # ties of rounding follow the densities found
    higher = (mine[None] > mine[:, None]) | ((mine[None] == mine[:, None]) & (np.arange(len(xy))[None] < np.arange(len(xy))[:, None]))
    far = np.where(higher, d, np.inf)
    delta = far.min(axis=1)
    delta[np.isinf(delta)] = delta[np.isfinite(delta)].max()
    assert np.allclose([got[i].delta for i in range(len(xy))], delta, rtol=1e-12)
    label = {}
    for i in np.lexsort((np.arange(len(xy)), -mine)):
        centre = mine[i] >= 20.0 and delta[i] >= 3.0
        label[i] = i if centre else label[int(np.argmin(far[i]))] if np.isfinite(far[i].min()) else -1
    assert {i: got[i].label for i in label} == label
    candidates = sum(S._cells(left, r, False).join(S._cells(right, r, True), ["_cx", "_cy"]).count() for left, right, r, _ in seen)
    assert candidates < len(xy) ** 2 / 15  # of all pairs, over all rounds


def test_density_peaks_find_two_clumps(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(0, 1, size=(40, 2)), rng.normal(30, 1, size=(30, 2))])
    out = S.density_peaks(points(spark, [(0, float(a), float(b)) for a, b in xy]), 2.0, n_clusters=2).collect()
    first, second = {r.label for r in out if r.id < 40}, {r.label for r in out if r.id >= 40}
    assert len(first) == len(second) == 1 and first != second


def test_molecular_merge_joins_only_points_of_cells_that_were_empty(spark, monkeypatch):
    """Dense frames are settled by cells; what is left is joined, with the result of all pairs."""
    rng = np.random.default_rng(29)
    rows = [(int(f), *p) for f in (0, 3, 4, 9) for p in rng.uniform(0, 10, size=(400, 2)).tolist()]
    rows += [(9, 30.0, 30.0), (4, 33.9, 30.0), (4, 50.0, 50.0), (9, 54.1, 50.0), (9, None, 1.0)]
    joined, plain = [], S.range_join
    monkeypatch.setattr(S, "range_join", lambda *a: joined.append(a[1].count()) or plain(*a))
    got = {r.id for r in S.molecular_merge(points(spark, rows), 4.0, 2).collect()}
    rank = {0: 0, 3: 1, 4: 2, 9: 3}

    def near(a, b):
        return None not in a and 1 <= rank[a[0]] - rank[b[0]] <= 2 and None not in b and np.hypot(a[1] - b[1], a[2] - b[2]) <= 4.0

    assert got == {i for i, a in enumerate(rows) if not any(near(a, b) for b in rows)}
    assert sum(joined) < 450  # the first frame and a few points of the others


def test_density_peaks_work_on_positions(spark, monkeypatch):
    """Copies of a position cost no stored rows, and still count in the thresholds and among the centres."""
    rng = np.random.default_rng(23)
    xy = np.round(rng.uniform(0, 12, size=(60, 2)), 1)[rng.integers(0, 60, size=900)]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    stored, plain = [], S.cut_lineage

    def counted(df):
        out = plain(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(S, "cut_lineage", counted)
    monkeypatch.setattr(S, "TOGETHER", 4)  # many tiles
    for kind in ({"min_density": 20.0, "min_delta": 0.0}, {"n_clusters": 70}, {"n_clusters": 3}, {}):
        got = {r.id: r for r in S.density_peaks(points(spark, [(0, *map(float, p)) for p in xy]), 2.0, **kind).collect()}
        rho = np.array([got[i].rho for i in range(len(xy))])
        assert np.allclose(rho, np.exp(-np.square(d / 2.0)).sum(axis=1) - 1, atol=1e-9)
        ids = np.arange(len(xy))
        far = np.where((rho[None] > rho[:, None]) | ((rho[None] == rho[:, None]) & (ids[None] < ids[:, None])), d, np.inf)
        delta = far.min(axis=1)
        delta[np.isinf(delta)] = delta[np.isfinite(delta)].max()
        assert np.allclose([got[i].delta for i in ids], delta, rtol=1e-12)
        if "n_clusters" in kind:
            centre = np.isin(ids, np.lexsort((ids, -rho * delta))[:kind["n_clusters"]])
        else:
            centre = (rho >= kind.get("min_density", np.quantile(rho, 0.5))) & (delta >= kind.get("min_delta", np.quantile(delta, 0.9)))
        label = {}
        for i in np.lexsort((ids, -rho)):
            label[i] = i if centre[i] else label[int(np.argmin(far[i]))] if np.isfinite(far[i].min()) else -1
        assert {i: got[i].label for i in ids} == label
    assert max(stored) <= 60


def test_matching_equals_sorted_greedy(spark):
    rng = np.random.default_rng(10)
    a, b = rng.uniform(0, 10, size=(30, 2)), rng.uniform(0, 10, size=(25, 2))
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    used_a, used_b, want = set(), set(), set()
    for dist, i, j in sorted((d[i, j], i, j) for i in range(30) for j in range(25)):
        if dist <= 2.0 and i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j), want.add((i, j))
    got = E.match_greedy(points(spark, [(0, *map(float, p)) for p in a]), points(spark, [(0, *map(float, p)) for p in b]), 2.0, ["frame"])
    assert {(r.det, r.gt) for r in got.collect()} == want
    m = E.detection_metrics_stack(points(spark, [(0, *map(float, p)) for p in b]), points(spark, [(0, *map(float, p)) for p in a]), 2.0).first()
    assert (m.tp, m.fp, m.fn) == (len(want), 30 - len(want), 25 - len(want))


def test_suppression_equals_the_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(1, i, float(x), float(y), float(w), float(h), float(c)) for i, (x, y, w, h, c) in enumerate(
        np.column_stack([rng.uniform(0, 60, (80, 2)), rng.uniform(8, 25, (80, 2)), np.round(rng.uniform(0, 1, 80), 1)]))]
    df = spark.createDataFrame(rows, "image_id int, id long, x double, y double, width double, height double, confidence double")
    left, want = sorted(rows, key=lambda r: (-r[6], r[1])), set()

    def iou(p, q):
        iw = max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        ih = max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
        return iw * ih / (p[4] * p[5] + q[4] * q[5] - iw * ih + 1e-6)

    while left:
        top, left = left[0], left[1:]
        want.add(top[1])
        left = [r for r in left if iou(top, r) <= 0.3]
    assert {r.id for r in B.nms_boxes(df, 0.3).collect()} == want


def test_nonnegative_unmixing_is_optimal(spark):
    rng = np.random.default_rng(12)
    s, data = rng.uniform(size=(3, 6)), rng.uniform(size=(40, 6))
    df = spark.createDataFrame([(i, [float(v) for v in d]) for i, d in enumerate(data)], "pixel_id int, data array<double>")
    for r in SP.linear_unmix(df, s, "nnls").collect():
        a, g = np.array(r.abundance), s @ (np.array(r.abundance) @ s - data[r.pixel_id])
        assert (a >= 0).all() and (g > -1e-9).all() and abs(a @ g) < 1e-9


def test_nonnegative_unmixing_of_many_components(spark):
    rng = np.random.default_rng(19)
    s, data = np.abs(rng.normal(size=(12, 20))), rng.normal(size=(60, 20))
    df = spark.createDataFrame([(i, [float(v) for v in d]) for i, d in enumerate(data)], "pixel_id int, data array<double>")
    rows = SP.linear_unmix(df, s, "nnls").collect()
    assert len(rows) == 60
    for r in rows:
        a, g = np.array(r.abundance), s @ (np.array(r.abundance) @ s - data[r.pixel_id])
        assert (a >= 0).all() and (g > -1e-9).all() and abs(a @ g) < 1e-9
    few = s[:5]
    fixed = {r.pixel_id: r.abundance for r in SP.linear_unmix(df, few, "nnls").collect()}
    assert np.allclose(SP.non_negative(few @ few.T, data @ few.T), [fixed[i] for i in range(60)], atol=1e-9)


def test_a_page_wide_box_makes_no_cell_wider(spark):
    rng = np.random.default_rng(20)
    rows = [(1, i, float(x), float(y), float(w), float(h), float(c)) for i, (x, y, w, h, c) in enumerate(np.column_stack(
        [rng.uniform(0, 200, (150, 2)), 2 ** rng.uniform(1, 6, (150, 2)), np.round(rng.uniform(0, 1, 150), 1)]))] + [(1, 150, 0.0, 0.0, 1e5, 1e5, 0.5)]
    df = spark.createDataFrame(rows, "image_id int, id long, x double, y double, width double, height double, confidence double")

    def iou(p, q):
        iw = max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        ih = max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
        return iw * ih / (p[4] * p[5] + q[4] * q[5] - iw * ih + 1e-6)

    for least in (0.01, 0.3, 0.6):
        want = {(p[1], q[1]) for p in rows for q in rows if p != q and (-p[6], p[1]) < (-q[6], q[1]) and iou(p, q) > least}
        assert {(r.winner, r.loser) for r in B.overlapping_boxes(df, least).collect()} == want


def test_fits_recover_parameters(spark):
    t = np.arange(60.0)
    rows = [("d", int(i), float(8 * np.exp(-0.07 * i) + 2)) for i in t]
    r = FT.fit_exp_decay(spark.createDataFrame(rows, "trace_id string, t int, value double")).first()
    assert abs(r.rate - 0.07) < 1e-4 and abs(r.amplitude - 8) < 1e-2 and r.r_squared > 0.9999
    rows = [("r", int(i), float(0.7 * (1 - np.exp(-i / 9.0)) + 0.1)) for i in t]
    r = FT.fit_exp_recovery(spark.createDataFrame(rows, "trace_id string, t int, value double")).first()
    assert abs(r.tau - 9) < 0.02 and abs(r.mobile_fraction - 0.8) < 1e-3
    r2 = np.random.default_rng(13).exponential(4 * 1.5, size=4000)
    c = FT.cdf_diffusion(spark.createDataFrame([(float(v),) for v in r2], "r2 double"), 1.0).first()
    assert abs(c.d1 - 1.5) < 0.1


def test_step_fit_ignores_a_far_step(spark):
    r2 = [*np.random.default_rng(13).exponential(4 * 1.5, size=4000), 1e6]
    steps = spark.createDataFrame([(float(v),) for v in r2], "r2 double")
    one, two = FT.cdf_diffusion(steps, 1.0, 1), FT.cdf_diffusion(steps.limit(4), 1.0, 1)
    assert abs(one.first().d1 - 1.5) < 0.1
    assert two.count() == 0 and two.schema.names == one.schema.names
    mix = np.random.default_rng(14).permutation([*np.random.default_rng(15).exponential(4 * 0.1, 3000), *np.random.default_rng(16).exponential(4 * 5.0, 3000)])
    r = FT.cdf_diffusion(spark.createDataFrame([(float(v),) for v in mix], "r2 double"), 1.0, 2).first()
    assert abs(r.d1 - 0.1) < 0.03 and abs(r.d2 - 5.0) < 0.7 and abs(r.f1 - 0.5) < 0.05


def test_recovery_has_no_negative_amplitude(spark):
    rows = [("f", i, float(5 * np.exp(-i / 8.0) + 1)) for i in range(40)]
    r = FT.fit_exp_recovery(spark.createDataFrame(rows, "trace_id string, t int, value double")).first()
    assert abs(r.amplitude) < 1e-12 and abs(r.mobile_fraction - np.mean([v for _, _, v in rows])) < 1e-6


def test_equal_boxes_without_area_stay(spark):
    rows = [(1, i, 3.0, 3.0, 0.0, 5.0, 0.5) for i in range(3)] + [(1, 10 + i, 20.0, 20.0, 4.0, 4.0, 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id int, id long, x double, y double, width double, height double, confidence double")
    assert sorted(r.id for r in B.nms_boxes(df, 0.5).collect()) == [0, 1, 2, 10]


def test_neighbours_however_far(spark):
    rng = np.random.default_rng(17)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (300, 2)))] + [(300, 1e6, 1e6)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("frame", F.lit(0))
    got = {r.id: r.nn_dist for r in S.nearest_neighbour(df, ["frame"]).collect()}
    p = np.array([r[1:] for r in rows])
    d = np.hypot(*(p[:, None] - p[None]).T)
    np.fill_diagonal(d, np.inf)
    assert np.allclose([got[i] for i in range(301)], d.min(axis=0))
    far = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 1000.0, 0.0, 0)], "id long, x double, y double, frame int")
    assert [r.nn_dist for r in S.nearest_neighbour(far, ["frame"], start_radius=1e-9).collect()] == [1000.0, 1000.0]
    pos = S.positions(df, ["frame"])
    radius = S._first_side(pos, ["frame"], 1e6) / 3
    assert S.range_join(pos, pos, radius, ["frame"]).count() < 60 * 301


def test_regimes_of_a_straight_track(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(30)], "track_id long, frame int, x double, y double")
    # the first and last points see too few steps for a direction and are absorbed
    assert [(r.start, r.end, r.type) for r in L.motion_regimes(df).collect()] == [(0, 30, "linear")]


def test_drift_of_a_moving_field(spark):
    rng = np.random.default_rng(14)
    spots = rng.uniform(20, 80, size=(60, 2))
    rows = [(int(f), float(x + 0.02 * f), float(y - 0.01 * f)) for f in range(0, 400, 4) for x, y in spots]
    drift = {r.frame: r for r in L.drift_crosscorr(points(spark, rows), 400, 0.5, 100, 20, 0).collect()}
    assert abs(drift[350].drift_x - drift[50].drift_x - 6.0) < 0.6
    assert abs(drift[350].drift_y - drift[50].drift_y + 3.0) < 0.6


def test_drift_of_a_third_of_the_field(spark):
    rng = np.random.default_rng(18)
    spots = rng.uniform(0, 90, size=(80, 2))
    rows = [(f, float(x + (30.0 if f >= 100 else 0.0)), float(y - (20.0 if f >= 100 else 0.0))) for f in range(0, 200, 2) for x, y in spots]
    drift = {r.frame: r for r in L.drift_crosscorr(points(spark, rows), 200, 1.0, 100, half_window=0).collect()}
    assert abs(drift[150].drift_x - drift[50].drift_x - 30) < 0.6 and abs(drift[150].drift_y - drift[50].drift_y + 20) < 0.6


def test_suppression_across_tiles_equals_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(31)
    for tile, iou in ((20, 0.3), (8192, 0.1), (20, 0.7)):
        monkeypatch.setattr(B, "TILE", tile)
        rows = [(int(m), i, float(x), float(y), float(w), float(h), float(c)) for i, (m, x, y, w, h, c) in enumerate(np.column_stack(
            [rng.integers(0, 2, 500), rng.uniform(-300, 300, (500, 2)), 2 ** rng.uniform(2, 7, (500, 2)), np.round(rng.uniform(0, 1, 500), 1)]))]
        rows += [(0, 500, -300.0, -300.0, 650.0, 650.0, 0.55), (0, 501, -300.0, -300.0, 650.0, 650.0, 0.56)]
        df = spark.createDataFrame(rows, "image_id int, id long, x double, y double, width double, height double, confidence double")
        want = set()
        for m in (0, 1):
            kept = []
            for p in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[6], r[1])):
                for q in kept:
                    iw = max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
                    ih = max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))
                    if iw * ih / (p[4] * p[5] + q[4] * q[5] - iw * ih + 1e-6) > iou:
                        break
                else:
                    kept.append(p)
            want |= {p[1] for p in kept}
        assert {r.id for r in B.nms_boxes(df, iou).collect()} == want


def test_suppression_stores_no_pairs(spark, monkeypatch):
    # 3000 boxes that nearly all overlap each other: every table made on the way stays linear in the boxes
    rng, made = np.random.default_rng(32), []
    rows = [(1, i, float(x), float(y), 50.0, 50.0, float(c)) for i, (x, y, c) in enumerate(rng.uniform(0, 4, (3000, 3)))]
    df = spark.createDataFrame(rows, "image_id int, id long, x double, y double, width double, height double, confidence double")
    real = B.cut_lineage
    monkeypatch.setattr(B, "cut_lineage", lambda d: made.append(real(d)) or made[-1])
    assert {r.id for r in B.nms_boxes(df, 0.3).collect()} == {max(rows, key=lambda r: r[6])[1]}
    assert max(d.count() for d in made) <= 3000


def test_short_and_long_traces_fit_alike(spark, monkeypatch):
    rng = np.random.default_rng(33)
    rows = [(k, i, float(v)) for k in range(6) for i, v in enumerate((k - 2) * np.exp(-0.1 * np.arange(50)) + rng.normal(0, 0.2, 50))]
    rows += [(9, 0, 1.0), (9, 1, 2.0)]
    df = spark.createDataFrame(rows, "trace_id int, t int, value double")
    for fit in (FT.fit_exp_decay, FT.fit_exp_recovery):
        monkeypatch.setattr(FT, "SHORT", 16_384)
        inside = {r.trace_id: r[1:] for r in fit(df).collect()}
        monkeypatch.setattr(FT, "SHORT", 10)
        summed = {r.trace_id: r[1:] for r in fit(df).collect()}
        assert sorted(inside) == sorted(summed) == list(range(6))
        for k in inside:
            assert np.allclose(inside[k], summed[k], rtol=1e-5, atol=1e-8)


def test_duplicates_in_a_clump_are_not_compared_in_pairs(spark, monkeypatch):
    rng, joined = np.random.default_rng(34), []
    spots = np.round(np.concatenate([rng.uniform(0, 3, (800, 2)), rng.uniform(0, 60, (200, 2))]), 3)
    rows = [(0, i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(spots, rng.integers(0, 50, 1000), strict=True))]
    df = spark.createDataFrame(rows, "frame int, id long, x double, y double, intensity double")
    want = {i for _, i, x, y, v in rows if not any(
        (w > v or w == v and j < i) and np.sqrt((x - p) ** 2 + (y - q) ** 2) <= 4.0 for _, j, p, q, w in rows)}
    real = S.range_join
    monkeypatch.setattr(S, "range_join", lambda *a: joined.append(real(*a)) or joined[-1])
    assert {r.id for r in S.duplicate_remove(df, 4.0).collect()} == want
    assert joined[0].count() < 20_000


def test_samples_around_shared_places_are_taken_once(spark):
    """3000 points on a few places of a 6 x 6 frame, some outside it or without one; no table of points times pixels is broadcast."""
    pixels = spark.range(36).selectExpr("0 AS frame", "int(id div 6) AS y", "int(id % 6) AS x", "double(id * id) AS value")
    rows = spark.range(3000).selectExpr("id", "0 AS frame", "id % 9 - 2.0D AS x", "IF(id % 7 = 0, null, id % 11 - 3.0D) AS y")
    out = L.track_intensity_sample(rows, pixels, "Mean 5x5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.partition("BroadcastExchange")[2]
    a = np.square(np.arange(36.0)).reshape(6, 6)
    for r in out.collect():
        y, x = r.y, int(r.x)
        box = a[:0] if y is None else a[max(int(y) - 2, 0):max(int(y) + 3, 0), max(x - 2, 0):max(x + 3, 0)]
        assert r.sampled == pytest.approx(box.mean()) if box.size else r.sampled is None


def test_neighbours_inside_tasks_and_by_joins_agree(spark, monkeypatch):
    """Frames of 1 to 1500 positions with clumps, copies, ties and far points, counted and searched in tasks and (no group is held) by joins."""
    rng = np.random.default_rng(31)
    rows = [(f, float(x) + 1e5, float(y)) for f, n in enumerate((1, 2, 40, 1500, 600)) for x, y in rng.uniform(0, 128, (n, 2)).round(f)]
    rows += [(3, 1e5 + float(x), float(y)) for x, y in rng.normal(40, 0.5, (700, 2))] + rows[-80:] + [(4, 5e5, 5e5), (2, float("nan"), 1.0), (1, None, 2.0)]
    df, radii = points(spark, rows), (3, 5, 10, 20, 30)
    joins, plain = [], S.range_join
    monkeypatch.setattr(S, "range_join", lambda *a: joins.append(a) or plain(*a))
    near = S.frame_neighbours(df, radii).collect()
    assert not joins
    got = {r.id: (r.nn_dist, r.nn_id, *(r[S.within_name(v)] for v in radii)) for r in near}
    for f in range(5):
        ids = np.array([i for i, r in enumerate(rows) if r[0] == f and r[1] is not None and r[1] == r[1]])
        xy = np.array([rows[i][1:] for i in ids])
        d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
        others = d + np.where(np.eye(len(ids)), np.inf, 0)
        for k, i in enumerate(ids):
            best = others[k].min()
            assert got.pop(int(i)) == (*((None, None) if best == np.inf else (best, int(ids[others[k] == best].min()))), *(int((d[k] <= v).sum()) - 1 for v in radii))
    assert not got
    monkeypatch.setattr("pixelweave.operators.near.HELD", 0)
    assert sorted(map(str, S.frame_neighbours(df, radii).collect())) == sorted(map(str, near)) and joins


@pytest.mark.parametrize("held", [None, 60, 0])
def test_matching_of_copies_and_ties_equals_sorted_greedy(spark, monkeypatch, held):
    """Points on a lattice (many equal distances) with copies and shuffled ids, in islands and frames; an id that comes twice counts once; by tasks, islands and joins."""
    if held is not None:
        monkeypatch.setattr("pixelweave.operators.near.HELD", held)
    rng = np.random.default_rng(32)

    def side(shift, n, twice):
        xy = [(f, float(x) + shift + 40 * int(rng.integers(3)), float(y)) for f in range(2) for x, y in rng.integers(0, 6, (n, 2))]
        ids = rng.permutation(len(xy))
        return [(int(i), *p) for i, p in zip(ids, xy, strict=True)] + [(int(ids[k]), *xy[k + 1]) for k in range(twice)]

    for twice in (0, 3):
        a, b = side(0.0, 70, twice), side(0.5, 60, twice)
        want, used_a, used_b = set(), set(), set()
        for d, i, j, f in sorted((np.hypot(x - u, y - v), i, j, f) for i, f, x, y in a for j, g, u, v in b if f == g):
            if d <= 1.5 and (f, i) not in used_a and (f, j) not in used_b:
                used_a.add((f, i)), used_b.add((f, j)), want.add((f, i, j))
        schema = "id long, frame int, x double, y double"
        got = E.match_greedy(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 1.5, ["frame"]).collect()
        assert len(got) == len(want) and {(r.frame, r.det, r.gt) for r in got} == want


def test_matching_stores_no_pairs(spark, monkeypatch):
    """300 copies of a point against 300 of another: no join of candidates, one match for each."""
    monkeypatch.setattr(E, "range_join", None)
    a, b = (points(spark, [(0, x, 1.0)] * 300) for x in (1.0, 1.5))
    assert sorted((r.det, r.gt) for r in E.match_greedy(a, b, 1.0, ["frame"]).collect()) == [(i, i) for i in range(300)]


def test_linking_of_copies_on_a_lattice_equals_the_sequential_rule(spark, monkeypatch):
    """Places of up to five copies at many equal distances, shared among tracks; a tile stores its points, not its edges."""
    rng = np.random.default_rng(33)
    rows = [(f, float(x), float(y)) for f in range(7) for x, y in np.repeat(rng.integers(0, 8, (9, 2)), rng.integers(1, 6, 9), axis=0)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    want, kept, plain = greedy(rows, 2.5, 1), [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: kept.append(plain(df)) or kept[-1])
    for limit in (None, 20):
        got = {r.id: r.track_id for r in L.link_greedy(points(spark, rows), 2.5, 1, 1, limit).collect()}
        assert len(got) == len(rows) and len({(want[i], t) for i, t in got.items()}) == len(set(want.values())) == len(set(got.values()))
    stored = [df.selectExpr("max(size(points))").first()[0] for df in kept if "points" in df.columns]
    assert len(stored) == 2 and max(stored) <= len(rows)


def test_diameters_come_from_flat_arrays(spark):
    """A batch of tracks costs little beyond its numbers, and gives the diameters and hulls of each track."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(37)
    sizes = rng.integers(1, 120, size=400)
    xy = rng.normal(size=(sizes.sum(), 2))
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    batch = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(xy[:, i].copy()) for i in (0, 1)], names=["x", "y"]))
    tracemalloc.start()
    got = T._diameter_udf.func(batch).to_numpy()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)).max() for p in np.split(xy, ends[1:-1])]
    assert np.allclose(got, want, rtol=1e-12) and peak < 64 * len(xy)
    assert np.allclose(T._diameter_udf.func(T._hull_udf.func(batch.slice(5, 50))).to_numpy(), want[5:55], rtol=1e-12)


@pytest.mark.parametrize("limit", [None, 25])
def test_linking_over_long_gaps_equals_the_sequential_rule(spark, limit):
    """Points that stay open ask for edges frame after frame, inside tiles and across them."""
    rng = np.random.default_rng(41)
    rows = [(int(f), float(x), float(y)) for f in rng.choice(60, 40, replace=False) for x, y in np.concatenate([rng.uniform(0, 16, (4, 2)), rng.integers(0, 5, (2, 2))])]
    want = greedy(rows, 2.5, 8)
    got = {r.id: r.track_id for r in L.link_greedy(points(spark, rows), 2.5, 8, 1, limit).collect()}
    assert len(got) == len(rows) and len({(want[i], t) for i, t in got.items()}) == len(set(want.values())) == len(set(got.values()))


def test_a_tile_with_a_long_reach_makes_few_edges():
    """Chains without gaps cost about the same whatever the gap that is allowed."""
    import tracemalloc

    import pyarrow as pa

    frame, chain = (v.ravel() for v in np.meshgrid(np.arange(100), np.arange(40), indexing="ij"))
    zero, ident = np.zeros(frame.size, np.int64), frame * 1000 + chain
    columns = {"id": ident, "frame": frame, "sf": frame, "si": ident, "x": chain * 20.0, "y": frame * 0.02, "held": zero > 0, **{c: zero for c in ("hx", "hy", "hs", "cx", "cy", "cs")}}
    packed = L._tile_points([], 3.0, 46)(pa.table(columns))
    batch = pa.record_batch([packed["tile"].combine_chunks(), packed["points"].combine_chunks(), pa.nulls(1, packed.schema.field("points").type)], names=["tile", "points", "around"])
    tracemalloc.start()
    out = pa.Table.from_batches(L._claims(3.0, 46, True)([batch])).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(out["id"]) == sorted(ident.tolist()) and all(sf == 0 and si == i % 1000 for i, sf, si in zip(out["id"], out["sf"], out["si"], strict=True))
    assert peak < 1500 * frame.size, peak / frame.size


@pytest.mark.parametrize("apply", [False, True])
def test_fiducials_read_their_input_once(spark, tmp_path, apply):
    rows = [(u * 100 + f, f, 20.0 * u + 0.05 * f, 0.02 * f, float(u)) for u in range(8) for f in range(50) if (f + u) % 9]
    log = tmp_path / "rows"

    def seen(frames):
        for pdf in frames:
            with open(log, "a") as out:
                out.write("." * len(pdf))
            yield pdf

    schema = "id long, frame long, x double, y double, intensity double"
    locs = spark.createDataFrame(rows, schema).mapInPandas(seen, schema)
    if apply:
        got = {r.id: r.x for r in L.drift_fiducial_apply(locs, 50, 0.8, 56.0).collect()}
        assert len(got) == len(rows) and abs(got[325] - 60.0) < 0.2 and abs(rows[-1][2] - got[rows[-1][0]] - 2.3) < 0.2
    else:
        got = [r.id for r in L.fiducial_identify(locs, 50, 0.8, 56.0).collect()]
        assert sorted(got) == [r[0] for r in rows if r[4] >= 4]
    assert len(log.read_text()) == len(rows)


def test_line_ids_beyond_64_bits(spark, tmp_path):
    """Order keys of a table 360 times sf0.1 leave 64 bits; the queries on line items still take every row."""
    from pixelweave.plans import fixtures as fx
    from pixelweave.plans import registry

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(300).withColumn("l_orderkey", F.col("l_orderkey") + F.when(F.col("l_linenumber") > 3, 53_000_000).otherwise(11_529_000))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    key = [F.col(f"l_{c}").cast("long") for c in ("orderkey", "linenumber", "partkey", "suppkey", "quantity")]
    want = {(((((o * 8 + n) * 100000 + p) * 10000 + s) * 100 + q) + 2**63) % 2**64 - 2**63 for o, n, p, s, q in rows.select(*key).collect()}
    assert {r.id for r in fx.locs(spark, str(tmp_path)).select("id").collect()} == {r.id for r in fx.boxes(spark, str(tmp_path)).select("id").collect()} == want
    counts = {name: registry.queries()[name](spark, str(tmp_path)).count() for name in ("neighbour_counts", "nms_boxes", "localization_metrics")}
    assert counts["neighbour_counts"] == 300 and 0 < counts["nms_boxes"] <= 300 and counts["localization_metrics"] == 1


def test_points_of_no_other_tile_are_settled_as_the_tile_is_gathered(spark, monkeypatch):
    """Two pairs in one tile: the one that a point of the next tile may compete for goes to the rounds, the other does not."""
    import pyarrow as pa

    near, far = [(0, 7.5, 1.0), (1, 7.8, 1.0)], [(0, 2.0, 2.0), (1, 2.1, 2.0), (1, 2.1, 2.0)]
    rows = [*((*r, 0) for r in near + far), (0, 8.2, 1.0, 1)]
    columns = {"id": pa.array(range(len(rows))), "frame": pa.array([r[0] for r in rows]), "sf": pa.array([r[0] for r in rows]), "si": pa.array(range(len(rows))),
               "x": pa.array([r[1] for r in rows]), "y": pa.array([r[2] for r in rows]), "held": pa.array([False] * len(rows)), "hx": pa.array([r[3] for r in rows])}
    columns |= {c: pa.array([0] * len(rows)) for c in ("hy", "hs", "cx", "cy", "cs")}
    row = L._tile_points([], 1.0, 1)(pa.table(columns)).to_pylist()[0]
    assert {p["id"] for p in row["points"]} == {0, 1, 5}
    assert row["settled"] == [{"id": 3, "sf": 0, "si": 2}]
    cloud = points(spark, [(f, float(x), 0.0) for x in range(0, 40, 4) for f in range(6)])
    for least, tracks in ((1, 10), (6, 10), (7, 0)):
        got = L.link_greedy(cloud, 1.0, 0, least).collect()
        assert len(got) == 60 and len({r.track_id for r in got} - {-1}) == tracks


def test_fiducials_hop_any_number_of_frames(spark):
    """A bead that is missing for longer than its share of missing frames allows is still one track."""
    beads = {0: [*range(8), *range(45, 73)], 1: range(73)}
    rows = [(u * 100 + f, f, 20.0 * u + 0.01 * f, 0.0, 5.0 + u) for u, frames in beads.items() for f in frames]
    locs = spark.createDataFrame(rows, "id long, frame long, x double, y double, intensity double")
    got = L.fiducial_identify(locs, 72, 0.5, 0.0).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    assert len({r.track_id for r in got}) == 2


def test_a_long_reach_over_tiles_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(23)
    rows = [(int(f), float(x), float(y)) for f in sorted(rng.choice(60, 25, replace=False)) for x, y in rng.uniform(0, 40, size=(4, 2))]
    want = greedy(rows, 3.0, 59)
    got = {r.id: r.track_id for r in L.link_greedy(points(spark, rows), 3.0, 59, 1, 40).collect()}
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a, b in itertools.combinations(range(len(rows)), 2))
