"""Checked queries over pixel neighbourhoods, labels and points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import components as K
from pixelweave.operators import evaluation as E
from pixelweave.operators import pixels as P
from pixelweave.operators import render as R
from pixelweave.operators import spatial as S
from pixelweave.operators import stencil as N
from pixelweave.operators.temporal import gaussian_weights
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query

ST = fx.STACK
PX = "movie_id, frame, y, x"
EDGE = {"nearest": "least(greatest({t}, 0), 7)", "reflect": "CASE WHEN {t} < 0 THEN -1 - ({t}) WHEN {t} > 7 THEN 15 - ({t}) ELSE {t} END",
        "mirror": "CASE WHEN {t} < 0 THEN -({t}) WHEN {t} > 7 THEN 14 - ({t}) ELSE {t} END", "constant": "{t}"}


def out(df, *cols):
    return df.select("movie_id", "frame", "y", "x", *(cols or ("value",)))


def values(kernel) -> str:
    k = np.asarray(kernel, dtype=float)
    oy, ox = k.shape[0] // 2, k.shape[1] // 2
    return ", ".join(f"({i - oy}, {j - ox}, CAST({float(k[i, j])!r} AS DOUBLE))" for i in range(k.shape[0]) for j in range(k.shape[1]) if k[i, j])


def conv_cte(name: str, kernel, mode: str, source: str = "stack", agg: str = "sum(k.wt * n.value)") -> str:
    y, x = EDGE[mode].format(t="s.y + k.dy"), EDGE[mode].format(t="s.x + k.dx")
    return (f"{name} AS (SELECT s.movie_id, s.frame, s.y, s.x, {agg} AS value FROM {source} s CROSS JOIN (VALUES {values(kernel)}) k(dy, dx, wt) "
            f"JOIN {source} n ON n.movie_id = s.movie_id AND n.frame = s.frame AND n.y = {y} AND n.x = {x} GROUP BY 1, 2, 3, 4)")


def conv_sql(kernel, mode: str, agg: str = "sum(k.wt * n.value)") -> str:
    return f"WITH {ST}, {conv_cte('c', kernel, mode, agg=agg)} SELECT {PX}, value FROM c"


def two(a, b, mode: str, expr: str) -> str:
    return (f"WITH {ST}, {conv_cte('ca', a, mode)}, {conv_cte('cb', b, mode)} SELECT a.movie_id, a.frame, a.y, a.x, {expr} AS value "
            "FROM ca a JOIN cb b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y AND a.x = b.x")


def outer(wy, wx=None):
    return np.outer(wy, wy if wx is None else wx)


def stencil(name, sql, op, doubles="value"):
    @query(name, sql, doubles if sql else "")
    def _(spark, sf):
        return out(op(fx.stack(spark, sf)))


G1, G2 = gaussian_weights(1.0), gaussian_weights(1.6)
BOX3, BOX5 = np.full(3, 1 / 3), np.full(5, 1 / 5)
SOB = outer((0.25, 0.5, 0.25), (-1, 0, 1))
stencil("gaussian_blur", conv_sql(outer(G1), "nearest"), lambda d: N.gaussian_blur(d, 1.0))
stencil("gaussian_blur_constant", conv_sql(outer(G1), "constant"), lambda d: N.gaussian_blur(d, 1.0, norm_edges=True))
stencil("difference_of_gaussians", two(outer(G1), outer(G2), "nearest", "a.value - b.value"), lambda d: N.difference_of_gaussians(d, 1.0, 1.6))
stencil("sobel", two(SOB, SOB.T, "reflect", "sqrt((a.value ** 2 + b.value ** 2) / 2)"), N.sobel)
stencil("laplacian", conv_sql([[0, -1, 0], [-1, 4, -1], [0, -1, 0]], "reflect"), N.laplacian)
D0, D1, D2 = (N.gaussian_derivative(1.0, o) for o in range(3))
stencil("gaussian_laplace", two(outer(D2, D0), outer(D0, D2), "reflect", "a.value + b.value"), lambda d: N.gaussian_laplace(d, 1.0))
stencil("gaussian_gradient_magnitude", two(outer(D1, D0), outer(D0, D1), "reflect", "sqrt(a.value ** 2 + b.value ** 2)"), lambda d: N.gaussian_gradient_magnitude(d, 1.0))
(GCY, GCX), (GSY, GSX) = N.gabor_weights(0.25, math.pi / 6)
stencil("gabor", conv_sql(outer(GCY, GCX) - outer(GSY, GSX), "reflect"), lambda d: N.gabor(d, 0.25, math.pi / 6))
stencil("maximum_filter", conv_sql(np.ones((3, 3)), "reflect", "max(n.value)"), lambda d: N.maximum_filter(d, 3))
stencil("minimum_filter", conv_sql(np.ones((5, 5)), "reflect", "min(n.value)"), lambda d: N.minimum_filter(d, 5))
stencil("maximum_filter_even", conv_sql(np.ones((4, 4)), "reflect", "max(n.value)"), lambda d: N.maximum_filter(d, 4))
stencil("percentile_filter", conv_sql(np.ones((3, 3)), "reflect", "list_sort(list(n.value))[3]"), lambda d: N.percentile_filter(d, 25, 3))
stencil("median_2d", conv_sql(np.ones((3, 3)), "reflect", "quantile_cont(n.value, 0.5)"), lambda d: N.median_2d(d, 3))
stencil("box_filter", conv_sql(outer(BOX3), "reflect"), lambda d: N.box_filter(d, 3))
stencil("lowered_gaussian", two(outer(G2), outer(BOX3), "reflect", "a.value - b.value"), lambda d: N.lowered_gaussian(d))
stencil("difference_of_averaging", two(outer(BOX3), outer(BOX5), "reflect", "a.value - b.value"), lambda d: N.difference_of_averaging(d))
stencil("grayscale_opening", f"WITH {ST}, {conv_cte('e', np.ones((3, 3)), 'reflect', agg='min(n.value)')}, {conv_cte('d', np.ones((3, 3)), 'reflect', 'e', 'max(n.value)')} SELECT {PX}, value FROM d",
        lambda d: N.grayscale_opening(d, 3))
stencil("grayscale_closing", f"WITH {ST}, {conv_cte('e', np.ones((3, 3)), 'reflect', agg='max(n.value)')}, {conv_cte('d', np.ones((3, 3)), 'reflect', 'e', 'min(n.value)')} SELECT {PX}, value FROM d",
        lambda d: N.grayscale_closing(d, 3))
stencil("morphological_gradient", conv_sql(np.ones((3, 3)), "reflect", "max(n.value) - min(n.value)"), lambda d: N.morphological_gradient(d, 3))
B3 = np.array([1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16])
B3D = np.zeros(9)
B3D[::2] = B3
stencil("bspline_wavelet", f"WITH {ST}, {conv_cte('s1', outer(B3), 'constant')}, {conv_cte('s2', outer(B3D), 'constant', 's1')} SELECT a.movie_id, a.frame, a.y, a.x, a.value - b.value AS value FROM s1 a JOIN s2 b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y AND a.x = b.x",
        lambda d: N.bspline_wavelet(d, 2))
stencil("compound_filter", f"WITH {ST}, {conv_cte('s1', outer(B3), 'constant')}, wv AS (SELECT a.movie_id, a.frame, a.y, a.x, a.value - b.value AS value FROM stack a JOIN s1 b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y AND a.x = b.x), {conv_cte('g', outer(G1), 'reflect', 'wv')} SELECT {PX}, value FROM g",
        lambda d: N.compound_filter(d, [("wavelet", {"scale": 1}), ("gaussian", {"sigma": 1.0})]))
stencil("lbp_8", conv_sql([[1, 2, 4], [128, 0, 8], [64, 32, 16]], "mirror", "sum(CASE WHEN n.value >= s.value THEN k.wt ELSE 0 END) / 255"), N.lbp_8)
BIN = ST + ", b AS (SELECT movie_id, frame, y, x, CAST(value > 0.05 AS INT) AS value FROM stack)"
CROSS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
DIAMOND = [[0, 0, 1, 0, 0], [0, 1, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 1, 1, 0], [0, 0, 1, 0, 0]]


def morph(name, kernel, agg, op):
    stencil(name, f"WITH {BIN}, {conv_cte('m', kernel, 'constant', 'b', agg)} SELECT {PX}, CAST(value AS INT) AS value FROM m", lambda d: op(P.threshold(d, 0.05)), "")


morph("binary_dilation", DIAMOND, "max(n.value)", lambda d: N.binary_dilation(d, 1, 2))
morph("binary_dilation_box", np.ones((3, 3)), "max(n.value)", lambda d: N.binary_dilation(d, 2, 1))
morph("binary_erosion", CROSS, "CASE WHEN count(*) = 5 THEN min(n.value) ELSE 0 END", lambda d: N.binary_erosion(d, 1, 1))
morph("binary_erosion_box", np.ones((3, 3)), "CASE WHEN count(*) = 9 THEN min(n.value) ELSE 0 END", lambda d: N.binary_erosion(d, 2, 1))
GA = gaussian_weights((5 - 1) / 6.0)


@query("adaptive_threshold", f"WITH {ST}, {conv_cte('m', outer(GA), 'reflect')} SELECT s.movie_id, s.frame, s.y, s.x, m.value - 0.01 AS surface, CAST(s.value > m.value - 0.01 AS INT) AS value FROM stack s JOIN m ON s.movie_id = m.movie_id AND s.frame = m.frame AND s.y = m.y AND s.x = m.x", "surface")
def _(spark, sf):
    return out(N.adaptive_threshold(fx.stack(spark, sf), 0.01, 5), "surface", "value")


@query("structure_tensor")
def _(spark, sf):
    return out(N.structure_tensor(fx.stack(spark, sf), 1.0), "coherency", "orientation")


@query("pixel_features")
def _(spark, sf):
    return N.pixel_features(fx.stack(spark, sf), (1.0,), (0.25,), 2).drop("h", "w")


@query("skeleton_pixels", f"WITH {BIN}, {conv_cte('n', [[1, 1, 1], [1, 0, 1], [1, 1, 1]], 'constant', 'b')} SELECT b.movie_id, b.frame, b.y, b.x, CASE WHEN n.value = 1 THEN 'endpoint' ELSE 'branch' END AS kind FROM b JOIN n ON b.movie_id = n.movie_id AND b.frame = n.frame AND b.y = n.y AND b.x = n.x WHERE b.value = 1 AND (n.value = 1 OR n.value >= 3)")
def _(spark, sf):
    return out(N.skeleton_pixels(P.threshold(fx.stack(spark, sf), 0.05)), "kind")


TPL = [[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 0.0]]
CEN = np.asarray(TPL) - np.mean(TPL)


@query("template_match", f"""WITH {ST}, k AS (SELECT * FROM (VALUES {", ".join(f"({i}, {j}, CAST({float(CEN[i, j])!r} AS DOUBLE))" for i in range(3) for j in range(3))}) v(dy, dx, wt)),
  c AS (SELECT s.movie_id, s.frame, s.y, s.x, sum(wt * n.value) / (sqrt(greatest(sum(n.value ** 2) - sum(n.value) ** 2 / 9, 0)) * {math.sqrt((CEN ** 2).sum())!r}) AS value FROM stack s CROSS JOIN k JOIN stack n ON n.movie_id = s.movie_id AND n.frame = s.frame AND n.y = s.y + dy AND n.x = s.x + dx WHERE s.y <= 5 AND s.x <= 5 GROUP BY 1, 2, 3, 4)
  SELECT {PX}, value FROM c""", "value")
def _(spark, sf):
    return out(N.template_match(fx.stack(spark, sf), TPL))


@query("distance_transform", f"""WITH {BIN} SELECT s.movie_id, s.frame, s.y, s.x, sqrt(min((s.y - z.y) ** 2 + (s.x - z.x) ** 2)) AS value FROM b s JOIN b z ON s.movie_id = z.movie_id AND s.frame = z.frame AND z.value = 0 GROUP BY 1, 2, 3, 4""", "value")
def _(spark, sf):
    return out(N.distance_transform(P.threshold(fx.stack(spark, sf), 0.05)))


@query("estimate_noise", f"""WITH {ST}, {conv_cte('l', [[0, 1, 0], [1, -4, 1], [0, 1, 0]], 'reflect')}, m AS (SELECT movie_id, frame, quantile_cont(value, 0.5) AS md FROM l GROUP BY 1, 2)
  SELECT l.movie_id, l.frame, greatest(quantile_cont(abs(value - md), 0.5) * 1.4826 / sqrt(20), 1e-6) AS noise FROM l JOIN m ON l.movie_id = m.movie_id AND l.frame = m.frame GROUP BY 1, 2""", "noise")
def _(spark, sf):
    from pixelweave.operators.detection import estimate_noise

    return estimate_noise(fx.stack(spark, sf))


@query("background_global", f"""WITH {ST}, m AS (SELECT movie_id, frame, quantile_cont(value * 100, 0.25) AS bg, quantile_cont(value * 100, 0.5) AS md FROM stack GROUP BY 1, 2)
  SELECT s.movie_id, s.frame, any_value(bg) AS background, greatest(quantile_cont(abs(value * 100 - md), 0.5) * 1.4826, 1) AS noise FROM stack s JOIN m ON s.movie_id = m.movie_id AND s.frame = m.frame GROUP BY 1, 2""", "background noise")
def _(spark, sf):
    from pixelweave.operators.detection import background_global

    return background_global(P.multiply(fx.stack(spark, sf), 100.0))


# -- labels -----------------------------------------------------------------

RECURSIVE = BIN + """, fg AS (SELECT *, y * 8 + x AS p FROM b WHERE value = 1),
reach(movie_id, frame, p, q) AS (SELECT movie_id, frame, p, p FROM fg UNION SELECT r.movie_id, r.frame, r.p, n.p FROM reach r JOIN fg c ON c.movie_id = r.movie_id AND c.frame = r.frame AND c.p = r.q
  JOIN fg n ON n.movie_id = c.movie_id AND n.frame = c.frame AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1),
cc AS (SELECT movie_id, frame, p, min(q) AS root FROM reach GROUP BY 1, 2, 3),
lab AS (SELECT f.movie_id, f.frame, f.y, f.x, CAST(dense_rank() OVER (PARTITION BY f.movie_id, f.frame ORDER BY root) AS INT) AS label FROM cc JOIN fg f ON f.movie_id = cc.movie_id AND f.frame = cc.frame AND f.p = cc.p)"""


def binary(spark, sf):
    return P.threshold(fx.stack(spark, sf), 0.05)


def labelled(spark, sf):
    return K.connected_components(binary(spark, sf).withColumn("label", F.col("value")), 2)


@query("connected_components", f"WITH RECURSIVE {RECURSIVE} SELECT * FROM lab")
def _(spark, sf):
    return out(labelled(spark, sf), "label")


@query("remove_small_blobs", f"WITH RECURSIVE {RECURSIVE}, a AS (SELECT movie_id, frame, label, count(*) AS n FROM lab GROUP BY 1, 2, 3) SELECT b.movie_id, b.frame, b.y, b.x, CASE WHEN n < 4 THEN 0 ELSE b.value END AS value FROM b LEFT JOIN lab l ON b.movie_id = l.movie_id AND b.frame = l.frame AND b.y = l.y AND b.x = l.x LEFT JOIN a ON a.movie_id = l.movie_id AND a.frame = l.frame AND a.label = l.label", "value")
def _(spark, sf):
    return out(K.remove_small_blobs(binary(spark, sf), 4, 2))


@query("remove_small_holes")
def _(spark, sf):
    return out(K.remove_small_holes(binary(spark, sf), 3))


@query("hysteresis_threshold", f"WITH RECURSIVE {RECURSIVE}, t AS (SELECT l.*, max(s.value) OVER (PARTITION BY l.movie_id, l.frame, label) AS top FROM lab l JOIN stack s ON s.movie_id = l.movie_id AND s.frame = l.frame AND s.y = l.y AND s.x = l.x) SELECT s.movie_id, s.frame, s.y, s.x, CASE WHEN top > 0.2 THEN 1 ELSE 0 END AS value FROM stack s LEFT JOIN t ON s.movie_id = t.movie_id AND s.frame = t.frame AND s.y = t.y AND s.x = t.x", "value")
def _(spark, sf):
    return out(K.hysteresis_threshold(fx.stack(spark, sf), 0.05, 0.2))


@query("flood_fill")
def _(spark, sf):
    return out(K.flood_fill(fx.stack(spark, sf), 4, 4, 0.15, 9.0))


@query("analyze_particles", f"""WITH RECURSIVE {RECURSIVE}, g AS (SELECT l.movie_id, l.frame, label, count(*) AS area, avg(l.y) AS centroid_y, avg(l.x) AS centroid_x, min(l.y) AS bbox_y0, min(l.x) AS bbox_x0, max(l.y) AS bbox_y1, max(l.x) AS bbox_x1, avg(s.value) AS mean_intensity
   FROM lab l JOIN stack s ON s.movie_id = l.movie_id AND s.frame = l.frame AND s.y = l.y AND s.x = l.x GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 2 AND 12)
  SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY movie_id, frame ORDER BY label) AS INT) AS label) FROM g""", "centroid_y centroid_x mean_intensity")
def _(spark, sf):
    return K.analyze_particles(binary(spark, sf), 2, 12, fx.stack(spark, sf))


@query("region_table")
def _(spark, sf):
    return K.region_table(labelled(spark, sf), 3)


QUAD = ST + ", q AS (SELECT movie_id, frame, y, x, CASE WHEN value > 0.05 THEN CAST(1 + (y // 3) * 3 + x // 3 AS INT) ELSE 0 END AS label FROM stack)"


def quad(spark, sf):
    return fx.stack(spark, sf).withColumn("label", F.when(F.col("value") > 0.05, (1 + F.floor(F.col("y") / 3) * 3 + F.floor(F.col("x") / 3)).cast("int")).otherwise(0))


@query("clear_border", f"WITH {QUAD}, e AS (SELECT DISTINCT movie_id, frame, label FROM q WHERE label > 0 AND (y = 0 OR x = 0 OR y = 7 OR x = 7)) SELECT q.* FROM q ANTI JOIN e ON q.movie_id = e.movie_id AND q.frame = e.frame AND q.label = e.label")
def _(spark, sf):
    return out(K.clear_border(quad(spark, sf)), "label")


@query("expand_labels", f"""WITH {QUAD}, n AS (SELECT a.movie_id, a.frame, a.y, a.x, min({{'d': (a.y - b.y) ** 2 + (a.x - b.x) ** 2, 'l': b.label}}) AS m FROM q a JOIN q b ON a.movie_id = b.movie_id AND a.frame = b.frame AND b.label > 0 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4 GROUP BY 1, 2, 3, 4)
  SELECT q.movie_id, q.frame, q.y, q.x, CASE WHEN q.label > 0 THEN q.label ELSE coalesce(n.m.l, 0) END AS label FROM q LEFT JOIN n ON q.movie_id = n.movie_id AND q.frame = n.frame AND q.y = n.y AND q.x = n.x""")
def _(spark, sf):
    return out(K.expand_labels(quad(spark, sf), 2.0), "label")


@query("find_boundaries", f"WITH {QUAD} SELECT a.movie_id, a.frame, a.y, a.x, CAST(max(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS INT) AS value FROM q a JOIN q b ON a.movie_id = b.movie_id AND a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return out(K.find_boundaries(quad(spark, sf)))


@query("local_maxima", f"""WITH {ST} SELECT a.movie_id, a.frame, a.y, a.x, any_value(a.value) AS value FROM stack a JOIN stack b ON a.movie_id = b.movie_id AND a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)
  GROUP BY 1, 2, 3, 4 HAVING any_value(a.value) > max(b.value)""", "value")
def _(spark, sf):
    return out(K.local_maxima(fx.stack(spark, sf)))


@query("multi_otsu")
def _(spark, sf):
    return out(K.multi_otsu(fx.stack(spark, sf), 3, 64), "threshold0", "threshold1", "value")


@query("segmentation_metrics", f"""WITH {fx.PAIRS}, c AS (SELECT movie_id, count(*) FILTER (WHERE v1 > 0 AND v2 > 0) AS tp, count(*) FILTER (WHERE v1 <= 0 AND v2 > 0) AS fp, count(*) FILTER (WHERE v1 > 0 AND v2 <= 0) AS fn, count(*) FILTER (WHERE v1 <= 0 AND v2 <= 0) AS tn FROM pair GROUP BY 1)
  SELECT *, tp / (tp + fp + fn) AS jaccard, 2 * tp / (2 * tp + fp + fn) AS dice, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c""", "jaccard dice precision recall accuracy")
def _(spark, sf):
    ch = fx.channels(spark, sf)
    per_frame = E.segmentation_metrics(P.split_channel(ch, 0), P.split_channel(ch, 1), ["movie_id", "frame"])
    return E.segmentation_rates(per_frame.groupBy("movie_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


@query("instance_iou_match", f"""WITH {ST}, l AS (SELECT movie_id, frame, CASE WHEN value > -0.1 THEN 1 + (y // 4) * 2 + x // 4 ELSE 0 END AS gt, CASE WHEN value > 0 THEN 1 + (y // 4) * 2 + x // 4 ELSE 0 END AS pred FROM stack),
  g AS (SELECT movie_id, frame, gt, count(*) AS ga FROM l WHERE gt > 0 GROUP BY ALL), p AS (SELECT movie_id, frame, pred, count(*) AS pa FROM l WHERE pred > 0 GROUP BY ALL),
  i AS (SELECT movie_id, frame, gt, pred, count(*) AS n FROM l WHERE gt > 0 AND pred > 0 GROUP BY ALL),
  m AS (SELECT i.movie_id, i.frame, n / (ga + pa - n) AS iou FROM i JOIN g ON i.movie_id = g.movie_id AND i.frame = g.frame AND i.gt = g.gt JOIN p ON i.movie_id = p.movie_id AND i.frame = p.frame AND i.pred = p.pred WHERE n / (ga + pa - n) > 0.5),
  f AS (SELECT DISTINCT movie_id, frame FROM l WHERE gt > 0 OR pred > 0), t AS (SELECT f.movie_id, f.frame, (SELECT count(*) FROM m WHERE m.movie_id = f.movie_id AND m.frame = f.frame) AS tp, (SELECT sum(iou) FROM m WHERE m.movie_id = f.movie_id AND m.frame = f.frame) AS s,
   (SELECT count(*) FROM g WHERE g.movie_id = f.movie_id AND g.frame = f.frame) AS ng, (SELECT count(*) FROM p WHERE p.movie_id = f.movie_id AND p.frame = f.frame) AS np FROM f)
  SELECT movie_id, frame, CASE WHEN tp > 0 THEN s / tp ELSE 0 END AS segmentation_quality, 2 * tp / greatest(ng + np, 1) AS recognition_quality, CASE WHEN tp > 0 THEN s / tp ELSE 0 END * 2 * tp / greatest(ng + np, 1) AS panoptic_quality, np - tp AS over_segmentation, ng - tp AS under_segmentation FROM t""",
       "segmentation_quality recognition_quality panoptic_quality")
def _(spark, sf):
    cell = 1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
    l = fx.stack(spark, sf).withColumn("gt", F.when(F.col("value") > -0.1, cell).otherwise(0)).withColumn("pred", F.when(F.col("value") > 0, cell).otherwise(0))
    return E.instance_iou_match(l, ["movie_id", "frame"])


# -- points -----------------------------------------------------------------

LO = fx.LOCS
CLOSE = "a.frame = b.frame AND a.id <> b.id"
D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"


@query("nearest_neighbour", f"WITH {LO}, p AS (SELECT a.id, min({{'d': {D}, 'i': b.id}}) AS m FROM locs a JOIN locs b ON {CLOSE} GROUP BY 1) SELECT l.id, l.frame, p.m.d AS nn_dist, p.m.i AS nn_id FROM locs l LEFT JOIN p ON l.id = p.id", "nn_dist")
def _(spark, sf):
    return S.nearest_neighbour(fx.locs(spark, sf), ["frame"]).select("id", "frame", "nn_dist", "nn_id")


@query("neighbour_counts", f"WITH {LO} SELECT l.id, " + ", ".join(f"(count(*) FILTER (WHERE d <= {r})) AS n_within_{r}" for r in (3, 5, 10, 20, 30))
       + f" FROM locs l LEFT JOIN (SELECT a.id, {D} AS d FROM locs a JOIN locs b ON {CLOSE}) p ON l.id = p.id GROUP BY 1")
def _(spark, sf):
    return S.neighbour_counts(fx.locs(spark, sf), ["frame"]).select("id", *[f"n_within_{r}" for r in (3, 5, 10, 20, 30)])


@query("frame_neighbours", f"WITH {LO}, p AS (SELECT a.id, min({{'d': {D}, 'i': b.id}}) AS m, count(*) FILTER (WHERE {D} <= 10) AS c10 FROM locs a JOIN locs b ON {CLOSE} GROUP BY 1) SELECT l.id, l.frame, p.m.d AS nn_dist, p.m.i AS nn_id, coalesce(c10, 0) AS n_within_10 FROM locs l LEFT JOIN p ON l.id = p.id", "nn_dist")
def _(spark, sf):
    return S.frame_neighbours(fx.locs(spark, sf), (10,)).select("id", "frame", "nn_dist", "nn_id", "n_within_10")


@query("molecular_merge", f"""WITH {LO}, r AS (SELECT *, dense_rank() OVER (ORDER BY frame) AS rk FROM locs), s AS (SELECT x, y, unnest([rk + 1, rk + 2]) AS rk FROM r) SELECT a.id, a.frame, a.x, a.y FROM r a ANTI JOIN s b ON b.rk = a.rk AND {D} <= 4""", "x y")
def _(spark, sf):
    return S.molecular_merge(fx.locs(spark, sf), 4.0, 2).select("id", "frame", "x", "y")


@query("duplicate_remove", f"WITH {LO} SELECT a.id, a.frame, a.x, a.y, a.intensity FROM locs a ANTI JOIN locs b ON a.frame = b.frame AND a.id <> b.id AND {D} <= 10 AND (b.intensity > a.intensity OR (b.intensity = a.intensity AND b.id < a.id))", "x y intensity")
def _(spark, sf):
    return S.duplicate_remove(fx.locs(spark, sf), 10.0).select("id", "frame", "x", "y", "intensity")


@query("local_density_filter", f"""WITH {LO}, c AS (SELECT *, CAST(floor(x) AS INT) AS cx, CAST(floor(y) AS INT) AS cy FROM locs), o AS (SELECT unnest(range(-1, 2)) AS dx),
  n AS (SELECT a.id, count(*) - 1 AS n FROM c a CROSS JOIN o p CROSS JOIN o q JOIN c b ON b.cx = a.cx + p.dx AND b.cy = a.cy + q.dx WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1.0 GROUP BY 1)
  SELECT l.id, l.x, l.y FROM locs l JOIN n ON l.id = n.id WHERE n.n >= 12""", "x y")
def _(spark, sf):
    return S.local_density_filter(fx.locs(spark, sf), 1.0, 12).select("id", "x", "y")


@query("density_peaks")
def _(spark, sf):
    return S.density_peaks(fx.locs(spark, sf).select("id", "x", "y"), 3.0)


@query("cluster_centres_topk", f"""WITH {LO}, p AS (SELECT frame AS id, avg(x) AS rho, avg(y) AS delta FROM locs GROUP BY 1) SELECT CAST(id AS BIGINT) AS id, rho, delta, rho * delta AS gamma FROM p ORDER BY gamma DESC, id LIMIT 12""", "rho delta gamma")
def _(spark, sf):
    p = fx.locs(spark, sf).groupBy(F.col("frame").cast("long").alias("id")).agg(F.avg("x").alias("rho"), F.avg("y").alias("delta"))
    return S.cluster_centres_topk(p, 12)


# -- rendering --------------------------------------------------------------

@query("render_histogram", f"WITH {LO} SELECT CAST(floor(y / 2.0) AS INT) AS iy, CAST(floor(x / 2.0) AS INT) AS ix, sum(intensity) AS value FROM locs WHERE floor(y / 2.0) BETWEEN 0 AND 63 AND floor(x / 2.0) BETWEEN 0 AND 63 GROUP BY 1, 2", "value", digits=4)
def _(spark, sf):
    return R.render_histogram(fx.locs(spark, sf), 2.0, 64, 64)


@query("render_scatter", f"WITH {LO} SELECT DISTINCT CAST(floor(y / 2.0) AS INT) AS iy, CAST(floor(x / 2.0) AS INT) AS ix, 1.0 AS value FROM locs WHERE floor(y / 2.0) BETWEEN 0 AND 63 AND floor(x / 2.0) BETWEEN 0 AND 63", "value")
def _(spark, sf):
    return R.render_scatter(fx.locs(spark, sf), 2.0, 64, 64)


@query("render_ash", f"""WITH {LO} SELECT CAST(floor((y + sy * 2.0 / 3) / 2.0) AS INT) AS iy, CAST(floor((x + sx * 2.0 / 3) / 2.0) AS INT) AS ix, sum(intensity) / 9 AS value FROM locs CROSS JOIN range(3) a(sy) CROSS JOIN range(3) b(sx)
  WHERE floor((y + sy * 2.0 / 3) / 2.0) BETWEEN 0 AND 63 AND floor((x + sx * 2.0 / 3) / 2.0) BETWEEN 0 AND 63 GROUP BY 1, 2""", "value", digits=4)
def _(spark, sf):
    return R.render_ash(fx.locs(spark, sf), 2.0, 64, 64, 3)


def splat(peak):
    g = "exp(-((ix - x / 2.0) ** 2 + (iy - y / 2.0) ** 2) / 2.0)"
    v = g if peak else f"intensity * {g} / (2 * pi())"
    return f"""WITH {LO} SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, sum({v}) AS value FROM (SELECT *, unnest(range(greatest(CAST(trunc(y / 2.0) AS INT) - 4, 0), least(CAST(trunc(y / 2.0) AS INT) + 4, 63) + 1)) AS iy FROM
  (SELECT *, unnest(range(greatest(CAST(trunc(x / 2.0) AS INT) - 4, 0), least(CAST(trunc(x / 2.0) AS INT) + 4, 63) + 1)) AS ix FROM locs) u) v GROUP BY 1, 2"""


@query("render_gaussian", splat(False), "value", digits=3)
def _(spark, sf):
    return R.render_gaussian(fx.locs(spark, sf), 2.0, 64, 64, 2.0)


@query("render_gaussian_normalized", splat(True), "value", digits=4)
def _(spark, sf):
    return R.render_gaussian(fx.locs(spark, sf), 2.0, 64, 64, 2.0, normalize_peak=True)


# -- metrics ----------------------------------------------------------------

def truth_pair(spark, sf):
    """Detections are F4; the truth is shifted by half a pixel and misses the fully discounted rows."""
    det = fx.locs(spark, sf)
    li = fx.table(spark, sf, "lineitem").where("l_discount < 0.1")
    gt = det.join(li.select(fx.line_id().alias("id")), "id", "left_semi")
    return det, gt.withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})


@query("match_greedy")
def _(spark, sf):
    det, gt = truth_pair(spark, sf)
    return E.match_greedy(det, gt, 1.0, ["frame"])


@query("localization_metrics_per_frame")
def _(spark, sf):
    return E.localization_metrics_per_frame(*truth_pair(spark, sf), 1.0)


@query("localization_metrics")
def _(spark, sf):
    det, gt = truth_pair(spark, sf)
    # frames laid side by side, so the frame-blind match stays local
    return E.localization_metrics(*[d.withColumn("x", F.col("x") + F.col("frame") * 1000) for d in (det, gt)], 1.0)


@query("detection_metrics_stack")
def _(spark, sf):
    det, gt = truth_pair(spark, sf)
    return E.detection_metrics_stack(gt, det, 1.0)


@query("tracking_metrics")
def _(spark, sf):
    det, gt = truth_pair(spark, sf)
    tid = F.floor(F.col("id") / 100 % 10000).alias("track_id")  # the supplier inside the id
    return E.tracking_metrics(gt.select(tid, "frame", "x", "y").groupBy("track_id", "frame").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y")),
                              det.select(tid, "frame", "x", "y").groupBy("track_id", "frame").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y")), 1.0)
