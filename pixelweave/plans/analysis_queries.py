"""Checked queries: detection, linking, spectra, boxes, files, streams, learning, whole analyses."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import align as AL
from pixelweave.operators import boxes as B
from pixelweave.operators import detection as D
from pixelweave.operators import learn as LN
from pixelweave.operators import linking as L
from pixelweave.operators import masks as M
from pixelweave.operators import pixels as P
from pixelweave.operators import spectral as SP
from pixelweave.operators import stencil as N
from pixelweave.operators import tracks as T
from pixelweave.operators import userfn as U
from pixelweave.plans import analyses as AN
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query
from pixelweave.plans.neighbourhood_queries import conv_cte
from pixelweave.session import ensure_checkpoint_dir
from pixelweave.sources import localizations as LF
from pixelweave.sources import tables as TB
from pixelweave.streaming import frames as S

ST = fx.STACK
PX = "movie_id, frame, y, x"


def out(df, *cols):
    return df.select("movie_id", "frame", "y", "x", *(cols or ("value",)))


# -- detection --------------------------------------------------------------

@query("localization_filter", f"WITH {fx.LOCS}, s AS (SELECT *, 1 + y / 64 AS sigma_x, x / 100 AS uncertainty FROM locs) SELECT id FROM s WHERE intensity >= 10000 AND intensity <= 60000 AND sigma_x >= 1.2 AND sigma_x <= 2.5 AND uncertainty <= 1")
def _(spark, sf):
    s = fx.locs(spark, sf).withColumn("sigma_x", 1 + F.col("y") / 64).withColumn("uncertainty", F.col("x") / 100)
    return D.localization_filter(s, 10000, 60000, 1.2, 2.5, 1).select("id")


@query("border_filter", f"WITH {fx.LOCS} SELECT id FROM locs WHERE x >= 5 AND x < 123 AND y >= 5 AND y < 123")
def _(spark, sf):
    return D.border_filter(fx.locs(spark, sf).withColumns({"h": F.lit(128), "w": F.lit(128)}), 5).select("id")


@query("threshold_expression", f"WITH {ST} SELECT movie_id, frame, 1.5 * stddev_pop(value) + avg(value * 2) AS threshold FROM stack GROUP BY 1, 2", "threshold")
def _(spark, sf):
    return D.frame_threshold(fx.stack(spark, sf).withColumn("raw", F.col("value") * 2), "1.5*std(Wave.F1) + mean(I1)")


TOP = f"{ST}, {conv_cte('t', np.ones((3, 3)), 'reflect', agg='max(n.value)')}, pk AS (SELECT s.* FROM stack s JOIN t ON s.movie_id = t.movie_id AND s.frame = t.frame AND s.y = t.y AND s.x = t.x WHERE s.value = t.value AND s.value > 0.1 AND s.y BETWEEN 1 AND 6 AND s.x BETWEEN 1 AND 6)"


@query("local_max_detector", f"WITH {TOP} SELECT {PX}, value FROM pk", "value")
def _(spark, sf):
    return out(D.local_max_detector(fx.stack(spark, sf), 0.1, 1, border=1))


@query("nms_detector", f"WITH {TOP} SELECT {PX}, value FROM pk", "value")
def _(spark, sf):
    return out(D.nms_detector(fx.stack(spark, sf), 0.1, 2, border=1))


@query("grid_detector", f"WITH {ST} SELECT {PX}, value FROM stack WHERE value > 0 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND (y - 1) % 3 = 0 AND (x - 1) % 3 = 0", "value")
def _(spark, sf):
    return out(D.grid_detector(fx.stack(spark, sf), 0.0, 3, 1))


@query("centroid_detector")
def _(spark, sf):
    return D.centroid_detector(fx.stack(spark, sf), 0.1, 2, 2, border=0).drop("h", "w")


@query("peak_local_max", f"""WITH {ST}, top AS (SELECT a.movie_id, a.frame, a.y, a.x, a.value, max(b.value) AS m, bool_or(b.value = a.value AND (b.y, b.x) < (a.y, a.x)) AS later
   FROM stack a JOIN stack b ON a.movie_id = b.movie_id AND a.frame = b.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
   WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 AND a.value > 0.1 GROUP BY ALL)
  SELECT {PX}, value FROM top WHERE value = m AND NOT later QUALIFY row_number() OVER (PARTITION BY movie_id, frame ORDER BY value DESC, y, x) <= 3""", "value")
def _(spark, sf):
    return out(D.peak_local_max(fx.stack(spark, sf), 1, 0.1, 3))


@query("blob_log")
def _(spark, sf):
    return D.blob_log(fx.stack(spark, sf), 1.0, 2.0, 3, 0.05)


def peaks(spark, sf):
    p = D.local_max_detector(fx.stack(spark, sf), 0.1, 1, border=1)
    return p.select("movie_id", "frame", (F.col("y") * 8 + F.col("x")).cast("long").alias("id"), "y", "x")


WIN = TOP + """, wn AS (SELECT p.movie_id, p.frame, CAST(p.y * 8 + p.x AS BIGINT) AS id, greatest(p.y - 2, 0) AS r0, greatest(p.x - 2, 0) AS c0, least(p.y + 2, 7) - greatest(p.y - 2, 0) + 1 AS nr, least(p.x + 2, 7) - greatest(p.x - 2, 0) + 1 AS nc,
  s.y - greatest(p.y - 2, 0) AS r, s.x - greatest(p.x - 2, 0) AS c, s.value + 1 AS v FROM pk p JOIN stack s ON s.movie_id = p.movie_id AND s.frame = p.frame AND abs(s.y - p.y) <= 2 AND abs(s.x - p.x) <= 2)"""


@query("localize_centroid", f"""WITH {WIN} SELECT movie_id, frame, id, min(v) AS background, max(v) - min(v) AS intensity, sum(c * v) / sum(v) + any_value(c0) AS x, sum(r * v) / sum(v) + any_value(r0) AS y FROM wn GROUP BY 1, 2, 3 HAVING sum(v) > 0""", "background intensity x y")
def _(spark, sf):
    return D.localize_centroid(P.subtract(fx.stack(spark, sf), -1.0), peaks(spark, sf), 5).drop("sigma_x", "sigma_y")


@query("localize_phasor", f"""WITH {WIN}, f AS (SELECT movie_id, frame, id, min(v) AS background, greatest(sum(v) - min(v) * count(*), 0) AS intensity, any_value(nc) AS nc, any_value(nr) AS nr, any_value(c0) AS c0, any_value(r0) AS r0,
   atan2(sum(v * sin(-2 * pi() * c / nc)), sum(v * cos(-2 * pi() * c / nc))) AS ax, atan2(sum(v * sin(-2 * pi() * r / nr)), sum(v * cos(-2 * pi() * r / nr))) AS ay FROM wn GROUP BY 1, 2, 3)
  SELECT movie_id, frame, id, background, intensity, CASE WHEN ax < 0 THEN ax + 2 * pi() ELSE ax END * nc / (2 * pi()) + c0 AS x, CASE WHEN ay < 0 THEN ay + 2 * pi() ELSE ay END * nr / (2 * pi()) + r0 AS y FROM f""", "background intensity x y")
def _(spark, sf):
    return D.localize_phasor(P.subtract(fx.stack(spark, sf), -1.0), peaks(spark, sf), 5).drop("sigma_x", "sigma_y")


@query("localize_radial")
def _(spark, sf):
    return D.localize_radial(fx.stack(spark, sf), peaks(spark, sf), 5)


@query("background_local")
def _(spark, sf):
    s = P.multiply(fx.stack(spark, sf), 100.0)
    return D.background_local(s, peaks(spark, sf), 2, 3)


@query("significance_test")
def _(spark, sf):
    s = P.multiply(fx.stack(spark, sf), 100.0)
    c = peaks(spark, sf).join(s.select("movie_id", "frame", "y", "x", "value"), ["movie_id", "frame", "y", "x"])
    return D.significance_test(D.background_local(s, c, 2, 3), 0.01, 5.0)


@query("detect_particles")
def _(spark, sf):
    # 8 x 8 frames laid out as one 40-wide mosaic per block of 25 frames
    s = fx.stack(spark, sf)
    m = s.select("movie_id", F.floor(F.col("frame") / 25).cast("int").alias("frame"), (F.floor(F.col("frame") % 25 / 5) * 8 + F.col("y")).cast("int").alias("y"),
                 (F.col("frame") % 5 * 8 + F.col("x")).cast("int").alias("x"), "value", F.lit(40).alias("h"), F.lit(40).alias("w"))
    return D.detect_particles(m, threshold="1.2*std(Wave.F1)")


# -- linking ----------------------------------------------------------------

#: Frame by frame: heads take their nearest free point in the order of their seeds (a fold over a list), what is left starts tracks.
HEAD = "{'sf': %s, 'sid': %s, 'frame': %s, 'x': %s, 'y': %s}"
NEAR = "(len(list_filter(coalesce(f.p, []), lambda q: sqrt((q.x - k.x) ** 2 + (q.y - k.y) ** 2) < 1.0)) > 0)"
LINKED = f"""RECURSIVE {fx.LOCS},
f AS MATERIALIZED (SELECT CAST(frame AS BIGINT) AS frame, list({{'id': CAST(id AS BIGINT), 'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE)}} ORDER BY id) AS p FROM locs GROUP BY 1),
none AS MATERIALIZED (SELECT (SELECT max(frame) FROM f) AS last, list_filter([{HEAD % ("CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")}], lambda h: false) AS h, list_filter([CAST(0 AS BIGINT)], lambda i: false) AS ids),
step AS (SELECT (SELECT min(frame) FROM f) - 1 AS frame, h AS heads, ids AS own, h AS owners FROM none
  UNION ALL
  SELECT frame, list_sort(list_concat(list_filter(list_concat(apart, acc.kept), lambda h: h.frame >= frame - 1), list_concat(acc.links, seeds))), list_concat(acc.taken, list_transform(seeds, lambda s: s.sid)), list_concat(acc.links, seeds)
  FROM (SELECT frame, acc, apart, list_transform(list_filter(p, lambda q: NOT list_contains(acc.taken, q.id)), lambda q: {HEAD % ("frame", "q.id", "frame", "q.x", "q.y")}) AS seeds
    FROM (SELECT s.frame + 1 AS frame, coalesce(f.p, []) AS p, list_filter(s.heads, lambda k: NOT {NEAR}) AS apart, list_reduce(list_transform(list_filter(s.heads, lambda k: {NEAR}), lambda h: {{'h': h, 'kept': none.h, 'links': none.h, 'taken': none.ids}}),
        lambda a, e: list_transform([list_min(list_transform(list_filter(coalesce(f.p, []), lambda q: NOT list_contains(a.taken, q.id) AND sqrt((q.x - e.h.x) ** 2 + (q.y - e.h.y) ** 2) < 1.0),
            lambda q: {{'d': sqrt((q.x - e.h.x) ** 2 + (q.y - e.h.y) ** 2), 'id': q.id, 'x': q.x, 'y': q.y}}))],
          lambda c: CASE WHEN c IS NULL THEN {{'h': e.h, 'kept': list_append(a.kept, e.h), 'links': a.links, 'taken': a.taken}}
            ELSE {{'h': e.h, 'kept': a.kept, 'links': list_append(a.links, {HEAD % ("e.h.sf", "e.h.sid", "s.frame + 1", "c.x", "c.y")}), 'taken': list_append(a.taken, c.id)}} END)[1],
        {{'h': {HEAD % ("CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")}, 'kept': none.h, 'links': none.h, 'taken': none.ids}}) AS acc
      FROM step s CROSS JOIN none LEFT JOIN f ON f.frame = s.frame + 1 WHERE s.frame < none.last) a) b),
owned AS (SELECT unnest(own) AS id, unnest(owners) AS o FROM step)
SELECT locs.id, locs.frame, locs.x, locs.y, intensity, CAST(dense_rank() OVER (ORDER BY o.sf, o.sid) - 1 AS BIGINT) AS track_id FROM owned JOIN locs ON owned.id = locs.id"""


@query("link_greedy", f"WITH {LINKED}", "x y intensity")
def _(spark, sf):
    return L.link_greedy(fx.locs(spark, sf).select("id", "frame", "x", "y", "intensity"), 1.0, 1, 1)


@query("motion_regimes")
def _(spark, sf):
    return L.motion_regimes(fx.tracks(spark, sf))


@query("motion_class_counts")
def _(spark, sf):
    return L.motion_class_counts(fx.tracks(spark, sf))


@query("regime_labels", f"""WITH {fx.TRACKS}, s AS (SELECT track_id, idx, n, x, y, xp1 - x AS dx, yp1 - y AS dy, sqrt((xp1 - x) ** 2 + (yp1 - y) ** 2) AS s FROM pts),
  u AS (SELECT *, dx / CASE WHEN s > 1e-12 THEN s ELSE 1 END AS ux, dy / CASE WHEN s > 1e-12 THEN s ELSE 1 END AS uy FROM s), d AS (SELECT *, ux * lead(ux) OVER w + uy * lead(uy) OVER w AS dot FROM u WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
  f AS (SELECT track_id, idx, count(s) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS ns, avg(s) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS ms,
    avg(dot) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING) AS md, sqrt(var_pop(x) OVER b + var_pop(y) OVER b) AS rg, count(*) OVER b AS np FROM d WINDOW b AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
  SELECT track_id, CAST(idx AS INT) AS frame, CASE WHEN ns < 2 OR np < 3 THEN 'brownian' WHEN md > -0.3 THEN 'linear' WHEN ms > 1e-12 AND rg / ms < 0.75 THEN 'confined' ELSE 'brownian' END AS regime FROM f""")
def _(spark, sf):
    return L.regime_labels(fx.tracks(spark, sf), 11, -0.3, 0.75).select("track_id", "frame", "regime")


@query("linker_intensities", f"""WITH {ST}, p AS (SELECT event_id AS id, CAST(user_id % 10 AS INT) AS movie_id, CAST(user_id % 40 AS INT) AS frame, value / 40 AS x, CAST(props->>'k' AS DOUBLE) / 12 AS y FROM events)
  SELECT p.id, coalesce(s.value, 0) AS sampled FROM p LEFT JOIN stack s ON p.movie_id = s.movie_id AND p.frame = s.frame AND s.x = round_even(p.x, 0) AND s.y = round_even(p.y, 0)""", "sampled")
def _(spark, sf):
    return L.linker_intensities(sample_points(spark, sf), fx.stack(spark, sf)).select("id", "sampled")


def sample_points(spark, sf):
    ev = fx.table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("int").alias("movie_id"), (F.col("user_id") % 40).cast("int").alias("frame"),
                     (F.col("value") / 40).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 12).alias("y"))


def sampled(method, half, agg):
    @query("track_intensity_" + method.lower().replace(" ", "_"), f"""WITH {ST}, p AS (SELECT event_id AS id, CAST(user_id % 10 AS INT) AS movie_id, CAST(user_id % 40 AS INT) AS frame, value / 40 AS x, CAST(props->>'k' AS DOUBLE) / 12 AS y FROM events)
      SELECT p.id, {agg}(s.value) AS sampled FROM p LEFT JOIN stack s ON p.movie_id = s.movie_id AND p.frame = s.frame AND abs(s.x - round_even(p.x, 0)) <= {half} AND abs(s.y - round_even(p.y, 0)) <= {half} GROUP BY 1""", "sampled")
    def _(spark, sf):
        return L.track_intensity_sample(sample_points(spark, sf), fx.stack(spark, sf), method).select("id", "sampled")


sampled("Point", 0, "avg")
sampled("Mean 3x3", 1, "avg")
sampled("Max 3x3", 1, "max")
sampled("Mean 5x5", 2, "avg")


def drifting(spark, sf):
    """Chains that drift slowly, one per user, brighter with the user number."""
    ev = fx.tracks(spark, sf)
    return ev.select((F.col("track_id") * 100000 + F.col("frame")).alias("id"), F.col("frame").cast("long").alias("frame"),
                     (F.col("track_id") * 20 + F.col("frame") * 0.05 + F.col("y") / 1000).alias("x"), (F.col("frame") * 0.02 + F.col("y") / 2000).alias("y"),
                     (F.col("track_id") + F.col("intensity") / 1e6).alias("intensity"))


@query("fiducial_identify")
def _(spark, sf):
    return L.fiducial_identify(drifting(spark, sf), 50, 0.8, 90.0)


@query("drift_fiducial_apply")
def _(spark, sf):
    return L.drift_fiducial_apply(drifting(spark, sf), 90, 0.5, 90.0)


@query("drift_crosscorr")
def _(spark, sf):
    return L.drift_crosscorr(fx.locs(spark, sf), 2557, 2.0, 500)


# -- registration and profiles ---------------------------------------------

@query("motion_correction")
def _(spark, sf):
    return out(AL.motion_correction(fx.stack(spark, sf), 0))


@query("channel_alignment", f"""WITH {fx.CHANNELS} SELECT a.movie_id, a.frame, a.y, a.x, a.value AS v1, b.value AS v2 FROM chan a JOIN chan b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y + 1 AND a.x = b.x + 2 WHERE a.c = 0 AND b.c = 1""", "v1 v2")
def _(spark, sf):
    ch = fx.channels(spark, sf)
    return AL.channel_alignment(P.split_channel(ch, 0), P.split_channel(ch, 1), 2, 1)


@query("stitch_images")
def _(spark, sf):
    ch = fx.channels(spark, sf)
    return out(AL.stitch_images(P.split_channel(ch, 0), P.split_channel(ch, 1), 3, "horizontal"))


@query("linescan", f"WITH {ST} SELECT movie_id, frame, CAST(x - 1 AS INT) AS pos, max(value) AS value FROM stack WHERE x BETWEEN 1 AND 6 AND y BETWEEN 3 AND 5 GROUP BY 1, 2, 3", "value")
def _(spark, sf):
    return AL.linescan(fx.stack(spark, sf), [(1.0, 4.0), (6.0, 4.0)], 3, "Max")


@query("kymograph")
def _(spark, sf):
    return AL.kymograph(fx.stack(spark, sf), [(1.0, 1.0), (6.0, 5.0)], 1, 2, True, 1.0, True)


@query("kymograph_detrend", f"""WITH {ST}, line AS (SELECT movie_id, CAST(frame // 4 AS INT) AS bin, CAST(x - 1 AS INT) AS pos, value, max(frame) OVER (PARTITION BY movie_id) AS last FROM stack WHERE y = 4 AND x BETWEEN 1 AND 6),
   binned AS (SELECT movie_id, bin, pos, avg(value) AS value FROM line WHERE bin < (last + 1) // 4 GROUP BY 1, 2, 3),
   fit AS (SELECT movie_id, pos, regr_slope(value, bin) AS k, regr_intercept(value, bin) AS c FROM binned GROUP BY 1, 2)
  SELECT movie_id, bin, pos, value - k * bin - c AS value FROM binned JOIN fit USING (movie_id, pos)""", "value")
def _(spark, sf):
    return AL.kymograph(fx.stack(spark, sf), [(1.0, 4.0), (6.0, 4.0)], 1, 4, True)


@query("shear_transform", f"""WITH {fx.CHANNELS}, target AS (SELECT r::INT AS r, c::INT AS c, CAST(round_even(r - c * cos(radians(30)) / sin(radians(30)), 0) AS INT) AS z, CAST(round_even(c / sin(radians(30)), 0) AS INT) AS x
  FROM range(0, 12) a(r), range(0, 5) b(c)) SELECT movie_id, frame, t.r AS z, y, t.c AS x, value FROM target t JOIN chan s ON s.x = t.x AND s.c = t.z // 2 AND t.z BETWEEN 0 AND 3""", "value")
def _(spark, sf):
    return P.shear_transform(fx.channels(spark, sf).withColumnRenamed("c", "z"), 30.0, 2).drop("h", "w")


# -- spectra ----------------------------------------------------------------

SPECTRA = [[0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01], [0.05, 0.1, 0.2, 0.4, 0.4, 0.2, 0.1, 0.05], [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5]]
PINV = np.linalg.pinv(np.asarray(SPECTRA).T)


def dot(weights, source="data"):
    return " + ".join(f"{source}[{i + 1}] * CAST({float(w)!r} AS DOUBLE)" for i, w in enumerate(weights))


@query("normalize_spectra", f"WITH {fx.SPECTRA} SELECT pixel_id, data[1] / list_sum(data) AS d0, data[8] / list_sum(data) AS d7 FROM spec", "d0 d7")
def _(spark, sf):
    return SP.normalize_spectra(fx.spectra(spark, sf)).select("pixel_id", F.col("data")[0].alias("d0"), F.col("data")[7].alias("d7"))


ABUND = f"{fx.SPECTRA}, ab AS (SELECT pixel_id, data, [{', '.join(dot(PINV[i]) for i in range(3))}] AS a FROM spec)"


@query("linear_unmix", f"WITH {ABUND} SELECT pixel_id, a[1] AS a0, a[2] AS a1, a[3] AS a2 FROM ab", "a0 a1 a2")
def _(spark, sf):
    u = SP.linear_unmix(fx.spectra(spark, sf), SPECTRA, "lstsq")
    return u.select("pixel_id", *[F.col("abundance")[i].alias(f"a{i}") for i in range(3)])


def least_squares_of(support):
    """SQL struct of cost and abundances of the least-squares solution on a support; null where an abundance is negative."""
    s = np.asarray(SPECTRA, dtype=float)[list(support)]
    inverse = np.linalg.pinv(s.T)
    found = {c: f"({dot(inverse[r])})" for r, c in enumerate(support)}
    residual = [f"(data[{j + 1}] - ({' + '.join(f'{found[c]} * CAST({float(s[r, j])!r} AS DOUBLE)' for r, c in enumerate(support))})) ** 2" for j in range(8)]
    cost = " + ".join(residual)
    values = ", ".join(found.get(c, "CAST(0 AS DOUBLE)") for c in range(3))
    return f"CASE WHEN {' AND '.join(f'{v} >= 0' for v in found.values())} THEN {{'cost': {cost}, 'a': [{values}]}} END"


SUPPORTS = [c for n in (1, 2, 3) for c in itertools.combinations(range(3), n)]
NNLS = f"""{fx.SPECTRA}, best AS (SELECT pixel_id, list_min([{{'cost': list_sum([v * v FOR v IN data]), 'a': [CAST(0 AS DOUBLE), 0, 0]}}, {', '.join(map(least_squares_of, SUPPORTS))}]) AS b FROM spec)"""


@query("linear_unmix_nnls", f"WITH {NNLS} SELECT pixel_id, b.a[1] AS a0, b.a[2] AS a1, b.a[3] AS a2 FROM best", "a0 a1 a2")
def _(spark, sf):
    u = SP.linear_unmix(fx.spectra(spark, sf), SPECTRA, "nnls")
    return u.select("pixel_id", *[F.col("abundance")[i].alias(f"a{i}") for i in range(3)])


@query("unmix_residual", f"WITH {ABUND} SELECT sqrt(sum({' + '.join(f'(data[{j + 1}] - (' + dot([s[j] for s in SPECTRA], 'a') + ')) ** 2' for j in range(8))}) / (8 * count(*))) AS rmse FROM ab", "rmse")
def _(spark, sf):
    return SP.residual_rmse(SP.unmix_residual(SP.linear_unmix(fx.spectra(spark, sf), SPECTRA, "lstsq"), SPECTRA))


@query("endmembers_pca")
def _(spark, sf):
    return SP.endmembers_pca(fx.spectra(spark, sf), 3).select("component", "pixel_id")


@query("spectral_unmixing")
def _(spark, sf):
    return AN.spectral_unmixing(fx.spectra(spark, sf), None, 3)["rmse"]


# -- boxes ------------------------------------------------------------------

@query("boxes_to_yolo", f"WITH {fx.BOXES} SELECT image_id, id, CASE class_name WHEN 'A' THEN 0 ELSE 1 END AS class_id, (x + width / 2) / 600 AS cx, (y + height / 2) / 600 AS cy, width / 600 AS w, height / 600 AS h, true AS ok FROM box WHERE class_name IN ('A', 'N')", "cx cy w h", digits=5)
def _(spark, sf):
    lines = B.boxes_to_yolo(fx.boxes(spark, sf), ["A", "N"], 600, 600)
    p = F.split("line", " ")
    # the text holds six digits: compare at five, from the untouched columns
    raw = fx.boxes(spark, sf).where("class_name in ('A', 'N')").select(
        "image_id", "id", ((F.col("x") + F.col("width") / 2) / 600).alias("cx"), ((F.col("y") + F.col("height") / 2) / 600).alias("cy"), (F.col("width") / 600).alias("w"), (F.col("height") / 600).alias("h"))
    near = F.lit(True)
    for i, c in enumerate(("cx", "cy", "w", "h")):
        near = near & (F.abs(p[i + 1].cast("double") - F.col(c)) <= 5.1e-7)
    return lines.join(raw, ["image_id", "id"]).select("image_id", "id", p[0].cast("int").alias("class_id"), "cx", "cy", "w", "h", near.alias("ok"))


@query("boxes_to_coco", f"WITH {fx.BOXES} SELECT image_id, id, class_name, x, y, width, height, confidence FROM box WHERE class_name IN ('A', 'N', 'R')", "x y width height confidence")
def _(spark, sf):
    return B.coco_to_boxes(B.boxes_to_coco(fx.boxes(spark, sf), ["A", "N", "R"]), ["A", "N", "R"])


@query("yolo_to_boxes", f"WITH {fx.BOXES} SELECT image_id, id, class_name, x, y, width, height, 1.0 AS confidence, true AS ok FROM box WHERE class_name IN ('A', 'N')", "x y width height confidence", digits=5)
def _(spark, sf):
    boxes = fx.boxes(spark, sf)
    back = B.yolo_to_boxes(B.boxes_to_yolo(boxes, ["A", "N"], 600, 600), ["A", "N"], 600, 600)
    raw = boxes.select("id", *[F.col(c).alias(f"_{c}") for c in ("x", "y", "width", "height")])
    near = F.lit(True)
    for c in ("x", "y", "width", "height"):
        # six digits of a 600 pixel side
        near = near & (F.abs(F.col(c) - F.col(f"_{c}")) <= 6.2e-4)
    return back.join(raw, "id").select("image_id", "id", "class_name", *[F.col(f"_{c}").alias(c) for c in ("x", "y", "width", "height")], "confidence", near.alias("ok"))


GREEDY = f"""RECURSIVE {fx.BOXES}, r AS (SELECT image_id, {{'id': id, 'x': x, 'y': y, 'w': width, 'h': height, 'c': confidence}} AS b,
  row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, id) AS k FROM box),
g AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, list_filter([b], lambda z: false) AS kept FROM r WHERE k = 1
  UNION ALL SELECT g.image_id, r.k, CASE WHEN len(list_filter(kept, lambda z: greatest(0, least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x)) * greatest(0, least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y))
    > 0.3 * (z.w * z.h + b.w * b.h - greatest(0, least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x)) * greatest(0, least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y)) + 1e-6))) = 0 THEN list_append(kept, b) ELSE kept END
  FROM g JOIN r ON r.image_id = g.image_id AND r.k = g.k + 1)"""


@query("nms_boxes", f"WITH {GREEDY} SELECT image_id, k.id AS id, k.c AS confidence FROM (SELECT image_id, unnest(kept) AS k FROM (SELECT image_id, arg_max(kept, k) AS kept FROM g GROUP BY 1) a) u", "confidence")
def _(spark, sf):
    return B.nms_boxes(fx.boxes(spark, sf), 0.3).select("image_id", "id", "confidence")


TILED = GREEDY.replace("FROM box)", "FROM (SELECT * REPLACE (x + CASE class_name WHEN 'A' THEN 0 ELSE 512 END AS x) FROM box) m)")


@query("merge_tiled_boxes", f"WITH {TILED} SELECT image_id, k.id AS id, k.x AS x FROM (SELECT image_id, unnest(kept) AS k FROM (SELECT image_id, arg_max(kept, k) AS kept FROM g GROUP BY 1) a) u", "x")
def _(spark, sf):
    b = fx.boxes(spark, sf).withColumn("tile_id", F.col("class_name"))
    tiles = b.select("tile_id").distinct().withColumn("x0", F.when(F.col("tile_id") == "A", 0.0).otherwise(512.0)).withColumn("y0", F.lit(0.0))
    return B.merge_tiled_boxes(b, tiles, 0.3).select("image_id", "id", "x")


# -- files ------------------------------------------------------------------

@query("write_thunderstorm", f'WITH {fx.LOCS} SELECT CAST(frame + 1 AS BIGINT) AS frame, round(x * 108 + 3.1e-8, 6) + 0.0 AS "x [nm]", round(y * 108 + 3.1e-8, 6) + 0.0 AS "y [nm]", round(intensity + 3.1e-8, 6) + 0.0 AS "intensity [photon]" FROM locs')
def _(spark, sf):
    return LF.to_thunderstorm(fx.locs(spark, sf))


@query("particle_csv_export", f"WITH {fx.LOCS} SELECT id + 1 AS id, CAST(frame + 1 AS BIGINT) AS frame, x * 108 AS xn, y * 108 AS yn, intensity FROM locs", "xn yn intensity")
def _(spark, sf):
    return LF.to_particle_csv(fx.locs(spark, sf)).toDF("id", "frame", "xn", "yn", "intensity")


@query("write_locs_json", f"WITH {fx.TRACKS} SELECT track_id, count(*) AS n, min(frame) AS first, max(frame) AS last FROM trk GROUP BY 1")
def _(spark, sf):
    d = LF.track_documents(fx.tracks(spark, sf))
    return d.select("track_id", F.size("points").cast("long").alias("n"), F.col("points")[0]["frame"].alias("first"), F.element_at("points", -1)["frame"].alias("last"))


@query("count_export", "SELECT event_id AS number, event_type AS category, format('{:.2f}', value) AS x, format('{:.2f}', CAST(props->>'k' AS DOUBLE)) AS y, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame FROM events ORDER BY category, frame, number")
def _(spark, sf):
    return TB.count_table(fx.markers(spark, sf))


@query("batch_outputs", """WITH l AS (SELECT event_type AS file, CASE WHEN value > 100 THEN -1 ELSE user_id END AS track_id FROM events), t AS (SELECT file, track_id, count(*) AS n FROM l WHERE track_id >= 0 GROUP BY 1, 2),
  g AS (SELECT file, count(*) AS n_tracks, avg(n) AS mean_track_length, sum(n) AS linked FROM t GROUP BY 1) SELECT l.file, count(*) AS n_localizations, any_value(n_tracks) AS n_tracks, any_value(mean_track_length) AS mean_track_length, any_value(linked) / count(*) AS linking_efficiency, '' AS error FROM l JOIN g ON l.file = g.file GROUP BY 1""", "mean_track_length linking_efficiency")
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    return TB.batch_summary(ev.select(F.col("event_type").alias("file"), F.when(F.col("value") > 100, -1).otherwise(F.col("user_id")).alias("track_id")))


# -- streams ----------------------------------------------------------------

def event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("event_id").alias("frame"), "value")


def folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_fps", "SELECT event_type AS source, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS frames FROM events GROUP BY 1, 2")
def _(spark, sf):
    at = folder(spark)
    S.run_available(S.fps(event_stream(spark, sf), None), at)
    return S.newest(spark.read.parquet(f"{at}/out"), ["source", "second"]).withColumn("second", F.col("second").cast("long"))


@query("stream_timelapse", "SELECT source, slot, m.frame AS frame, m.value AS value FROM (SELECT event_type AS source, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, min({'ts': ts, 'frame': event_id, 'value': value}) AS m FROM events GROUP BY 1, 2) AS g", "value")
def _(spark, sf):
    at = folder(spark)
    S.run_available(S.timelapse(event_stream(spark, sf), "1 hour", ["frame", "value"], None), at)
    return S.newest(spark.read.parquet(f"{at}/out"), ["source", "slot"]).select("source", F.floor(F.col("slot").cast("long") / 3600).alias("slot"), "frame", "value")


@query("stream_latest_n", "SELECT event_type AS source, event_id AS frame FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, sf):
    at = folder(spark)
    S.run_available(S.latest_n(event_stream(spark, sf), 20), at)
    return S.newest(spark.read.parquet(f"{at}/out"), ["source", "pos"]).select("source", "frame")


@query("stream_latest_n_batch", "SELECT event_type AS source, event_id AS frame FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select("ts", F.col("event_type").alias("source"), F.col("event_id").alias("frame"))
    return S.latest_n_batch(ev, 20).select("source", "frame")


@query("stream_focus", f"""WITH {ST} SELECT movie_id, frame, var_pop(value + 1) / avg(value + 1) AS normalized_variance FROM stack WHERE frame % 3 = 0 GROUP BY 1, 2""", "normalized_variance")
def _(spark, sf):
    return S.focus(P.subtract(fx.stack(spark, sf), -1.0), 3).select("movie_id", "frame", "normalized_variance")


@query("stream_roi_trace", """SELECT ts_us, source, frame, avg(value) AS value FROM (SELECT CAST(epoch_us(ts) AS BIGINT) AS ts_us, event_type AS source, event_id AS frame, value, CAST(props->>'k' AS INT) AS k FROM events) AS e WHERE k BETWEEN 20 AND 69 GROUP BY 1, 2, 3""", "value")
def _(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("int")
    pixels = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), F.col("event_id").alias("frame"), F.floor(k / 10).cast("int").alias("y"), (k % 10).alias("x"), "value")
    grid = fx.table(spark, sf, "events").select(F.floor(k / 10).cast("int").alias("y"), (k % 10).alias("x"))
    mask = M.mask_from(grid, F.col("y").between(2, 6))
    at = folder(spark)
    S.run_available(S.roi_trace_stream(pixels, mask, None), at)
    return S.newest(spark.read.parquet(f"{at}/out"), ["ts", "source", "frame"]).select(F.unix_micros("ts").alias("ts_us"), "source", "frame", "value")


@query("stream_link")
def _(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    points = raw.select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), F.floor(F.unix_timestamp("ts") / 3600).alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    at = folder(spark)
    S.run_link(points, at, 5.0, 1, whole_frames=True)
    return spark.read.parquet(f"{at}/out").drop("batch_no")


# -- user functions, learning, analyses ------------------------------------

@query("map_frames", f"WITH {ST} SELECT {PX}, value - avg(value) OVER (PARTITION BY movie_id, frame) AS value FROM stack", "value")
def _(spark, sf):
    return out(U.map_frames(fx.stack(spark, sf), lambda a: a - a.mean()))


@query("batch_runner", f"WITH {ST} SELECT {PX}, abs((value - 0.1) * 2) AS value FROM stack", "value")
def _(spark, sf):
    return out(U.run_steps(fx.stack(spark, sf), [(P.subtract, {"value": 0.1}), (P.multiply, {"value": 2.0}), (P.absolute_value, {})]))


def labelled_tracks(spark, sf):
    f = T.track_features(fx.tracks(spark, sf))
    return f.withColumn("label", F.when(F.col("radius_gyration") > 60, 1).when(F.col("radius_gyration") > 45, 2).otherwise(3))


@query("track_classifier")
def _(spark, sf):
    from pixelweave.session import cut_lineage

    data = cut_lineage(labelled_tracks(spark, sf))
    model = LN.TrackClassifier(folds=2)
    model.train(data)
    return model.predict(data).select("track_id", "label", "predicted_class")


@query("pixel_classifier")
def _(spark, sf):
    from pixelweave.session import cut_lineage

    feats = cut_lineage(N.pixel_features(fx.stack(spark, sf), (1.0,), (), 0).withColumn("label", (F.col("f0") > 0.5).cast("int")))
    model = LN.PixelClassifier(5, 4).train(feats)
    return model.predict(feats).select("movie_id", "frame", "y", "x", "label", "predicted_class")


def rect(s):
    return M.mask_from(s, M.in_rectangle(2, 2, 6, 6))


@query("calcium_analysis")
def _(spark, sf):
    s = P.subtract(fx.stack(spark, sf), -1.0)
    return AN.calcium_analysis(s, rect(s), threshold=1.0, min_duration=1, min_interval=1)["stats"]


@query("frap_analysis")
def _(spark, sf):
    s = P.subtract(fx.stack(spark, sf), -1.0)
    return AN.frap_analysis(s, rect(s), 5, 8)


@query("fret_analysis", f"""WITH {fx.PAIRS}, e AS (SELECT movie_id, greatest(v2 + 0.5, 0) / (greatest(v1 + 0.5, 0) + greatest(v2 + 0.5, 0)) AS e FROM pair WHERE greatest(v1 + 0.5, 0) + greatest(v2 + 0.5, 0) > 0)
  SELECT movie_id, avg(e) AS mean_e, stddev_pop(e) AS std_e, count(*) AS n_pixels, quantile_cont(e, 0.5) AS median_e FROM e GROUP BY 1""", "mean_e std_e median_e")
def _(spark, sf):
    w = P.channels_wide(fx.channels(spark, sf), {0: "donor", 1: "acceptor"}).withColumns({"donor": F.col("donor") + 0.5, "acceptor": F.col("acceptor") + 0.5})
    return AN.fret_analysis(w, ["movie_id"])["stats"]


@query("colocalization")
def _(spark, sf):
    w = P.channels_wide(fx.channels(spark, sf), {0: "v1", 1: "v2"})
    return AN.colocalization(w, ["movie_id"])


@query("morphometry_analysis")
def _(spark, sf):
    return AN.morphometry_analysis(fx.stack(spark, sf), 0.05)


@query("spt_batch")
def _(spark, sf):
    s = fx.stack(spark, sf)
    m = s.select("movie_id", F.floor(F.col("frame") / 25).cast("int").alias("frame"), (F.floor(F.col("frame") % 25 / 5) * 8 + F.col("y")).cast("int").alias("y"),
                 (F.col("frame") % 5 * 8 + F.col("x")).cast("int").alias("x"), "value", F.lit(40).alias("h"), F.lit(40).alias("w"))
    return AN.track_movies(m, 8.0, 1, 2, threshold="1.2*std(Wave.F1)")["localizations"]
