"""Checked queries over track tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.operators import tracks as T
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query

TRK = fx.TRACKS
STEP = "sqrt((x - xm1) ** 2 + (y - ym1) ** 2)"
MSD = TRK + """,
msd AS (SELECT a.track_id, b.idx - a.idx AS lag, avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS msd, count(*) AS n_pairs
  FROM pts a JOIN pts b ON a.track_id = b.track_id AND b.idx > a.idx
   AND b.idx - a.idx <= least(greatest(a.n // 4, 2), a.n - 1) GROUP BY 1, 2)"""


@query("lag_displacements", f"WITH {TRK} SELECT track_id, CAST(idx AS BIGINT) AS idx, {STEP} AS step FROM pts WHERE idx > 0", "step")
def _(spark, sf):
    return T.lag_displacements(fx.tracks(spark, sf))


@query("velocity_analysis", f"WITH {TRK} SELECT track_id, avg({STEP} / 0.5) AS mean_velocity, max({STEP} / 0.5) AS max_velocity FROM pts WHERE idx > 0 GROUP BY 1", "mean_velocity max_velocity")
def _(spark, sf):
    return T.velocity_analysis(fx.tracks(spark, sf), 0.5)


@query("msd_single", f"WITH {MSD} SELECT track_id, CAST(lag AS BIGINT) AS lag, msd, n_pairs FROM msd", "msd")
def _(spark, sf):
    return T.msd_single(fx.tracks(spark, sf))


ENSEMBLE = MSD + """,
wm AS (SELECT lag, sum(n_pairs * msd) / sum(n_pairs) AS m FROM msd GROUP BY 1),
ens AS (SELECT CAST(msd.lag AS BIGINT) AS lag, any_value(m) AS msd_mean,
  CASE WHEN count(*) > 1 THEN sqrt(sum(n_pairs * (msd - m) ** 2) / sum(n_pairs) / count(*)) ELSE 0.0 END AS msd_sem, count(*) AS n_tracks
  FROM msd JOIN wm ON msd.lag = wm.lag GROUP BY msd.lag)"""


@query("msd_ensemble", f"WITH {ENSEMBLE} SELECT * FROM ens", "msd_mean msd_sem")
def msd_ensemble(spark, sf):
    return T.msd_ensemble(fx.tracks(spark, sf))


@query("msd_pooled", f"""WITH {TRK} SELECT CAST(b.idx - a.idx AS BIGINT) AS lag, avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS msd, count(*) AS n_pairs
  FROM pts a JOIN pts b ON a.track_id = b.track_id AND b.idx - a.idx BETWEEN 1 AND 20 GROUP BY 1""", "msd")
def _(spark, sf):
    return T.msd_pooled(fx.tracks(spark, sf), 20)


@query("fit_msd_linear", f"WITH {ENSEMBLE} SELECT 'ensemble' AS curve, greatest(regr_slope(msd_mean, lag) / 4, 0) AS diffusion_coefficient FROM ens WHERE lag <= 10", "diffusion_coefficient")
def _(spark, sf):
    ens = T.msd_ensemble(fx.tracks(spark, sf)).select(F.lit("ensemble").alias("curve"), "lag", F.col("msd_mean").alias("msd"))
    return T.fit_msd_linear(ens, ["curve"])


@query("fit_msd_anomalous", f"""WITH {MSD} SELECT track_id, CASE WHEN count(*) >= 3 THEN regr_slope(ln(msd), ln(lag)) ELSE 1 END AS anomalous_exponent,
  CASE WHEN count(*) >= 3 THEN exp(regr_intercept(ln(msd), ln(lag))) / 4 ELSE 0 END AS anomalous_diffusion FROM msd WHERE msd > 0 GROUP BY 1""",
       "anomalous_exponent anomalous_diffusion")
def _(spark, sf):
    return T.fit_msd_anomalous(T.msd_single(fx.tracks(spark, sf)), ["track_id"])


@query("msd_analysis", f"""WITH {MSD} SELECT t.track_id, coalesce(greatest(f.d, 0), 0) AS diffusion_coefficient, coalesce(f.a, 1) AS anomalous_exponent
  FROM (SELECT DISTINCT track_id, n FROM pts) t LEFT JOIN (SELECT track_id, regr_slope(msd, lag) FILTER (WHERE lag <= 10) / 4 AS d,
    CASE WHEN count(*) >= 3 THEN regr_slope(ln(msd), ln(lag)) FILTER (WHERE msd > 0) END AS a FROM msd GROUP BY 1) f ON t.track_id = f.track_id AND t.n >= 5""",
       "diffusion_coefficient anomalous_exponent")
def _(spark, sf):
    return T.msd_analysis(fx.tracks(spark, sf))


ANGLES = TRK + """,
ang AS (SELECT track_id, idx, CASE WHEN a < 0 THEN a + 360 ELSE a END AS d, CASE WHEN b < 0 THEN b + 360 ELSE b END AS d0 FROM (
  SELECT track_id, idx, degrees(atan2(-(y - ym1), x - xm1)) AS a, degrees(atan2(-(ym1 - ym2), xm1 - xm2)) AS b FROM pts WHERE idx > 0) AS r),
dirs AS (SELECT track_id, idx, d AS direction_deg, CASE WHEN idx > 1 THEN CASE WHEN abs(d - d0) > 180 THEN 360 - abs(d - d0) ELSE abs(d - d0) END END AS direction_change FROM ang)"""


@query("direction_analysis", f"WITH {ANGLES} SELECT track_id, avg(direction_deg) AS mean_direction, coalesce(1 - avg(direction_change) / 180, 0) AS directional_persistence FROM dirs GROUP BY 1",
       "mean_direction directional_persistence")
def _(spark, sf):
    return T.direction_analysis(fx.tracks(spark, sf))


@query("step_angles", f"WITH {ANGLES} SELECT track_id, CAST(idx AS BIGINT) AS idx, direction_deg, direction_change FROM dirs", "direction_deg direction_change")
def _(spark, sf):
    return T.step_angles(fx.tracks(spark, sf))


@query("distance_from_origin", f"WITH {TRK} SELECT track_id, frame, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS distance_from_origin FROM pts", "distance_from_origin")
def _(spark, sf):
    return T.distance_from_origin(fx.tracks(spark, sf)).select("track_id", "frame", "distance_from_origin")


DIFFUSION = """SELECT track_id, frame, x - x0 AS zeroed_x, y - y0 AS zeroed_y, CAST(frame - f0 AS INT) AS lag_number, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS distance_from_origin,
  (x - x0) ** 2 + (y - y0) ** 2 AS d_squared, sqrt((xp1 - x) ** 2 + (yp1 - y) ** 2) AS lag, (xp1 - x) ** 2 + (yp1 - y) ** 2 AS lag_squared"""


@query("diffusion_columns", f"WITH {fx.TRACKS_GAPPY} {DIFFUSION} FROM pts", "zeroed_x zeroed_y distance_from_origin d_squared lag lag_squared", digits=4)
def _(spark, sf):
    return T.diffusion_columns(fx.tracks_gappy(spark, sf)).select(
        "track_id", "frame", "zeroed_x", "zeroed_y", "lag_number", "distance_from_origin", "d_squared", "lag", "lag_squared")


@query("velocity_columns", f"""WITH {fx.TRACKS_GAPPY}, v AS (SELECT track_id, frame, (frame - fm1) * 60.0 AS dt, sqrt((xp1 - x) ** 2 + (yp1 - y) ** 2) / ((frame - fm1) * 60.0) AS velocity,
  degrees(atan2(y - y0, x - x0)) AS a FROM pts) SELECT track_id, frame, dt, velocity, CASE WHEN a < 0 THEN a + 360 ELSE a END AS direction_relative_to_origin,
  avg(velocity) OVER (PARTITION BY track_id) AS mean_velocity FROM v""", "dt velocity direction_relative_to_origin mean_velocity")
def _(spark, sf):
    return T.velocity_columns(fx.tracks_gappy(spark, sf), 60.0).select(
        "track_id", "frame", "dt", "velocity", "direction_relative_to_origin", "mean_velocity")


@query("track_intensity_stats", f"WITH {TRK} SELECT track_id, frame, avg(intensity) OVER w AS track_intensity_mean, stddev_samp(intensity) OVER w AS track_intensity_std FROM trk WINDOW w AS (PARTITION BY track_id)",
       "track_intensity_mean track_intensity_std")
def _(spark, sf):
    return T.track_intensity_stats(fx.tracks(spark, sf)).select("track_id", "frame", "track_intensity_mean", "track_intensity_std")


GYR = TRK + """,
cov AS (SELECT track_id, count(*) AS n, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM pts GROUP BY 1),
eig AS (SELECT *, (sxx + syy) / 2 + sqrt((sxx - syy) ** 2 + 4 * sxy * sxy) / 2 AS l1, (sxx + syy) / 2 - sqrt((sxx - syy) ** 2 + 4 * sxy * sxy) / 2 AS l2 FROM cov),
axis AS (SELECT *, CASE WHEN sxy = 0 THEN CASE WHEN sxx >= syy THEN 1 ELSE 0 END ELSE l1 - syy END AS ax, CASE WHEN sxy = 0 THEN CASE WHEN sxx >= syy THEN 0 ELSE 1 END ELSE sxy END AS ay FROM eig),
proj AS (SELECT p.track_id, ((p.x - p.xm1) * ax + (p.y - p.ym1) * ay) / sqrt(ax * ax + ay * ay) AS s FROM pts p JOIN axis a ON p.track_id = a.track_id WHERE p.idx > 0),
mom AS (SELECT track_id, avg(s) AS m FROM proj GROUP BY 1),
cm AS (SELECT p.track_id, avg((s - m) ** 2) AS c2, avg((s - m) ** 3) AS c3, avg((s - m) ** 4) AS c4 FROM proj p JOIN mom ON p.track_id = mom.track_id GROUP BY 1),
gyr AS (SELECT a.track_id, CASE WHEN n >= 3 THEN sqrt(sxx + syy) ELSE 0 END AS radius_gyration,
  CASE WHEN n >= 3 AND sxx + syy > 0 THEN -ln(1 - (l1 - l2) ** 2 / (2 * (l1 + l2) ** 2)) ELSE 0 END AS asymmetry,
  CASE WHEN n < 3 THEN 0 WHEN c2 > 0 THEN c3 / c2 ** 1.5 END AS skewness, CASE WHEN n < 3 THEN 0 WHEN c2 > 0 THEN c4 / c2 ** 2 - 3 END AS kurtosis
  FROM axis a LEFT JOIN cm ON a.track_id = cm.track_id)"""


@query("radius_of_gyration", f"WITH {GYR} SELECT * FROM gyr", "radius_gyration asymmetry skewness kurtosis")
def _(spark, sf):
    return T.radius_of_gyration(fx.tracks(spark, sf))


@query("rg_simple", f"WITH {TRK} SELECT track_id, CASE WHEN count(*) >= 2 THEN sqrt(var_pop(x) + var_pop(y)) END AS rg FROM trk GROUP BY 1", "rg")
def _(spark, sf):
    return T.rg_simple(fx.tracks(spark, sf))


PATH = """path AS (SELECT track_id, avg(sqrt((x - xm1) ** 2 + (y - ym1) ** 2)) AS mean_step, sum(sqrt((x - xm1) ** 2 + (y - ym1) ** 2)) AS len,
  max(sqrt((x - xm1) ** 2 + (y - ym1) ** 2)) AS max_step, sum((x - xm1) ** 2 + (y - ym1) ** 2) AS ss,
  count(*) AS n, arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, arg_max(x, idx) AS lx, arg_max(y, idx) AS ly FROM pts GROUP BY 1)"""


@query("golan_scaled_rg", f"WITH {GYR}, {PATH} SELECT g.track_id, sqrt(pi() / 2) * radius_gyration / nullif(mean_step, 0) AS scaled_rg FROM gyr g JOIN path p ON g.track_id = p.track_id", "scaled_rg")
def _(spark, sf):
    return T.scaled_rg(fx.tracks(spark, sf))


@query("rg_scaled", f"""WITH {GYR}, {PATH} SELECT g.track_id, coalesce(radius_gyration / nullif(mean_step, 0), 0) AS rg_scaled, radius_gyration / n AS rg_scaled_segments,
  coalesce(radius_gyration / nullif(len, 0), 0) AS rg_scaled_length FROM gyr g JOIN path p ON g.track_id = p.track_id""", "rg_scaled rg_scaled_segments rg_scaled_length")
def _(spark, sf):
    return T.rg_scaled(fx.tracks(spark, sf))


NET = PATH + """,
net AS (SELECT track_id, CASE WHEN n >= 2 THEN sqrt((lx - fx) ** 2 + (ly - fy) ** 2) ELSE 0 END AS net_displacement,
  CASE WHEN n < 2 THEN 0 WHEN n < 3 THEN 1 WHEN ss > 0 THEN ((lx - fx) ** 2 + (ly - fy) ** 2) / ((n - 1) * ss) ELSE 0 END AS efficiency FROM path)"""


@query("net_displacement_efficiency", f"WITH {TRK}, {NET} SELECT * FROM net", "net_displacement efficiency", digits=8)
def _(spark, sf):
    return T.net_displacement_efficiency(fx.tracks(spark, sf))


STRAIGHT = """moved AS (SELECT track_id, idx, x, y FROM pts WHERE idx = 0 OR x <> xm1 OR y <> ym1),
turn AS (SELECT track_id, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS bys, lag(x) OVER w - lag(x, 2) OVER w AS ax, lag(y) OVER w - lag(y, 2) OVER w AS ays
  FROM moved WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
str AS (SELECT track_id, coalesce(avg((ax * bx + ays * bys) / (sqrt(ax * ax + ays * ays) * sqrt(bx * bx + bys * bys))), 0) AS mean_cos,
  coalesce(avg((ax * bys - ays * bx) / (sqrt(ax * ax + ays * ays) * sqrt(bx * bx + bys * bys))), 0) AS mean_sin FROM turn GROUP BY 1)"""


@query("straightness", f"WITH {TRK}, {STRAIGHT} SELECT * FROM str", "mean_cos mean_sin")
def _(spark, sf):
    return T.straightness(fx.tracks(spark, sf))


FRACTAL = """diam AS (SELECT a.track_id, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM pts a JOIN pts b ON a.track_id = b.track_id GROUP BY 1),
slope AS (SELECT track_id, count(*) AS away, count(*) FILTER (WHERE x = x0) AS vert, min(CASE WHEN x <> x0 THEN (y - y0) / (x - x0) END) AS s0,
  max(CASE WHEN x <> x0 THEN (y - y0) / (x - x0) END) AS s1 FROM pts WHERE x <> x0 OR y <> y0 GROUP BY 1),
frac AS (SELECT p.track_id, CASE WHEN p.n < 3 OR coalesce(s.away, 0) < 2 OR s.vert = s.away OR (s.vert = 0 AND s.s0 = s.s1) THEN 1
  ELSE ln(p.n) / ln(p.n * d.d / p.len) END AS fractal_dimension FROM path p JOIN diam d ON p.track_id = d.track_id LEFT JOIN slope s ON p.track_id = s.track_id)"""


@query("fractal_dimension", f"WITH {TRK}, {PATH}, {FRACTAL} SELECT * FROM frac", "fractal_dimension")
def _(spark, sf):
    return T.fractal_dimension(fx.tracks(spark, sf))


@query("linear_motion_class", f"""WITH {TRK}, {PATH}, perp AS (SELECT p.track_id, any_value(n) AS n, any_value(len) AS len, any_value(sqrt((lx - fx) ** 2 + (ly - fy) ** 2)) AS net,
    avg(abs((lx - fx) * (p.y - fy) - (ly - fy) * (p.x - fx)) / sqrt((lx - fx) ** 2 + (ly - fy) ** 2)) AS mp
    FROM trk p JOIN path q ON p.track_id = q.track_id GROUP BY 1)
  SELECT track_id, CASE WHEN n < 3 OR len = 0 THEN 'unclassified' WHEN mp / net <= 0.15 AND net / len >= 0.8 THEN 'linear_unidirectional'
    WHEN mp / net <= 0.15 THEN 'linear_bidirectional' ELSE 'non_linear' END AS classification, CASE WHEN n >= 3 AND len > 0 THEN net / len END AS directionality_ratio,
    CASE WHEN n >= 3 AND len > 0 AND net > 0 THEN mp END AS mean_perpendicular_distance, CASE WHEN n >= 3 AND len > 0 AND net > 0 THEN mp / net END AS normalized_perpendicular_distance FROM perp""",
       "directionality_ratio mean_perpendicular_distance normalized_perpendicular_distance")
def _(spark, sf):
    return T.linear_motion_class(fx.tracks(spark, sf))


FEATURES = f"{GYR}, {NET}, {STRAIGHT}, {FRACTAL}, " + MSD[len(TRK) + 1:] + ", " + ANGLES[len(TRK) + 1:] + """,
fit AS (SELECT track_id, greatest(regr_slope(msd, lag) FILTER (WHERE lag <= 10) / 4, 0) AS d, CASE WHEN count(*) >= 3 THEN regr_slope(ln(msd), ln(lag)) FILTER (WHERE msd > 0) END AS a FROM msd GROUP BY 1),
dd AS (SELECT track_id, avg(direction_deg) AS mean_direction, coalesce(1 - avg(direction_change) / 180, 0) AS directional_persistence FROM dirs GROUP BY 1),
feat AS (SELECT p.track_id, p.n AS n_points, radius_gyration, asymmetry, skewness, kurtosis, fractal_dimension, net_displacement, efficiency, mean_cos AS straightness,
  mean_step AS mean_velocity, max_step AS max_velocity, CASE WHEN p.n < 5 THEN 0 ELSE coalesce(fit.d, 0) END AS diffusion_coefficient,
  CASE WHEN p.n < 5 THEN 1 ELSE coalesce(fit.a, 1) END AS anomalous_exponent, directional_persistence, mean_direction
  FROM path p JOIN gyr ON p.track_id = gyr.track_id JOIN net ON p.track_id = net.track_id JOIN str ON p.track_id = str.track_id
  JOIN frac ON p.track_id = frac.track_id LEFT JOIN fit ON p.track_id = fit.track_id LEFT JOIN dd ON p.track_id = dd.track_id WHERE p.n >= 3)"""
FEATURE_NAMES = ("radius_gyration asymmetry skewness kurtosis fractal_dimension net_displacement efficiency straightness "
                 "mean_velocity max_velocity diffusion_coefficient anomalous_exponent directional_persistence mean_direction")


@query("track_features", f"WITH {FEATURES} SELECT * FROM feat", FEATURE_NAMES)
def _(spark, sf):
    return T.track_features(fx.tracks(spark, sf))


@query("per_point_features", f"""WITH {FEATURES} SELECT p.frame, p.x, p.y, p.intensity, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS distance_from_origin,
  sqrt((xp1 - x) ** 2 + (yp1 - y) ** 2) AS lag, f.* FROM pts p JOIN feat f ON p.track_id = f.track_id""", FEATURE_NAMES + " distance_from_origin lag x y intensity")
def _(spark, sf):
    return T.per_point_features(fx.tracks(spark, sf))


@query("track_features_rows", f"""WITH {GYR}, {NET}, {STRAIGHT}, {FRACTAL}, inten AS (SELECT track_id, avg(intensity) AS im, stddev_pop(intensity) AS isd FROM trk GROUP BY 1)
  SELECT p.track_id, p.frame, p.x, p.y, p.intensity, p.n AS n_segments, len AS track_length, radius_gyration AS radius_gyration,
   asymmetry AS asymmetry, skewness AS skewness, kurtosis AS kurtosis, radius_gyration / mean_step AS radius_gyration_scaled,
   radius_gyration / p.n AS radius_gyration_scaled_n_segments, radius_gyration / len AS radius_gyration_scaled_track_length,
   sqrt((xp1 - p.x) ** 2 + (yp1 - p.y) ** 2) AS lag, mean_step AS mean_lag, fractal_dimension AS fractal_dimension,
   net_displacement AS net_displacement, mean_cos AS straightness, im AS track_intensity_mean, isd AS track_intensity_std
  FROM pts p JOIN path q ON p.track_id = q.track_id JOIN gyr ON p.track_id = gyr.track_id JOIN net ON p.track_id = net.track_id JOIN str ON p.track_id = str.track_id
  JOIN frac ON p.track_id = frac.track_id JOIN inten ON p.track_id = inten.track_id WHERE p.n > 4""",
       "x y intensity track_length radius_gyration asymmetry skewness kurtosis radius_gyration_scaled radius_gyration_scaled_n_segments radius_gyration_scaled_track_length lag mean_lag fractal_dimension net_displacement straightness track_intensity_mean track_intensity_std")
def _(spark, sf):
    return T.track_features_rows(fx.tracks(spark, sf), 4, rounded=False)


DISP = TRK + """,
dsp AS (SELECT track_id, idx - 1 AS idx, n, x - xm1 AS dx, y - ym1 AS dy FROM pts WHERE idx > 0),
cs AS (SELECT a.track_id, b.idx - a.idx AS lag, a.n, CASE WHEN sqrt(a.dx * a.dx + a.dy * a.dy) > 1e-15 AND sqrt(b.dx * b.dx + b.dy * b.dy) > 1e-15 THEN
  greatest(-1.0, least(1.0, (a.dx * b.dx + a.dy * b.dy) / (sqrt(a.dx * a.dx + a.dy * a.dy) * sqrt(b.dx * b.dx + b.dy * b.dy)))) END AS c
  FROM dsp a JOIN dsp b ON a.track_id = b.track_id AND b.idx - a.idx BETWEEN 1 AND 10)"""


@query("direction_autocorrelation", f"""WITH {DISP}, per AS (SELECT track_id, lag, coalesce(avg(c), 0) AS v FROM cs WHERE n >= 4 GROUP BY 1, 2)
  SELECT CAST(lag AS BIGINT) AS lag, avg(v) AS mean_correlation, CASE WHEN count(*) > 1 THEN stddev_samp(v) / sqrt(count(*)) ELSE 0 END AS sem_correlation,
   CASE WHEN count(*) > 1 THEN stddev_samp(v) ELSE 0 END AS std_correlation, count(*) AS n_tracks FROM per GROUP BY 1""", "mean_correlation sem_correlation std_correlation")
def _(spark, sf):
    return T.direction_autocorrelation(fx.tracks(spark, sf), 10)


@query("direction_autocorrelation_pooled", f"""WITH {DISP} SELECT CAST(lag AS BIGINT) AS lag, avg(c) AS avg, stddev_samp(c) / sqrt(count(c)) AS sem FROM cs WHERE c IS NOT NULL AND n >= 3 GROUP BY 1
  UNION ALL SELECT CAST(0 AS BIGINT), 1.0, 0.0""", "avg sem")
def _(spark, sf):
    return T.direction_autocorrelation_pooled(fx.tracks(spark, sf), 10)


@query("persistence_index", f"WITH {DISP}, per AS (SELECT track_id, avg(c) AS v FROM cs WHERE n >= 4 AND lag = 1 GROUP BY 1) SELECT avg(v) AS persistence_index FROM per", "persistence_index")
def _(spark, sf):
    return T.persistence_index(fx.tracks(spark, sf), 1, 10)


@query("track_quality", f"""WITH {TRK}, a AS (SELECT track_id, count(*) AS n, max(frame) - min(frame) + 1 AS span, avg(sqrt((x - 2 * xm1 + xm2) ** 2 + (y - 2 * ym1 + ym2) ** 2)) AS acc,
   avg(sqrt((x - xm1) ** 2 + (y - ym1) ** 2)) AS vel FROM pts GROUP BY 1)
  SELECT track_id, CASE WHEN n < 2 THEN 0 ELSE 0.4 * n / greatest(span, 1) + 0.3 * CASE WHEN n >= 3 THEN 1 / (1 + acc / greatest(vel, 1e-6)) ELSE 0.5 END + 0.3 * least(n / 20.0, 1) END AS quality FROM a""", "quality")
def _(spark, sf):
    return T.track_quality(fx.tracks(spark, sf))


@query("velocity_persistence", f"""WITH {TRK}, u AS (SELECT track_id, idx, n, sqrt((x - xm1) ** 2 + (y - ym1) ** 2) AS nv, sqrt((xm1 - xm2) ** 2 + (ym1 - ym2) ** 2) AS nu,
   (x - xm1) * (xm1 - xm2) + (y - ym1) * (ym1 - ym2) AS d FROM pts WHERE idx > 0 AND n >= 3)
  SELECT track_id, CASE WHEN count(*) FILTER (WHERE nv > 1e-12) < 2 THEN 0 ELSE avg(CASE WHEN idx > 1 THEN CASE WHEN nv > 1e-12 AND nu > 1e-12 THEN d / (nv * nu) ELSE 0 END END) END AS persistence FROM u GROUP BY 1""", "persistence")
def _(spark, sf):
    return T.velocity_persistence(fx.tracks(spark, sf))


@query("track_summary", f"WITH {TRK} SELECT track_id, count(*) AS n_points, min(frame) AS first_frame, max(frame) AS last_frame, avg(intensity) AS mean_intensity FROM trk WHERE track_id >= 0 GROUP BY 1", "mean_intensity")
def _(spark, sf):
    return T.track_summary(fx.tracks(spark, sf))


@query("particle_counts", f"WITH {TRK} SELECT count(*) AS n_localizations, count(DISTINCT track_id) FILTER (WHERE track_id >= 0) AS n_tracks, count(DISTINCT frame) AS n_frames FROM trk")
def _(spark, sf):
    return T.particle_counts(fx.tracks(spark, sf))


@query("frame_locs", f"WITH {fx.LOCS} SELECT * FROM locs WHERE frame = 100", "x y intensity")
def _(spark, sf):
    return T.frame_locs(fx.locs(spark, sf), 100)


@query("track_locs", f"WITH {TRK} SELECT * FROM trk WHERE track_id = 8", "x y intensity")
def _(spark, sf):
    return T.track_locs(fx.tracks(spark, sf), 8)


@query("min_track_length", f"WITH {TRK} SELECT track_id, frame, x, y, intensity FROM pts WHERE n >= 65", "x y intensity")
def _(spark, sf):
    return T.min_track_length(fx.tracks(spark, sf), 65)


@query("track_ids", "SELECT DISTINCT user_id AS track_id FROM events WHERE user_id >= 0")
def _(spark, sf):
    return T.track_ids(fx.tracks(spark, sf))


@query("track_order", f"WITH {TRK} SELECT track_id, count(*) AS n_points, min(frame) AS first_frame, max(frame) AS last_frame, avg(intensity) AS mean_intensity FROM trk GROUP BY 1 ORDER BY mean_intensity DESC, track_id", "mean_intensity")
def _(spark, sf):
    return T.track_order(fx.tracks(spark, sf), "intensity")


@query("linking_stats", f"""WITH {TRK}, len AS (SELECT track_id, count(*) AS length FROM trk GROUP BY 1)
  SELECT count(*) AS num_tracks, avg(length) AS mean_track_length, max(length) AS max_track_length, min(length) AS min_track_length, stddev_pop(length) AS std_track_length,
   count(*) FILTER (WHERE length = 1) AS singletons, count(*) FILTER (WHERE length >= 10) AS long_tracks, CAST(sum(length) AS BIGINT) AS total_points, CAST(sum(length) AS BIGINT) AS linked_points,
   quantile_cont(length, 0.5) AS median_track_length, CAST(0 AS BIGINT) AS unlinked_points, 1.0 AS linking_efficiency FROM len""", "mean_track_length std_track_length median_track_length linking_efficiency")
def _(spark, sf):
    return T.linking_stats(fx.tracks(spark, sf))


@query("track_length_histogram", f"""WITH {TRK}, len AS (SELECT track_id, count(*) AS length FROM trk GROUP BY 1), m AS (SELECT max(length) AS m, least(max(length), 50) AS b FROM len)
  SELECT CAST(least(floor((length - 1) / (m / b)), b - 1) AS INT) AS bin, count(*) AS n_tracks FROM len, m GROUP BY 1""")
def _(spark, sf):
    return T.length_histogram(fx.tracks(spark, sf))


@query("step_length_stats", f"WITH {TRK} SELECT count(*) AS n_steps, avg({STEP}) AS mean_step, quantile_cont({STEP}, 0.5) AS median_step FROM pts WHERE idx > 0", "mean_step median_step")
def _(spark, sf):
    return T.step_length_stats(fx.tracks(spark, sf))


@query("flower_summary", f"""WITH {TRK}, e AS (SELECT track_id, arg_max(x, idx) - arg_min(x, idx) AS dx, arg_max(y, idx) - arg_min(y, idx) AS dy FROM pts GROUP BY 1)
  SELECT avg(dx) AS mean_dx, avg(dy) AS mean_dy, stddev_pop(sqrt(dx * dx + dy * dy)) AS sigma FROM e""", "mean_dx mean_dy sigma")
def _(spark, sf):
    return T.flower_summary(fx.tracks(spark, sf))


@query("track_normalise", f"""WITH {TRK} SELECT track_id, frame, CASE WHEN max(intensity) OVER w > min(intensity) OVER w THEN (intensity - min(intensity) OVER w) / (max(intensity) OVER w - min(intensity) OVER w) ELSE 0 END AS normalized
  FROM trk WINDOW w AS (PARTITION BY track_id)""", "normalized")
def _(spark, sf):
    return T.track_normalise(fx.tracks(spark, sf)).select("track_id", "frame", "normalized")


@query("track_mean_trace", f"""WITH {fx.TRACKS_GAPPY} SELECT CAST(frame - f0 AS INT) AS rel_frame, avg(intensity) AS mean_intensity, count(*) AS n_tracks FROM pts GROUP BY 1""", "mean_intensity")
def _(spark, sf):
    return T.track_mean_trace(fx.tracks_gappy(spark, sf))


@query("set_tracks", """SELECT event_id AS id, value AS x, CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS track_id FROM events""", "x")
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    lists = ev.where("event_type <> 'error'").groupBy(F.col("user_id").alias("track_id"), F.to_date("ts").alias("d")).agg(F.collect_list("event_id").alias("members"))
    points = ev.select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.lit(-1).cast("long").alias("track_id"))
    return T.set_tracks(points, lists.drop("d"))


@query("track_array", """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS track_id, value AS x FROM events""", "x")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("value").alias("x"))
    links = ev.where("event_type <> 'error'").select("id", F.col("user_id").alias("track_id"))
    return T.track_array(ev.select("id", "x"), links)


@query("track_feature_broadcast", f"WITH {TRK}, f AS (SELECT track_id, max(intensity) AS peak FROM trk GROUP BY 1) SELECT t.track_id, t.frame, t.x, f.peak FROM trk t LEFT JOIN f ON t.track_id = f.track_id", "x peak")
def _(spark, sf):
    t = fx.tracks(spark, sf)
    return T.track_feature_broadcast(t.select("track_id", "frame", "x"), t.groupBy("track_id").agg(F.max("intensity").alias("peak")))
