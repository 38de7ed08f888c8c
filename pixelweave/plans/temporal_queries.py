"""Checked queries along time: pixel filters, traces, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.functions import columns as fn
from pixelweave.operators import aggregate as A
from pixelweave.operators import evaluation as E
from pixelweave.operators import fits as FT
from pixelweave.operators import temporal as T
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query

ST = fx.STACK
PX = "movie_id, frame, y, x"
WT = "WINDOW w AS (PARTITION BY movie_id, y, x ORDER BY frame)"


def out(df):
    return df.select("movie_id", "frame", "y", "x", "value")


def temporal(name, sql, op, doubles="value"):
    @query(name, sql, doubles)
    def _(spark, sf):
        return out(op(fx.stack(spark, sf)))


temporal("difference_filter", f"WITH {ST} SELECT {PX}, coalesce(value - lag(value) OVER w, 0) AS value FROM stack {WT}", T.difference_filter)
temporal("boxcar_differential", f"WITH {ST} SELECT {PX}, CASE WHEN frame >= 6 THEN value - min(value) OVER (PARTITION BY movie_id, y, x ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING) ELSE 0 END AS value FROM stack",
         lambda d: T.boxcar_differential(d, 2, 6))


def padded(before, after, mode):
    t = "f.frame + o"
    m = {"reflect": f"CASE WHEN {t} < 0 THEN -1 - ({t}) WHEN {t} >= n THEN 2 * n - 1 - ({t}) ELSE {t} END", "nearest": f"least(greatest({t}, 0), n - 1)"}[mode]
    return (f"WITH {ST}, n AS (SELECT movie_id, max(frame) + 1 AS n FROM stack GROUP BY 1), win AS (SELECT f.movie_id, f.frame, f.y, f.x, v.value AS value FROM stack f JOIN n ON f.movie_id = n.movie_id "
            f"CROSS JOIN range({-before}, {after + 1}) r(o) JOIN stack v ON v.movie_id = f.movie_id AND v.y = f.y AND v.x = f.x AND v.frame = {m})")


temporal("mean_filter", f"{padded(2, 2, 'reflect')} SELECT {PX}, avg(value) AS value FROM win GROUP BY 1, 2, 3, 4", lambda d: T.mean_filter(d, 5))
temporal("mean_filter_even", f"{padded(1, 2, 'reflect')} SELECT {PX}, avg(value) AS value FROM win GROUP BY 1, 2, 3, 4", lambda d: T.mean_filter(d, 4))
temporal("variance_filter", f"{padded(2, 1, 'nearest')} SELECT {PX}, greatest(avg(value * value) - avg(value) ** 2, 0) AS value FROM win GROUP BY 1, 2, 3, 4", lambda d: T.variance_filter(d, 4))
temporal("median_filter", f"{padded(2, 2, 'reflect')} SELECT {PX}, quantile_cont(value, 0.5) AS value FROM win GROUP BY 1, 2, 3, 4", lambda d: T.median_filter(d, 5))

DET = ST + """, m AS (SELECT movie_id, frame, avg(value) AS m FROM stack GROUP BY 1, 2),
dv AS (SELECT movie_id, frame, m - sum(m) OVER (PARTITION BY movie_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS d FROM m),
fl AS (SELECT dv.movie_id, coalesce(min(frame) FILTER (WHERE abs(d) > l), 0) AS flash_start, coalesce(max(frame) FILTER (WHERE abs(d) > l), 0) AS flash_end FROM dv JOIN (SELECT movie_id, stddev_pop(d) * 2 AS l FROM dv GROUP BY 1) s ON dv.movie_id = s.movie_id GROUP BY 1)"""


@query("flash_detect", "WITH " + DET.replace("* 2 AS l", "* 3 AS l") + " SELECT * FROM fl")
def _(spark, sf):
    return T.flash_detect(fx.stack(spark, sf), 10)


FLASH = ST + ", fl AS (SELECT movie_id, 5 + movie_id AS s, 9 + movie_id AS e FROM (SELECT DISTINCT movie_id FROM stack) d)"


def flashes(spark, sf):
    m = fx.table(spark, sf, "embeddings").select(F.col("label").alias("movie_id")).distinct()
    return m.select("movie_id", (F.col("movie_id") + 5).alias("flash_start"), (F.col("movie_id") + 9).alias("flash_end"))


@query("flash_interpolate", f"""WITH {FLASH} SELECT a.movie_id, a.frame, a.y, a.x, CASE WHEN a.frame BETWEEN s AND e THEN (a.frame - s + 1) / 6.0 * q.value + (1 - (a.frame - s + 1) / 6.0) * p.value ELSE a.value END AS value
  FROM stack a JOIN fl ON a.movie_id = fl.movie_id JOIN stack p ON p.movie_id = a.movie_id AND p.y = a.y AND p.x = a.x AND p.frame = s - 1 JOIN stack q ON q.movie_id = a.movie_id AND q.y = a.y AND q.x = a.x AND q.frame = e + 1""", "value")
def _(spark, sf):
    return out(T.flash_interpolate(fx.stack(spark, sf), flashes(spark, sf)))


@query("flash_noise_scale", f"""WITH {FLASH}, b AS (SELECT a.movie_id, y, x, avg(value) AS bm, stddev_pop(value) AS bs FROM stack a JOIN fl ON a.movie_id = fl.movie_id WHERE frame BETWEEN s - 4 AND s - 1 OR frame BETWEEN e + 1 AND e + 4 GROUP BY 1, 2, 3),
  f AS (SELECT movie_id, frame, avg(value) AS fm, stddev_pop(value) AS fs FROM stack GROUP BY 1, 2)
  SELECT a.movie_id, a.frame, a.y, a.x, CASE WHEN a.frame BETWEEN s AND e THEN bm + (value - fm) / fs * bs ELSE value END AS value FROM stack a JOIN fl ON a.movie_id = fl.movie_id JOIN b ON a.movie_id = b.movie_id AND a.y = b.y AND a.x = b.x JOIN f ON a.movie_id = f.movie_id AND a.frame = f.frame""", "value")
def _(spark, sf):
    return out(T.flash_noise_scale(fx.stack(spark, sf), flashes(spark, sf), 4))


@query("flash_remover", f"""WITH {DET.replace('* 2 AS l', '* 3 AS l')}, n AS (SELECT movie_id, max(frame) AS mx FROM stack GROUP BY 1), k AS (SELECT fl.movie_id, flash_start AS s, flash_end AS e, greatest(flash_start - 1, 0) AS pf, least(flash_end + 1, mx) AS qf, NOT (flash_start = 0 AND flash_end = 0) AS hit FROM fl JOIN n ON fl.movie_id = n.movie_id)
  SELECT a.movie_id, a.frame, a.y, a.x, CASE WHEN hit AND a.frame BETWEEN s AND e AND NOT (pf = s AND qf = e) THEN (a.frame - s + 1) / (e - s + 2) * q.value + (1 - (a.frame - s + 1) / (e - s + 2)) * p.value ELSE a.value END AS value
  FROM stack a JOIN k ON a.movie_id = k.movie_id JOIN stack p ON p.movie_id = a.movie_id AND p.y = a.y AND p.x = a.x AND p.frame = pf JOIN stack q ON q.movie_id = a.movie_id AND q.y = a.y AND q.x = a.x AND q.frame = qf""", "value")
def _(spark, sf):
    return out(T.flash_remover(fx.stack(spark, sf), window_size=10))


@query("fourier_filter", f"""WITH {ST}, n AS (SELECT movie_id, max(frame) + 1 AS n FROM stack GROUP BY 1), k AS (SELECT movie_id, n, unnest(range(n)) AS k FROM n),
  kept AS (SELECT *, least(k, n - k) / n * 10.0 AS f FROM k WHERE least(k, n - k) / n * 10.0 BETWEEN 1.0 AND 3.0),
  ft AS (SELECT s.movie_id, y, x, k, any_value(n) AS n, sum(value * cos(2 * pi() * k * frame / n)) AS re, -sum(value * sin(2 * pi() * k * frame / n)) AS im FROM stack s JOIN kept ON s.movie_id = kept.movie_id GROUP BY 1, 2, 3, 4)
  SELECT s.movie_id, s.frame, s.y, s.x, sum(re * cos(2 * pi() * k * s.frame / n) - im * sin(2 * pi() * k * s.frame / n)) / any_value(n) AS value FROM stack s JOIN ft ON s.movie_id = ft.movie_id AND s.y = ft.y AND s.x = ft.x GROUP BY 1, 2, 3, 4""", "value")
def _(spark, sf):
    return out(T.fourier_filter(fx.stack(spark, sf), 10.0, 1.0, 3.0))


@query("power_spectrum", f"""WITH {fx.TRACES}, c AS (SELECT trace_id, count(*) AS n FROM trc GROUP BY 1), g AS (SELECT CAST(2 ** floor(log2(max(n))) AS BIGINT) AS g FROM c),
  l AS (SELECT t.trace_id, least(g, n) AS m, t - (n - least(g, n)) AS j, value FROM trc t JOIN c ON t.trace_id = c.trace_id, g WHERE t >= n - least(g, n)), k AS (SELECT trace_id, m, unnest(range(1, m // 2)) AS k FROM (SELECT DISTINCT trace_id, m FROM l) d)
  SELECT l.trace_id, CAST(k AS INT) AS bin, k / (any_value(l.m) * 0.5) AS frequency, sum(value * cos(2 * pi() * k * j / l.m)) ** 2 + sum(value * sin(2 * pi() * k * j / l.m)) ** 2 AS power FROM l JOIN k ON l.trace_id = k.trace_id GROUP BY l.trace_id, k""", "frequency power", digits=3)
def _(spark, sf):
    return T.power_spectrum(fx.traces(spark, sf), 0.5)


def dff(name, expr, **args):
    @query(name, f"WITH {fx.TRACES}, b AS (SELECT t.trace_id, {expr} AS f FROM trc t JOIN (SELECT trace_id, count(*) AS n FROM trc GROUP BY 1) n ON t.trace_id = n.trace_id WHERE t < greatest(1, n // 10) GROUP BY 1) "
           "SELECT t.trace_id, t, CASE WHEN abs(f) < 1e-12 THEN 0 ELSE (value - f) / f END AS dff FROM trc t JOIN b ON t.trace_id = b.trace_id", "dff", digits=4)
    def _(spark, sf):
        return T.dff_trace(fx.traces(spark, sf), **args).drop("value")


dff("dff_trace", "avg(value)")
dff("dff_trace_median", "quantile_cont(value, 0.5)", method="median")
dff("dff_trace_percentile", "quantile_cont(value, 0.2)", method="percentile", percentile=20.0)

EVENTS = fx.TRACES + """, s AS (SELECT trace_id, count(*) AS n, stddev_pop(value) AS sa FROM trc GROUP BY 1),
q AS (SELECT t.trace_id, any_value(n) AS n, any_value(sa) AS sa, stddev_pop(value) AS sq FROM trc t JOIN s ON t.trace_id = s.trace_id WHERE t < greatest(3, n // 10) GROUP BY 1),
a AS (SELECT t.*, value > 0.6 * CASE WHEN sq >= 1e-12 THEN sq ELSE sa END AS above FROM trc t JOIN q ON t.trace_id = q.trace_id WHERE n >= 2),
g AS (SELECT *, t - row_number() OVER (PARTITION BY trace_id, above ORDER BY t) AS island FROM a),
runs AS (SELECT trace_id, min(t) AS start, max(t) AS "end", max(value) AS amplitude, arg_max(t, {'v': value, 'm': -t}) AS peak, count(*) AS duration, sum(value) - (arg_min(value, t) + arg_max(value, t)) / 2 AS area FROM g WHERE above GROUP BY trace_id, island HAVING count(*) >= 2),
num AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY start) AS i FROM runs),
ok(trace_id, i, last_end, keep) AS (SELECT trace_id, i, "end", true FROM num WHERE i = 1 UNION ALL SELECT n.trace_id, n.i, CASE WHEN n.start - ok.last_end < 3 THEN ok.last_end ELSE n."end" END, n.start - ok.last_end >= 3 FROM ok JOIN num n ON n.trace_id = ok.trace_id AND n.i = ok.i + 1),
ev AS (SELECT num.trace_id, start, peak, "end", amplitude, duration, peak - start AS rise_time, "end" - peak AS decay_time, area FROM num JOIN ok ON num.trace_id = ok.trace_id AND num.i = ok.i WHERE keep)"""


@query("calcium_events", f"WITH RECURSIVE {EVENTS} SELECT * FROM ev", "amplitude area")
def _(spark, sf):
    return T.calcium_events(fx.traces(spark, sf), 0.6, 2, 3)


@query("calcium_stats", f"""WITH RECURSIVE {EVENTS}, e AS (SELECT *, lead(start) OVER (PARTITION BY trace_id ORDER BY start) - "end" AS gap FROM ev)
  SELECT trace_id, count(*) AS n_events, avg(amplitude) AS mean_amplitude, avg(duration) AS mean_duration, avg(rise_time) AS mean_rise_time, avg(decay_time) AS mean_decay_time, avg(area) AS mean_area,
   count(*) / (max("end") - min(start) + 1) AS frequency, avg(gap) AS mean_interval FROM e GROUP BY 1""", "mean_amplitude mean_duration mean_rise_time mean_decay_time mean_area frequency mean_interval")
def _(spark, sf):
    return T.calcium_stats(T.calcium_events(fx.traces(spark, sf), 0.6, 2, 3))


def smoothing(name, sql, op):
    @query(name, sql, "value")
    def _(spark, sf):
        return op(fx.traces(spark, sf)).select("trace_id", "t", "value")


def window_sql(r, weights=None, agg="avg(v.value)"):
    kern = "range({}, {}) k(o)".format(-r, r + 1) if weights is None else "(VALUES " + ", ".join(f"({i - r}, CAST({float(w)!r} AS DOUBLE))" for i, w in enumerate(weights)) + ") k(o, wt)"
    return (f"WITH {fx.TRACES}, n AS (SELECT trace_id, count(*) AS n FROM trc GROUP BY 1) SELECT f.trace_id, f.t, {agg} AS value FROM trc f JOIN n ON f.trace_id = n.trace_id CROSS JOIN {kern} JOIN trc v ON v.trace_id = f.trace_id "
            "AND v.t = CASE WHEN f.t + o < 0 THEN -1 - (f.t + o) WHEN f.t + o >= n THEN 2 * n - 1 - (f.t + o) ELSE f.t + o END GROUP BY 1, 2")


smoothing("smooth_median", window_sql(2, agg="quantile_cont(v.value, 0.5)"), lambda d: T.smooth_median(d, 5))
GW = T.gaussian_weights(9 / 6.0)
smoothing("smooth_gaussian", window_sql(len(GW) // 2, GW, "sum(wt * v.value)"), lambda d: T.smooth_gaussian(d, 9))
SG = [(p, i, float(w)) for p in range(7) for i, w in enumerate(T.savgol_weights(7, 3, p))]
smoothing("smooth_savgol", f"""WITH {fx.TRACES}, n AS (SELECT trace_id, count(*) AS n FROM trc GROUP BY 1), k AS (SELECT * FROM (VALUES {", ".join(f"({p}, {i}, CAST({w!r} AS DOUBLE))" for p, i, w in SG)}) v(p, i, wt)),
  f AS (SELECT t.*, n, least(greatest(t - 3, 0), n - 7) AS first FROM trc t JOIN n ON t.trace_id = n.trace_id)
  SELECT f.trace_id, f.t, sum(wt * v.value) AS value FROM f JOIN k ON k.p = f.t - f.first JOIN trc v ON v.trace_id = f.trace_id AND v.t = f.first + k.i GROUP BY 1, 2""", lambda d: T.smooth_savgol(d, 7, 3))


@query("ecdf", "SELECT value, row_number() OVER (ORDER BY value) / count(*) OVER () AS fraction FROM events", "value fraction")
def _(spark, sf):
    return T.ecdf(fx.table(spark, sf, "events"), "value")


@query("frap_normalize", f"""WITH {fx.TRACES}, s AS (SELECT trace_id, avg(value) FILTER (WHERE t BETWEEN 3 AND 7) AS pre, min(value) FILTER (WHERE t >= 8) AS post FROM trc GROUP BY 1)
  SELECT t.trace_id, t, CASE WHEN abs(pre - post) < 1e-12 THEN 0 ELSE (value - post) / (pre - post) END AS normalized FROM trc t JOIN s ON t.trace_id = s.trace_id""", "normalized", digits=4)
def _(spark, sf):
    return A.frap_normalize(fx.traces(spark, sf), 5, 8).drop("value")


@query("half_time", "SELECT event_id, value * ln(2) AS half_time FROM events", "half_time")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", fn.half_time(F.col("value")).alias("half_time"))


@query("soumpasis_diffusion", "SELECT event_id, CASE WHEN value > 0 THEN 0.224 * 4.0 / value END AS d FROM events", "d")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", fn.soumpasis_diffusion(F.col("value"), F.lit(2.0)).alias("d"))


@query("localization_precision", f"""WITH {fx.LOCS} SELECT id, CASE WHEN intensity > 0 THEN sqrt(((1.3 * 1.3 + 1 / 12.0) / intensity + 8 * pi() * (1.3 * 1.3 + 1 / 12.0) ** 2 * 25 / (intensity * intensity)) * 16 / 9 * 2) END AS uncertainty FROM locs""", "uncertainty")
def _(spark, sf):
    return fx.locs(spark, sf).select("id", fn.localization_precision(F.col("intensity"), F.lit(5.0), F.lit(1.3), 1.0, True, True).alias("uncertainty"))


@query("trace_accuracy", f"""WITH {fx.TRACES}, p AS (SELECT trace_id, value AS g, value + t * 0.1 AS e FROM trc) SELECT trace_id, corr(g, e) AS correlation, sqrt(avg((g - e) ** 2)) AS rmse, stddev_pop(g) / greatest(stddev_pop(g - e), 1e-10) AS snr FROM p GROUP BY 1""", "correlation rmse snr")
def _(spark, sf):
    t = fx.traces(spark, sf)
    return E.trace_accuracy(t, t.withColumn("value", F.col("value") + F.col("t") * 0.1))


@query("diffusion_error", f"WITH {fx.TRACKS}, p AS (SELECT var_pop(x) AS g, var_samp(x) + stddev_pop(y) AS e FROM trk GROUP BY track_id) SELECT sqrt(avg((g - e) ** 2)) AS rmse, avg(abs(g - e) / greatest(g, 1e-10)) AS relative_error, corr(g, e) AS correlation FROM p", "rmse relative_error correlation")
def _(spark, sf):
    p = fx.tracks(spark, sf).groupBy("track_id").agg(F.var_pop("x").alias("g"), (F.var_samp("x") + F.stddev_pop("y")).alias("e"))
    return E.diffusion_error(p, "g", "e")


@query("r_squared", f"WITH {fx.TRACKS} SELECT track_id, 1 - sum((y - x / 2) ** 2) / (var_pop(y) * count(*)) AS r_squared FROM trk GROUP BY 1", "r_squared")
def _(spark, sf):
    return E.r_squared(fx.tracks(spark, sf).withColumn("fit", F.col("x") / 2), "y", "fit", ["track_id"])


@query("event_match", """WITH sp AS (SELECT DISTINCT user_id AS trace_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 600) AS INT) AS spike FROM events WHERE event_type = 'error'),
  dt AS (SELECT DISTINCT user_id AS trace_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 600) AS INT) AS peak FROM events WHERE event_type = 'purchase'),
  near AS (SELECT d.trace_id, peak, min({'d': abs(spike - peak), 's': spike}) AS m FROM dt d JOIN sp s ON d.trace_id = s.trace_id GROUP BY 1, 2),
  won AS (SELECT trace_id, m.s AS spike, arg_min(m.d, peak) AS d FROM near WHERE m.d <= 30 GROUP BY 1, 2),
  c AS (SELECT count(*) AS tp, sqrt(avg(d ** 2)) AS r, (SELECT count(*) FROM sp) AS ng, (SELECT count(*) FROM dt) AS nd FROM won)
  SELECT tp / nd AS event_precision, tp / ng AS event_recall, 2 * (tp / nd) * (tp / ng) / greatest(tp / nd + tp / ng, 1e-10) AS event_f1, r AS timing_rmse FROM c""", "event_precision event_recall event_f1 timing_rmse")
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    slot = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 600).cast("int")

    def of(kind, name):
        return ev.where(F.col("event_type") == kind).select(F.col("user_id").alias("trace_id"), slot.alias(name)).distinct()

    return E.event_match(of("error", "spike"), of("purchase", "peak"), 30)


# -- fits -------------------------------------------------------------------

@query("fit_exp_recovery")
def _(spark, sf):
    return FT.fit_exp_recovery(A.frap_normalize(fx.traces(spark, sf), 5, 8).where("t >= 8").select("trace_id", (F.col("t") - 8).alias("t"), F.col("normalized").alias("value")))


@query("fit_exp_decay")
def _(spark, sf):
    return FT.fit_exp_decay(fx.traces(spark, sf))


@query("bleach_exponential")
def _(spark, sf):
    from pixelweave.operators.pixels import subtract

    return out(FT.bleach_exponential(subtract(fx.stack(spark, sf), -1.0)))


@query("cdf_diffusion_1c")
def _(spark, sf):
    return FT.cdf_diffusion(squared_steps(spark, sf), 1.0, 1)


@query("cdf_diffusion_2c")
def _(spark, sf):
    return FT.cdf_diffusion(squared_steps(spark, sf), 1.0, 2)


def squared_steps(spark, sf):
    from pixelweave.operators.tracks import lag_displacements

    return lag_displacements(fx.tracks(spark, sf)).select((F.col("step") * F.col("step")).alias("r2"))

