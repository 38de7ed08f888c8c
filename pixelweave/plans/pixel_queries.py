"""Checked queries over stacks: pixel maths, frames, masks, pairs, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.functions import columns as fn
from pixelweave.operators import aggregate as A
from pixelweave.operators import combine as C
from pixelweave.operators import masks as M
from pixelweave.operators import pixels as P
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query

ST = fx.STACK
PX = "movie_id, frame, y, x"


def out(df, *cols):
    return df.select("movie_id", "frame", "y", "x", *(cols or ("value",)))


def simple(name, expr, op, doubles="value"):
    """A per-pixel query whose oracle is one expression of ``value``."""
    @query(name, f"WITH {ST} SELECT {PX}, {expr} AS value FROM stack", doubles)
    def _(spark, sf):
        return out(op(fx.stack(spark, sf)))


simple("subtract", "value - 0.25", lambda d: P.subtract(d, 0.25))
simple("multiply", "value * 3.5", lambda d: P.multiply(d, 3.5))
simple("divide", "value / 0.7", lambda d: P.divide(d, 0.7))
simple("power", "pow(value, 2)", lambda d: P.power(d, 2))
simple("sqrt", "sqrt(greatest(value, 0))", P.sqrt)
simple("absolute_value", "abs(value)", P.absolute_value)
simple("change_datatype", "CAST(((CAST(trunc(value * 1000) AS BIGINT) % 256) + 256) % 256 AS SMALLINT)",
       lambda d: P.change_datatype(P.multiply(d, 1000.0), "uint8"), "")
simple("threshold", "CAST(value > 0.05 AS INT)", lambda d: P.threshold(d, 0.05), "")
simple("threshold_dark", "CAST(value < 0.05 AS INT)", lambda d: P.threshold(d, 0.05, True), "")
simple("camera_to_photons", "(value * 1000 - 100) * 0.5 / 0.9 / 2.0",
       lambda d: d.withColumn("value", fn.adu_to_photons(F.col("value") * 1000, 100.0, 0.5, 0.9, 2.0)))


@query("convert_uint8", f"""WITH {ST} SELECT {PX}, CAST(floor((value - min(value) OVER w) * 255 / (max(value) OVER w - min(value) OVER w)) AS SMALLINT) AS value FROM stack WINDOW w AS (PARTITION BY movie_id)""")
def _(spark, sf):
    return out(P.convert_uint8(fx.stack(spark, sf)))


@query("set_value", f"WITH {ST} SELECT {PX}, CASE WHEN frame BETWEEN 2 AND 5 AND x >= 2 AND x < 6 AND y >= 2 AND y < 6 THEN 9 ELSE value END AS value FROM stack", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(P.set_value(s, 9.0, 2, 5, M.mask_from(s, M.in_rectangle(2, 2, 6, 6))))


@query("set_value_outside", f"WITH {ST} SELECT {PX}, CASE WHEN frame BETWEEN 2 AND 5 AND NOT (x >= 2 AND x < 6 AND y >= 2 AND y < 6) THEN 9 ELSE value END AS value FROM stack", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(P.set_value(s, 9.0, 2, 5, M.mask_from(s, M.in_rectangle(2, 2, 6, 6)), outside=True))


RGB = fx.STACK + """,
rgb AS (SELECT movie_id, CAST(frame // 3 AS INT) AS frame, y, x, CAST(frame % 3 AS INT) AS c, value FROM stack),
rgbw AS (SELECT movie_id, frame, y, x, max(value) FILTER (WHERE c = 0) AS r, max(value) FILTER (WHERE c = 1) AS g, max(value) FILTER (WHERE c = 2) AS b FROM rgb GROUP BY ALL HAVING count(*) = 3),
sc AS (SELECT movie_id, frame, y, x, (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) AS r, (g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w) AS g, (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) AS b
  FROM rgbw WINDOW w AS (PARTITION BY movie_id))"""


def rgb(spark, sf):
    """Three colour planes: every three successive frames of F1 make one image."""
    return P.deinterleave(fx.stack(spark, sf), 3)


@query("grayscale", f"WITH {RGB} SELECT {PX}, 0.2126 * r + 0.7152 * g + 0.0722 * b AS value FROM rgbw", "value")
def _(spark, sf):
    return out(P.grayscale(rgb(spark, sf)))


@query("grayscale_lightness", f"WITH {RGB} SELECT {PX}, (greatest(r, g, b) + least(r, g, b)) / 2 AS value FROM rgbw", "value")
def _(spark, sf):
    return out(P.grayscale(rgb(spark, sf), "Lightness"))


@query("split_channels", f"WITH {fx.CHANNELS} SELECT {PX}, value FROM chan WHERE c = 1", "value")
def _(spark, sf):
    return out(P.split_channel(fx.channels(spark, sf), 1))


@query("convert_color_space_hsv", f"""WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM sc)
  SELECT {PX}, CASE WHEN d = 0 THEN 0 WHEN t = r THEN ((g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 WHEN t = g THEN ((b - r) / d + 2) / 6 ELSE ((r - g) / d + 4) / 6 END AS hue,
   CASE WHEN t = 0 THEN 0 ELSE d / t END AS saturation, t AS brightness FROM m""", "hue saturation brightness")
def _(spark, sf):
    return out(P.convert_color_space(rgb(spark, sf), "RGB to HSV"), "hue", "saturation", "brightness")


@query("convert_color_space_ycbcr", f"""WITH {RGB} SELECT {PX}, 65.481 * r + 128.553 * g + 24.966 * b + 16 AS luma, -37.797 * r - 74.203 * g + 112.0 * b + 128 AS cb,
   112.0 * r - 93.786 * g - 18.214 * b + 128 AS cr FROM sc""", "luma cb cr")
def _(spark, sf):
    return out(P.convert_color_space(rgb(spark, sf), "RGB to YCrCb"), "luma", "cb", "cr")


@query("convert_color_space_lab", f"""WITH {RGB}, lin AS (SELECT {PX}, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS r,
   CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS g, CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS b FROM sc),
  xyz AS (SELECT {PX}, ({fn.SRGB_XYZ[0][0]} * r + {fn.SRGB_XYZ[0][1]} * g + {fn.SRGB_XYZ[0][2]} * b) / {fn.D65[0]} AS x_, ({fn.SRGB_XYZ[1][0]} * r + {fn.SRGB_XYZ[1][1]} * g + {fn.SRGB_XYZ[1][2]} * b) / {fn.D65[1]} AS y_,
   ({fn.SRGB_XYZ[2][0]} * r + {fn.SRGB_XYZ[2][1]} * g + {fn.SRGB_XYZ[2][2]} * b) / {fn.D65[2]} AS z_ FROM lin),
  f AS (SELECT {PX}, CASE WHEN x_ > 0.008856 THEN cbrt(x_) ELSE 7.787 * x_ + 16.0 / 116.0 END AS fx, CASE WHEN y_ > 0.008856 THEN cbrt(y_) ELSE 7.787 * y_ + 16.0 / 116.0 END AS fy,
   CASE WHEN z_ > 0.008856 THEN cbrt(z_) ELSE 7.787 * z_ + 16.0 / 116.0 END AS fz FROM xyz)
  SELECT {PX}, 116 * fy - 16 AS lightness, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b_axis FROM f""", "lightness a b_axis")
def _(spark, sf):
    return out(P.convert_color_space(rgb(spark, sf), "RGB to LAB"), "lightness", "a", "b_axis")


def wide(spark, sf):
    return P.channels_wide(fx.channels(spark, sf), {0: "v1", 1: "v2"})


@query("blend_channels", f"""WITH {fx.PAIRS}, s AS (SELECT {PX}, (v1 - min(v1) OVER w) / (max(v1) OVER w - min(v1) OVER w) AS a, (v2 - min(v2) OVER w) / (max(v2) OVER w - min(v2) OVER w) AS b FROM pair WINDOW w AS (PARTITION BY movie_id))
  SELECT {PX}, 0.7 * b AS red, 0.3 * a AS green, 0.7 * b AS blue FROM s""", "red green blue")
def _(spark, sf):
    return out(P.blend_channels(wide(spark, sf), alpha=0.3), "red", "green", "blue")


FRET = fx.PAIRS + ", fr AS (SELECT *, greatest(v1 + 0.5 - 0.1, 0) AS d, greatest(v2 + 0.5 - 0.2, 0) AS a FROM pair)"


def fret_pair(spark, sf):
    return wide(spark, sf).select("movie_id", "frame", "y", "x", (F.col("v1") + 0.5).alias("d"), (F.col("v2") + 0.5).alias("a"))


@query("apparent_fret", f"WITH {FRET} SELECT {PX}, CASE WHEN d + a > 0 THEN a / (d + a) END AS e FROM fr", "e")
def _(spark, sf):
    return fret_pair(spark, sf).withColumn("e", fn.apparent_fret(F.col("d"), F.col("a"), 0.1, 0.2)).drop("d", "a")


@query("corrected_fret", f"WITH {FRET}, g AS (SELECT *, a - 0.1 * d - 0.05 * a AS fc FROM fr) SELECT {PX}, CASE WHEN fc + 1.2 * d > 0 THEN fc / (fc + 1.2 * d) END AS e FROM g", "e")
def _(spark, sf):
    return fret_pair(spark, sf).withColumn("e", fn.corrected_fret(F.col("d"), F.col("a"), 0.1, 0.05, 1.2, 0.1, 0.2)).drop("d", "a")


@query("fret_stoichiometry", f"WITH {FRET} SELECT {PX}, CASE WHEN a + 1.2 * d > 0 THEN (a + d) / (a + 1.2 * d) END AS s FROM fr", "s")
def _(spark, sf):
    return fret_pair(spark, sf).withColumn("s", fn.fret_stoichiometry(F.col("d"), F.col("a"), 1.2, 0.1, 0.2)).drop("d", "a")


EFF = FRET + ", eff AS (SELECT movie_id, a / (d + a) AS e FROM fr WHERE d + a > 0)"


@query("fret_histogram", f"WITH {EFF} SELECT movie_id, CAST(least(floor(e / (1.0 / 20)), 19) AS INT) AS bin, count(*) AS n FROM eff WHERE e BETWEEN 0 AND 1 GROUP BY 1, 2")
def _(spark, sf):
    e = fret_pair(spark, sf).withColumn("e", fn.apparent_fret(F.col("d"), F.col("a"), 0.1, 0.2))
    return A.histogram(e, "e", 20, ["movie_id"], (0.0, 1.0))


@query("fret_stats", f"WITH {EFF} SELECT movie_id, avg(e) AS mean_e, stddev_pop(e) AS std_e, count(*) AS n_pixels, quantile_cont(e, 0.5) AS median_e FROM eff GROUP BY 1", "mean_e std_e median_e")
def _(spark, sf):
    e = fret_pair(spark, sf).withColumn("e", fn.apparent_fret(F.col("d"), F.col("a"), 0.1, 0.2))
    return A.fret_stats(e, ["movie_id"])


@query("trim", f"WITH {ST} SELECT movie_id, CAST((frame - 2) // 3 AS INT) AS frame, y, x, value FROM stack WHERE frame BETWEEN 2 AND 20 AND (frame - 2) % 3 = 0", "value")
def _(spark, sf):
    return out(P.trim(fx.stack(spark, sf), 2, 20, 3))


@query("trim_delete", f"WITH {ST} SELECT movie_id, CAST(dense_rank() OVER (PARTITION BY movie_id ORDER BY frame) - 1 AS INT) AS frame, y, x, value FROM stack WHERE NOT (frame BETWEEN 2 AND 20 AND (frame - 2) % 3 = 0)", "value")
def _(spark, sf):
    return out(P.trim(fx.stack(spark, sf), 2, 20, 3, delete=True))


@query("frame_remover", f"""WITH {ST}, gone AS (SELECT DISTINCT s + k AS frame FROM range(3, 31, 10) r(s), range(4) q(k))
  SELECT movie_id, CAST(dense_rank() OVER (PARTITION BY movie_id ORDER BY frame) - 1 AS INT) AS frame, y, x, value FROM stack WHERE frame NOT IN (SELECT frame FROM gone)""", "value")
def _(spark, sf):
    return out(P.frame_remover(fx.stack(spark, sf), 3, 30, 10, 4))


@query("deinterleave", f"WITH {ST} SELECT movie_id, CAST(frame % 3 AS INT) AS c, CAST(frame // 3 AS INT) AS frame, y, x, value FROM stack", "value")
def _(spark, sf):
    return P.deinterleave(fx.stack(spark, sf), 3).select("movie_id", "c", "frame", "y", "x", "value")


def region(name, predicate, inside):
    @query(name, f"WITH {ST} SELECT {PX}, value FROM stack WHERE {predicate}", "value")
    def _(spark, sf):
        return out(fx.stack(spark, sf).where(inside()))


region("roi_rectangle", "x >= 1.5 AND x < 6 AND y >= 2 AND y < 5", lambda: M.in_rectangle(1.5, 2, 6, 5))
region("roi_ellipse", "((x - 3.5) / 3.2) ** 2 + ((y - 3) / 2.1) ** 2 < 1", lambda: M.in_ellipse(3.5, 3.0, 3.2, 2.1))
region("roi_line", "y = floor((2 * 4 * x + 7) / 14)", lambda: M.on_line(0, 0, 7, 4))
region("roi_point", "x = 3 AND y = 5", lambda: M.at_point(3, 5))


@query("roi_polygon", f"""WITH {ST}, edge(xa, ya, xb, yb) AS (VALUES (1.0, 1.0, 6.5, 2.0), (6.5, 2.0, 5.0, 6.5), (5.0, 6.5, 2.0, 5.5), (2.0, 5.5, 1.0, 1.0)),
  grid AS (SELECT DISTINCT y, x FROM stack), inside AS (SELECT grid.y, grid.x FROM grid JOIN edge ON (ya <= grid.y) <> (yb <= grid.y) AND grid.x < xa + (grid.y - ya) * (xb - xa) / (yb - ya) GROUP BY 1, 2 HAVING count(*) % 2 = 1)
  SELECT {PX}, value FROM stack JOIN inside USING (y, x)""", "value")
def _(spark, sf):
    return out(fx.stack(spark, sf).where(M.in_polygon([(1.0, 1.0), (6.5, 2.0), (5.0, 6.5), (2.0, 5.5)])))


def operation(name, op, expr, doubles="value"):
    @query(name, f"WITH {fx.CHANNELS}, pr AS (SELECT a.*, a.value AS v1, b.value AS v2 FROM chan a JOIN chan b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y AND a.x = b.x WHERE a.c = 0 AND b.c = 1) SELECT {PX}, {expr} AS value FROM pr", doubles)
    def _(spark, sf):
        ch = fx.channels(spark, sf)
        return out(C.image_calculator(P.split_channel(ch, 0), P.split_channel(ch, 1), op))


operation("image_calculator_add", "Add", "v1 + v2")
operation("image_calculator_divide", "Divide", "CASE WHEN v2 = 0 THEN 0 ELSE v1 / v2 END")
operation("image_calculator_min", "Min", "least(v1, v2)")
operation("image_calculator_average", "Average", "(v1 + v2) / 2")
operation("image_calculator_xor", "XOR", "CAST((v1 <> 0) <> (v2 <> 0) AS INT)", "")


@query("image_calculator_still", f"WITH {ST}, m AS (SELECT movie_id, y, x, avg(value) AS a FROM stack GROUP BY 1, 2, 3) SELECT s.movie_id, frame, s.y, s.x, value - a AS value FROM stack s JOIN m ON s.movie_id = m.movie_id AND s.y = m.y AND s.x = m.x", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(C.image_calculator(s, s.groupBy("movie_id", "y", "x").agg(F.avg("value").alias("value")), "Subtract"))


@query("logically_combine", f"WITH {fx.PAIRS} SELECT {PX}, CAST(v1 > 0.05 AND v2 > 0.0 AS INT) AS value FROM pair")
def _(spark, sf):
    ch = fx.channels(spark, sf)
    return out(C.logically_combine(P.threshold(P.split_channel(ch, 0), 0.05), P.threshold(P.split_channel(ch, 1), 0.0), "AND"))


TRACE = ST + ", tr AS (SELECT movie_id, frame, avg(value) AS t FROM stack WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6 GROUP BY 1, 2)"


def rect(s):
    return M.mask_from(s, M.in_rectangle(2, 2, 6, 6))


@query("subtract_trace", f"WITH {TRACE} SELECT s.movie_id, s.frame, y, x, value - t AS value FROM stack s JOIN tr ON s.movie_id = tr.movie_id AND s.frame = tr.frame", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(C.subtract_trace(s, M.roi_trace(s, rect(s))))


@query("divide_trace", f"WITH {TRACE} SELECT s.movie_id, s.frame, y, x, value / (t + 1) AS value FROM stack s JOIN tr ON s.movie_id = tr.movie_id AND s.frame = tr.frame", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(C.divide_trace(s, M.roi_trace(s, rect(s)).withColumn("value", F.col("value") + 1)))


@query("roi_trace", f"WITH {TRACE} SELECT movie_id, 'roi' AS roi_id, frame, t AS value FROM tr", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return M.roi_trace(s, rect(s))


@query("point_trace", f"WITH {ST} SELECT movie_id, frame, value FROM stack WHERE x = 3 AND y = 5", "value")
def _(spark, sf):
    return M.point_trace(fx.stack(spark, sf), 3, 5)


@query("center_surround_trace", f"""WITH {ST} SELECT movie_id, frame, avg(value) FILTER (WHERE x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4) - avg(value) FILTER (WHERE NOT (x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4)) AS value
  FROM stack WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1, 2""", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return M.center_surround_trace(s, M.center_surround_mask(s, M.in_rectangle(3, 3, 5, 5), M.in_rectangle(1, 1, 7, 7)))


@query("band_trace", f"""WITH {ST}, place AS (SELECT 1 + i AS x, 1 + k AS y FROM range(6) a(i), range(-1, 2) b(k) UNION ALL SELECT 6 + k, 1 + i FROM range(5) a(i), range(-1, 2) b(k))
  SELECT movie_id, frame, avg(value) AS value FROM stack JOIN place USING (y, x) GROUP BY 1, 2""", "value")
def _(spark, sf):
    return M.band_trace(fx.stack(spark, sf), [(1.0, 1.0), (6.0, 1.0), (6.0, 5.0)], 3)


@query("roi_stats", f"""WITH {ST} SELECT movie_id, 'roi' AS roi_id, frame, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) AS area, sum(value) AS integrated
  FROM stack WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6 GROUP BY movie_id, frame""", "mean std min max integrated")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return M.roi_stats(s, rect(s))


@query("roi_stats_z", f"""WITH {fx.CHANNELS}, r AS (SELECT * FROM chan WHERE x >= 2 AND x < 6) SELECT movie_id, 'roi' AS roi_id, frame, c AS z, avg(value) AS mean FROM r GROUP BY movie_id, frame, c
  UNION ALL SELECT movie_id, 'roi', frame, NULL, avg(value) FROM r GROUP BY movie_id, frame""", "mean")
def _(spark, sf):
    s = fx.channels(spark, sf).withColumnRenamed("c", "z")
    return M.roi_stats_z(s, M.mask_from(s, M.in_rectangle(2, 0, 6, 4)))


@query("roi_shape")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return A.roi_shape(M.mask_from(s, M.in_ellipse(3.5, 3.0, 3.2, 2.1)))


@query("trace_export", f"""WITH {ST} SELECT movie_id, frame, avg(value) FILTER (WHERE x < 4) AS west, avg(value) FILTER (WHERE x >= 4) AS east FROM stack GROUP BY 1, 2""", "west east")
def _(spark, sf):
    from pixelweave.sources.tables import trace_table

    s = fx.stack(spark, sf)
    masks = M.union_masks([M.mask_from(s, F.col("x") < 4, "west"), M.mask_from(s, F.col("x") >= 4, "east")])
    return trace_table(M.roi_trace(s, masks), ["west", "east"])


@query("roi_histogram", f"""WITH {ST}, r AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM stack WHERE frame = 3 AND x >= 2 AND x < 6 AND y >= 2 AND y < 6 WINDOW w AS (PARTITION BY movie_id))
  SELECT movie_id, CAST(least(floor((value - lo) / ((hi - lo) / 8)), 7) AS INT) AS bin, count(*) AS n FROM r GROUP BY 1, 2""")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return A.roi_histogram(s, rect(s), 3, 8)


@query("chart_histogram", """WITH r AS (SELECT value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    return A.histogram(fx.table(spark, sf, "events"), "value", 30)


# -- projections over time --------------------------------------------------

@query("zproject", f"""WITH {ST} SELECT movie_id, y, x, avg(value) AS average, max(value) AS maximum, min(value) AS minimum, sum(value) AS total, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median
  FROM stack WHERE frame BETWEEN 2 AND 30 GROUP BY 1, 2, 3""", "average maximum minimum total std median")
def _(spark, sf):
    return P.zproject_all(fx.stack(spark, sf), 2, 30).drop("h", "w")


@query("zproject_median", f"WITH {ST} SELECT movie_id, y, x, quantile_cont(value, 0.5) AS value FROM stack WHERE frame BETWEEN 0 AND 19 GROUP BY 1, 2, 3", "value")
def _(spark, sf):
    return P.zproject(fx.stack(spark, sf), 0, 19, "Median").drop("h", "w")


@query("frame_binning", f"WITH {ST} SELECT movie_id, CAST(frame // 4 AS INT) AS frame, y, x, avg(value) AS value FROM stack GROUP BY 1, 2, 3, 4", "value")
def _(spark, sf):
    return out(P.frame_binning(fx.stack(spark, sf), 4))


@query("pixel_binning", f"WITH {ST} SELECT movie_id, frame, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, avg(value) AS value FROM stack GROUP BY 1, 2, 3, 4 HAVING count(*) = 4", "value")
def _(spark, sf):
    return out(P.pixel_binning(fx.stack(spark, sf)))


@query("resize", f"""WITH {ST}, axis AS (SELECT CAST(t AS INT) AS t, CAST(s AS INT) AS s, 1 - abs(least(greatest((t + 0.5) / 2 - 0.5, 0), 7) - s) AS wt FROM range(16) a(t), range(8) b(s))
  SELECT movie_id, frame, v.t AS y, u.t AS x, sum(value * v.wt * u.wt) AS value FROM stack JOIN axis v ON v.s = y AND v.wt > 0 JOIN axis u ON u.s = x AND u.wt > 0 GROUP BY 1, 2, 3, 4""", "value")
def _(spark, sf):
    return out(P.resize(fx.stack(spark, sf), 2))


def norm(name, method, expr):
    @query(name, f"WITH {ST}, s AS (SELECT movie_id, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM stack GROUP BY 1) "
           f"SELECT k.movie_id, frame, y, x, {expr} AS value FROM stack k JOIN s ON k.movie_id = s.movie_id", "value")
    def _(spark, sf):
        return out(P.normalize(fx.stack(spark, sf), method))


norm("normalize_min_max", "Min-Max (0-1)", "(value - lo) / (hi - lo)")
norm("normalize_z_score", "Z-Score", "(value - m) / sd")
norm("normalize_percentile", "Percentile (1-99%)", "least(greatest((value - p1) / (p99 - p1), 0), 1)")


@query("ratio_baseline", f"""WITH {ST}, b AS (SELECT movie_id, y, x, avg(value - 0.01) AS b FROM stack WHERE frame BETWEEN 1 AND 5 GROUP BY 1, 2, 3),
  l AS (SELECT movie_id, min(abs(b)) FILTER (WHERE b <> 0) AS l FROM b GROUP BY 1) SELECT s.movie_id, frame, s.y, s.x, (value - 0.01) / CASE WHEN b = 0 THEN l ELSE b END AS value
  FROM stack s JOIN b ON s.movie_id = b.movie_id AND s.y = b.y AND s.x = b.x JOIN l ON s.movie_id = l.movie_id""", "value", digits=4)
def _(spark, sf):
    return out(A.ratio_baseline(fx.stack(spark, sf), 1, 5, "average", 0.01))


@query("ratio_baseline_std", f"""WITH {ST}, b AS (SELECT movie_id, y, x, stddev_pop(value) AS b FROM stack WHERE frame BETWEEN 1 AND 5 GROUP BY 1, 2, 3)
  SELECT s.movie_id, frame, s.y, s.x, value / b AS value FROM stack s JOIN b ON s.movie_id = b.movie_id AND s.y = b.y AND s.x = b.x""", "value", digits=4)
def _(spark, sf):
    return out(A.ratio_baseline(fx.stack(spark, sf), 1, 5, "standard deviation"))


@query("dff_image", f"""WITH {ST}, n AS (SELECT movie_id, max(frame) + 1 AS n FROM stack GROUP BY 1), b AS (SELECT s.movie_id, y, x, avg(value + 1) AS f FROM stack s JOIN n ON s.movie_id = n.movie_id WHERE frame < greatest(1, n // 10) GROUP BY 1, 2, 3)
  SELECT s.movie_id, frame, s.y, s.x, (value + 1 - f) / f AS value FROM stack s JOIN b ON s.movie_id = b.movie_id AND s.y = b.y AND s.x = b.x""", "value")
def _(spark, sf):
    return out(A.dff_image(P.subtract(fx.stack(spark, sf), -1.0)))


def background(name, method, expr, per_frame):
    keys = "movie_id, frame" if per_frame else "movie_id"
    on = "s.movie_id = b.movie_id" + (" AND s.frame = b.frame" if per_frame else "")

    @query(name, f"WITH {ST}, b AS (SELECT {keys}, {expr} AS b FROM stack GROUP BY {keys}) SELECT s.movie_id, s.frame, y, x, value - b AS value FROM stack s JOIN b ON {on}", "value")
    def _(spark, sf):
        return out(A.background_subtract(fx.stack(spark, sf), "stat", method, per_frame))


background("background_stat_mean", "Mean", "avg(value)", True)
background("background_stat_mode", "Mode", "3 * quantile_cont(value, 0.5) - 2 * avg(value)", True)
background("background_stat_median", "Median", "quantile_cont(value, 0.5)", False)
background("background_stat_p5", "5th Percentile", "quantile_cont(value, 0.05)", True)
background("background_subtract", "25th Percentile", "quantile_cont(value, 0.25)", False)


@query("background_roi", f"WITH {TRACE} SELECT s.movie_id, s.frame, y, x, value - t AS value FROM stack s JOIN tr ON s.movie_id = tr.movie_id AND s.frame = tr.frame", "value")
def _(spark, sf):
    s = fx.stack(spark, sf)
    return out(A.background_roi(s, rect(s)))


@query("background_auto_roi", f"""WITH {ST}, p AS (SELECT movie_id, y, x, max(value) AS v FROM stack GROUP BY 1, 2, 3), o AS (SELECT CAST(wy AS INT) AS wy, CAST(wx AS INT) AS wx FROM range(0, 6, 2) a(wy), range(0, 6, 2) b(wx)),
  m AS (SELECT movie_id, wy, wx, avg(v) AS mi FROM p JOIN o ON y >= wy AND y < wy + 3 AND x >= wx AND x < wx + 3 GROUP BY 1, 2, 3),
  best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY mi, wy, wx) <= 4),
  f AS (SELECT s.movie_id, b.wy, b.wx, mi, frame, avg(value) AS fm FROM stack s JOIN best b ON s.movie_id = b.movie_id AND y >= wy AND y < wy + 3 AND x >= wx AND x < wx + 3 GROUP BY ALL),
  t AS (SELECT movie_id, wy, wx, mi, stddev_pop(fm) AS ts FROM f GROUP BY ALL)
  SELECT movie_id, wy, wx, 3 AS roi_w, 3 AS roi_h, mi AS mean_intensity, ts AS temporal_std FROM t QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY ts, mi, wy, wx) = 1""", "mean_intensity temporal_std")
def _(spark, sf):
    return A.background_auto_roi(fx.stack(spark, sf), 3, 3, 2, 4)


@query("bleach_ratio", f"""WITH {ST}, f AS (SELECT movie_id, frame, avg(value + 1) AS fm FROM stack GROUP BY 1, 2), g AS (SELECT movie_id, avg(value + 1) AS gm FROM stack GROUP BY 1)
  SELECT s.movie_id, s.frame, y, x, (value + 1) * CASE WHEN fm > 1e-10 THEN gm / fm ELSE 1 END AS value FROM stack s JOIN f ON s.movie_id = f.movie_id AND s.frame = f.frame JOIN g ON s.movie_id = g.movie_id""", "value")
def _(spark, sf):
    return out(A.bleach_ratio(P.subtract(fx.stack(spark, sf), -1.0)))


@query("bleach_histogram")
def _(spark, sf):
    return out(A.bleach_histogram(fx.stack(spark, sf)))


@query("histogram_equalize", f"""WITH {ST}, r AS (SELECT *, min(value) OVER w AS lo, (max(value) OVER w - min(value) OVER w) / 16 AS wd FROM stack WINDOW w AS (PARTITION BY movie_id, frame)),
  b AS (SELECT *, least(floor((value - lo) / wd), 15) AS bin FROM r), g AS (SELECT movie_id, frame, k AS bin FROM (SELECT DISTINCT movie_id, frame FROM stack) q, range(16) z(k)),
  h AS (SELECT g.movie_id, g.frame, g.bin, count(b.value) AS c FROM g LEFT JOIN b ON g.movie_id = b.movie_id AND g.frame = b.frame AND g.bin = b.bin GROUP BY 1, 2, 3),
  c AS (SELECT movie_id, frame, bin, sum(c) OVER (PARTITION BY movie_id, frame ORDER BY bin) / sum(c) OVER (PARTITION BY movie_id, frame) AS cdf FROM h),
  p AS (SELECT *, least(greatest((value - lo) / wd - 0.5, 0), 15) AS pos FROM r)
  SELECT p.movie_id, p.frame, p.y, p.x, c0.cdf + (c1.cdf - c0.cdf) * (pos - floor(pos)) AS value FROM p JOIN c c0 ON c0.movie_id = p.movie_id AND c0.frame = p.frame AND c0.bin = floor(pos)
   JOIN c c1 ON c1.movie_id = p.movie_id AND c1.frame = p.frame AND c1.bin = least(floor(pos) + 1, 15)""", "value")
def _(spark, sf):
    return out(A.histogram_equalize(fx.stack(spark, sf), 16))


# -- pixel pairs ------------------------------------------------------------

@query("pearson", f"WITH {fx.PAIRS} SELECT movie_id, corr(v1, v2) AS pearson FROM pair GROUP BY 1", "pearson")
def _(spark, sf):
    return A.pearson(wide(spark, sf), ["movie_id"])


@query("manders", f"""WITH {fx.PAIRS} SELECT movie_id, sum(v1) FILTER (WHERE v2 > 0.05) / sum(v1) AS m1, sum(v2) FILTER (WHERE v1 > 0.02) / sum(v2) AS m2 FROM (SELECT movie_id, abs(v1) AS v1, abs(v2) AS v2 FROM pair) p GROUP BY 1""", "m1 m2")
def _(spark, sf):
    return A.manders(wide(spark, sf).withColumns({"v1": F.abs("v1"), "v2": F.abs("v2")}), ["movie_id"], 0.02, 0.05)


@query("li_icq", f"WITH {fx.PAIRS}, m AS (SELECT movie_id, avg(v1) AS a, avg(v2) AS b FROM pair GROUP BY 1) SELECT p.movie_id, avg(CASE WHEN (v1 - a) * (v2 - b) > 0 THEN 1.0 ELSE 0.0 END) - 0.5 AS icq FROM pair p JOIN m ON p.movie_id = m.movie_id GROUP BY 1", "icq")
def _(spark, sf):
    return A.li_icq(wide(spark, sf), ["movie_id"])


@query("costes_threshold")
def _(spark, sf):
    return A.costes_threshold(wide(spark, sf), ["movie_id"])


# -- sets -------------------------------------------------------------------

@query("concatenate_stacks", f"""WITH {fx.CHANNELS}, n AS (SELECT movie_id, max(frame) + 1 AS n FROM chan GROUP BY 1) SELECT {PX}, value FROM chan WHERE c = 0
  UNION ALL SELECT c.movie_id, CAST(frame + n AS INT) AS frame, y, x, value FROM chan c JOIN n ON c.movie_id = n.movie_id WHERE c.c = 1""", "value")
def _(spark, sf):
    ch = fx.channels(spark, sf)
    return out(P.concatenate_stacks(P.split_channel(ch, 0), P.split_channel(ch, 1)))


MASKS = ST + """, ma AS (SELECT DISTINCT y, x FROM stack WHERE x >= 1 AND x < 5 AND y >= 1 AND y < 6), mb AS (SELECT DISTINCT y, x FROM stack WHERE x >= 3 AND x < 7 AND y >= 0 AND y < 4)"""


def boolean(op, body):
    @query(f"roi_boolean_{op.lower()}", f"WITH {MASKS} {body}")
    def _(spark, sf):
        s = fx.stack(spark, sf)
        return M.roi_boolean(M.mask_from(s, M.in_rectangle(1, 1, 5, 6)), M.mask_from(s, M.in_rectangle(3, 0, 7, 4)), op)


boolean("AND", "SELECT * FROM ma INTERSECT SELECT * FROM mb")
boolean("OR", "SELECT * FROM ma UNION SELECT * FROM mb")
boolean("SUBTRACT", "SELECT * FROM ma EXCEPT SELECT * FROM mb")
boolean("XOR", "(SELECT * FROM ma EXCEPT SELECT * FROM mb) UNION (SELECT * FROM mb EXCEPT SELECT * FROM ma)")


def transform(op, body):
    @query(f"roi_transform_{op}", f"WITH {MASKS}, o AS (SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)), "
           f"g AS (SELECT y + dy AS y, x + dx AS x FROM ma, o), grown AS (SELECT DISTINCT y, x FROM g WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7) {body}")
    def _(spark, sf):
        return M.roi_transform(M.mask_from(fx.stack(spark, sf), M.in_rectangle(1, 1, 5, 6)), op, 1, 8, 8)


transform("enlarge", "SELECT * FROM grown")
transform("band", "SELECT * FROM grown EXCEPT SELECT * FROM ma")
transform("shrink", "SELECT y, x FROM g GROUP BY y, x HAVING count(*) = 9")


# -- regions, texture, counts ----------------------------------------------

LABELS = ST + """, lab AS (SELECT movie_id, frame, CAST(1 + (y // 4) * 2 + x // 4 AS INT) AS label, y, x, value FROM stack WHERE value > -0.1)"""


@query("region_properties", f"""WITH {LABELS}, nb AS (SELECT a.movie_id, a.frame, a.label, a.y, a.x, count(b.x) AS n FROM lab a LEFT JOIN lab b ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
  pe AS (SELECT movie_id, frame, label, CAST(count(*) FILTER (WHERE n < 4) AS DOUBLE) AS perimeter FROM nb GROUP BY 1, 2, 3),
  g AS (SELECT movie_id, frame, label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, min(y) AS bbox_y0, min(x) AS bbox_x0, max(y) AS bbox_y1, max(x) AS bbox_x1,
   var_samp(y) AS vy, var_samp(x) AS vx, covar_samp(y, x) AS vxy, avg(value) AS mean_intensity, max(value) AS max_intensity, min(value) AS min_intensity, stddev_pop(value) AS std_intensity, sum(value) AS total_intensity FROM lab GROUP BY 1, 2, 3),
  e AS (SELECT g.*, CASE WHEN perimeter = 0 THEN area ELSE perimeter END AS perimeter, CASE WHEN area >= 2 THEN 4 * sqrt(greatest((vy + vx + sqrt((vy - vx) ** 2 + 4 * vxy * vxy)) / 2, 0)) ELSE 1 END AS major_axis,
   CASE WHEN area >= 2 THEN 4 * sqrt(greatest((vy + vx - sqrt((vy - vx) ** 2 + 4 * vxy * vxy)) / 2, 0)) ELSE 1 END AS minor_axis FROM g JOIN pe ON g.movie_id = pe.movie_id AND g.frame = pe.frame AND g.label = pe.label)
  SELECT movie_id, frame, label, area, centroid_y, centroid_x, bbox_y0, bbox_x0, bbox_y1, bbox_x1, perimeter, major_axis, sqrt(greatest(1 - (minor_axis / major_axis) ** 2, 0)) AS eccentricity, 4 * pi() * area / perimeter ** 2 AS circularity,
   area / ((bbox_y1 - bbox_y0 + 1) * (bbox_x1 - bbox_x0 + 1)) AS extent, mean_intensity, std_intensity, total_intensity FROM e""",
       "centroid_y centroid_x perimeter major_axis eccentricity circularity extent mean_intensity std_intensity total_intensity")
def _(spark, sf):
    lab = fx.stack(spark, sf).where("value > -0.1").withColumn("label", (1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("int"))
    return A.region_properties(lab, ["movie_id", "frame"]).select(
        "movie_id", "frame", "label", "area", "centroid_y", "centroid_x", "bbox_y0", "bbox_x0", "bbox_y1", "bbox_x1", "perimeter", "major_axis",
        "eccentricity", "circularity", "extent", "mean_intensity", "std_intensity", "total_intensity")


@query("texture_glcm", f"""WITH {ST}, r AS (SELECT *, CAST(least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 7), 7) AS INT) AS q FROM stack WINDOW w AS (PARTITION BY movie_id, frame)),
  pr AS (SELECT movie_id, frame, q AS i, lead(q) OVER (PARTITION BY movie_id, frame, y ORDER BY x) AS j FROM r), c AS (SELECT movie_id, frame, i, j, count(*) AS n FROM pr WHERE j IS NOT NULL GROUP BY ALL),
  p AS (SELECT *, n / sum(n) OVER (PARTITION BY movie_id, frame) AS p FROM c), m AS (SELECT movie_id, frame, sum(i * p) AS mi, sum(j * p) AS mj FROM p GROUP BY 1, 2)
  SELECT p.movie_id, p.frame, sum((i - j) ** 2 * p) AS contrast, sum(abs(i - j) * p) AS dissimilarity, sum(p / (1 + (i - j) ** 2)) AS homogeneity, sum(p * p) AS energy, -sum(p * log2(p)) AS entropy,
   sum((i - mi) * (j - mj) * p) / sqrt(sum((i - mi) ** 2 * p) * sum((j - mj) ** 2 * p)) AS correlation FROM p JOIN m ON p.movie_id = m.movie_id AND p.frame = m.frame GROUP BY 1, 2""",
       "contrast dissimilarity homogeneity energy entropy correlation")
def _(spark, sf):
    return A.texture_glcm(fx.stack(spark, sf), 8)


@query("hu_moments", f"""WITH {ST}, b AS (SELECT movie_id, frame, x, y FROM stack WHERE value > 0), c AS (SELECT movie_id, frame, count(*) AS m, avg(x) AS cx, avg(y) AS cy FROM b GROUP BY 1, 2),
  u AS (SELECT b.movie_id, b.frame, any_value(m) AS m, avg((x - cx) ** 2) AS u20, avg((y - cy) ** 2) AS u02, avg((x - cx) * (y - cy)) AS u11, avg((x - cx) ** 3) AS u30, avg((y - cy) ** 3) AS u03, avg((x - cx) ** 2 * (y - cy)) AS u21, avg((x - cx) * (y - cy) ** 2) AS u12
   FROM b JOIN c ON b.movie_id = c.movie_id AND b.frame = c.frame GROUP BY 1, 2),
  n AS (SELECT movie_id, frame, u20 / m AS n20, u02 / m AS n02, u11 / m AS n11, u30 / m ** 1.5 AS n30, u03 / m ** 1.5 AS n03, u21 / m ** 1.5 AS n21, u12 / m ** 1.5 AS n12 FROM u)
  SELECT movie_id, frame, n20 + n02 AS hu_1, (n20 - n02) ** 2 + 4 * n11 ** 2 AS hu_2, (n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2 AS hu_3, (n30 + n12) ** 2 + (n21 + n03) ** 2 AS hu_4,
   (n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) ** 2 - 3 * (n21 + n03) ** 2) + (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) ** 2 - (n21 + n03) ** 2) AS hu_5,
   (n20 - n02) * ((n30 + n12) ** 2 - (n21 + n03) ** 2) + 4 * n11 * (n30 + n12) * (n21 + n03) AS hu_6,
   (3 * n21 - n03) * (n30 + n12) * ((n30 + n12) ** 2 - 3 * (n21 + n03) ** 2) - (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) ** 2 - (n21 + n03) ** 2) AS hu_7 FROM n""",
       "hu_1 hu_2 hu_3 hu_4 hu_5 hu_6 hu_7")
def _(spark, sf):
    return A.hu_moments(fx.stack(spark, sf).where("value > 0"), ["movie_id", "frame"])


CATEGORIES = ["click", "error", "purchase", "signup", "view"]
COUNTS = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in CATEGORIES)


@query("count_summary", f"""WITH {fx.MARKERS}, sp AS (SELECT CAST(unnest(range(min(frame), max(frame) + 1)) AS INT) AS frame FROM mk)
  SELECT sp.frame, {COUNTS}, count(category) AS total FROM sp LEFT JOIN mk ON sp.frame = mk.frame GROUP BY 1""")
def _(spark, sf):
    return A.count_summary(fx.markers(spark, sf), CATEGORIES)


@query("count_summary_totals", f"WITH {fx.MARKERS} SELECT category, count(*) AS n FROM mk GROUP BY 1 UNION ALL SELECT 'Total', count(*) FROM mk")
def _(spark, sf):
    return A.count_summary(fx.markers(spark, sf), CATEGORIES, by_frame=False)


@query("count_summary_export", f"WITH {fx.MARKERS} SELECT frame, {COUNTS}, count(*) AS total FROM mk GROUP BY 1")
def _(spark, sf):
    m = fx.markers(spark, sf)
    return A.count_summary(m, CATEGORIES).where("total > 0")


@query("table_sort", "SELECT event_id, value FROM events ORDER BY value DESC, event_id", "value")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", "value").orderBy(F.col("value").desc(), "event_id")


@query("line_sort", "SELECT value AS x, CAST(props->>'k' AS DOUBLE) AS y FROM events WHERE isfinite(value) ORDER BY x", "x y")
def _(spark, sf):
    from pixelweave.operators.charts import line_sort

    return line_sort(fx.markers(spark, sf), "x", "y")


@query("table_query", "SELECT event_id, value FROM events WHERE value > 50 AND event_type <> 'error'", "value")
def _(spark, sf):
    from pixelweave.operators.charts import table_query

    return table_query(fx.table(spark, sf, "events"), "value > 50 AND event_type <> 'error'").select("event_id", "value")
