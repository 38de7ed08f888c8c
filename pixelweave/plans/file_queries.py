"""Checked queries that write a whole table with a writer of the library and read it back with a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelweave.operators import userfn
from pixelweave.plans import fixtures as fx
from pixelweave.plans.catalog import query
from pixelweave.session import ensure_checkpoint_dir
from pixelweave.sources import localizations as LF
from pixelweave.sources import tables as TB


def folder(spark: SparkSession, suffix: str = "") -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4()}{suffix}"


LOCS = f"WITH {fx.LOCS} SELECT CAST(frame AS BIGINT) AS frame, x, y, intensity FROM locs"
TRACKS = f"WITH {fx.TRACKS} SELECT track_id, CAST(frame AS BIGINT) AS frame, x, y, intensity FROM trk"


@query("read_thunderstorm", LOCS, "x y intensity")
def _(spark, sf):
    LF.write_thunderstorm(fx.locs(spark, sf), path := folder(spark))
    return LF.read_thunderstorm(spark, path)


@query("read_localizations", LOCS, "x y intensity")
def _(spark, sf):
    LF.write_localizations(fx.locs(spark, sf), path := folder(spark), "thunderstorm")
    return LF.read_localizations(spark, path)


@query("read_thunderstorm_full", f"WITH {fx.LOCS} SELECT id + 1 AS id, CAST(frame AS BIGINT) AS frame, x, y, intensity, CAST(-1 AS BIGINT) AS track_id FROM locs", "x y intensity")
def _(spark, sf):
    LF.to_particle_csv(fx.locs(spark, sf)).write.option("header", True).csv(path := folder(spark))
    return LF.read_thunderstorm_full(spark, path).select("id", "frame", "x", "y", "intensity", "track_id")


@query("read_locs_csv", f"WITH {fx.LOCS} SELECT id, CAST(frame AS BIGINT) AS frame, x, y, intensity FROM locs", "x y intensity")
def _(spark, sf):
    LF.write_localizations(fx.locs(spark, sf), path := folder(spark), "native")
    return LF.read_locs_csv(spark, path)


@query("read_tracks", TRACKS, "x y intensity")
def _(spark, sf):
    LF.write_localizations(fx.tracks(spark, sf), path := folder(spark), "native")
    return LF.read_tracks(spark, path)


@query("write_localizations", TRACKS, "x y intensity")
def _(spark, sf):
    LF.write_localizations(fx.tracks(spark, sf), path := folder(spark, ".json"), "json")
    return LF.read_localizations(spark, path).select("track_id", "frame", "x", "y", "intensity")


@query("read_locs_json", TRACKS, "x y intensity")
def _(spark, sf):
    LF.write_locs_json(fx.tracks(spark, sf), path := folder(spark))
    return LF.read_locs_json(spark, path)


@query("read_spt_csv", f"WITH {fx.LOCS} SELECT id, CAST(frame AS BIGINT) AS frame, x, y, intensity, CASE WHEN intensity > 50000 THEN -1 ELSE id % 1000 END AS track_id FROM locs", "x y intensity")
def _(spark, sf):
    raw = fx.locs(spark, sf).select(F.col("id").alias("ID"), F.col("frame").alias(" Frame"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("intensity").alias("Intensities"),
                                    F.when(F.col("intensity") <= 50000, F.col("id") % 1000).alias("particle"))
    raw.write.option("header", True).csv(path := folder(spark))
    return LF.read_spt_csv(spark, path)


@query("read_spt_txt", f"WITH {fx.TRACKS} SELECT CAST(frame AS BIGINT) AS frame, x, y, intensity, track_id FROM trk", "x y intensity")
def _(spark, sf):
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("frame", "x", "y", "intensity", "track_id")))
    fx.tracks(spark, sf).select(line).write.text(path := folder(spark))
    return LF.read_spt_txt(spark, path).drop("id")


@query("read_spt_json", """WITH p AS (SELECT event_type, value, ts, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS id FROM events),
  t AS (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS track FROM events GROUP BY 1, 2)
  SELECT p.event_type AS source, id, id % 50 AS frame, value AS x, CAST(0 AS DOUBLE) AS intensity, CASE WHEN n > 1 THEN track ELSE -1 END AS track_id FROM p JOIN t ON p.event_type = t.event_type AND p.user_id = t.user_id""", "x intensity")
def _(spark, sf):
    """One document per event type: its points in time order, and per user the list of their places."""
    from pixelweave.operators.blocks import dense_index

    events = fx.table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id", "value")
    points = dense_index(events, ["event_type"], ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / 3600), "id", None)
    txy = points.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("id", F.array((F.col("id") % 50).cast("double"), "value", F.lit(1.0)).alias("p")))).alias("p"))
    lists = points.groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list("id")).alias("m"))
    lists = lists.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("user_id", "m"))).alias("m"))
    docs = txy.join(lists, "event_type").select("event_type", F.transform("p", lambda v: v["p"]).alias("txy_pts"), F.transform("m", lambda v: v["m"]).alias("tracks"))
    docs.write.partitionBy("event_type").json(path := folder(spark))
    return LF.read_spt_json(spark, path).select(F.regexp_extract("file", "event_type=([^/]*)/", 1).alias("source"), "id", "frame", "x", "intensity", "track_id")


POINTS = f"WITH {fx.LOCS} SELECT CAST(frame AS BIGINT) AS t, x, y FROM locs"


@query("read_points", POINTS, "x y")
def _(spark, sf):
    LF.write_points(fx.locs(spark, sf).withColumnRenamed("frame", "t"), path := folder(spark))
    return LF.read_points(spark, path)


@query("write_points", POINTS, "x y")
def _(spark, sf):
    LF.write_points(fx.locs(spark, sf).withColumnRenamed("frame", "t"), path := folder(spark))
    return spark.read.schema("t long, x double, y double").option("sep", " ").csv(path)


@query("features_io", f"WITH {fx.TRACKS} SELECT track_id, CAST(count(*) AS DOUBLE) AS n_points, avg(x) AS mean_x, max(intensity) AS max_intensity FROM trk GROUP BY 1", "n_points mean_x max_intensity")
def _(spark, sf):
    features = fx.tracks(spark, sf).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("mean_x"), F.max("intensity").alias("max_intensity"))
    LF.write_features(features, path := folder(spark))
    return LF.read_features(spark, path)


@query("rois_read", f"""WITH {fx.BOXES}, r AS (SELECT image_id, 0 AS pos, x, y FROM box UNION ALL SELECT image_id, 1, width, height FROM box)
  SELECT image_id, 'rectangle' AS kind, pos, CAST(trunc(x) AS INT) AS x, CAST(trunc(y) AS INT) AS y FROM r""")
def _(spark, sf):
    block = F.format_string("rectangle\n%s %s\n%s %s\n", *(F.col(c).cast("string") for c in ("x", "y", "width", "height")))
    TB.write_rois(fx.boxes(spark, sf).select("image_id", block), path := folder(spark))
    image = F.regexp_extract("file", "image_id=([^/]*)/", 1).cast("long").alias("image_id")
    return TB.read_rois(spark, path).select(image, "kind", "pos", "x", "y")


@query("batch_processor", f"WITH {fx.TRACKS} SELECT 'ok' AS status, '' AS error, count(*) AS lines FROM trk")
def _(spark, sf):
    LF.write_points(fx.tracks(spark, sf).withColumnRenamed("frame", "t"), path := folder(spark))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    counted = userfn.process_files(files, lambda name, content: content.count(b"\n"))
    return counted.groupBy("status", "error").agg(F.sum(F.col("result").cast("long")).alias("lines"))
