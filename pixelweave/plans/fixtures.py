"""The test tables seen as stacks, tracks, localizations, traces, spectra,
markers and boxes (F1-F8 of FIXTURES.md), each as a Spark frame and as the
matching SQL common table expression."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.operators.blocks import dense_index


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _numbered(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return dense_index(emb, ["label"], ["vec_id"], F.floor(F.col("vec_id") / F.lit(65536)), "frame", None)


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """dense 8 x 8 frames, one movie per label."""
    rows = _numbered(spark, sf).select(
        F.col("label").alias("movie_id"), F.col("frame").cast("int").alias("frame"),
        F.posexplode("embedding").alias("k", "v"))
    return rows.select("movie_id", "frame", F.floor(F.col("k") / 8).cast("int").alias("y"),
                       (F.col("k") % 8).alias("x"), F.col("v").cast("double").alias("value"),
                       F.lit(8).alias("h"), F.lit(8).alias("w"))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """two channels of 4 x 8 frames."""
    rows = _numbered(spark, sf).select(
        F.col("label").alias("movie_id"), F.col("frame").cast("int").alias("frame"),
        F.posexplode("embedding").alias("k", "v"))
    return rows.select("movie_id", "frame", F.floor(F.col("k") / 32).cast("int").alias("c"),
                       F.floor((F.col("k") % 32) / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"),
                       F.col("v").cast("double").alias("value"), F.lit(4).alias("h"), F.lit(8).alias("w"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """one track per user, frames numbered in time order."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value", "props")
    rows = dense_index(ev, ["user_id"], ["ts", "event_id"],
                       F.floor(F.unix_timestamp("ts") / F.lit(3600)), "frame", None)
    return rows.select(F.col("user_id").alias("track_id"), F.col("frame").cast("int").alias("frame"),
                       F.col("value").alias("x"), _k().alias("y"), F.col("value").alias("intensity"))


def tracks_gappy(spark: SparkSession, sf: str) -> DataFrame:
    """F3 with frames counted in minutes; one point (the first event) per minute."""
    ev = table(spark, sf, "events")
    frame = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 60).cast("int")
    first = F.min_by(F.struct("value", _k().alias("k")), F.struct("ts", "event_id")).alias("p")
    return ev.groupBy(F.col("user_id").alias("track_id"), frame.alias("frame")).agg(first).select(
        "track_id", "frame", F.col("p.value").alias("x"), F.col("p.k").alias("y"), F.col("p.value").alias("intensity"))


def _k():
    return F.get_json_object("props", "$.k").cast("double")


def line_id() -> Column:
    """The id of a line item: (((order * 8 + line) * 100000 + part) * 10000 + supplier) * 100 + quantity.

    Order keys above some 11 million leave 64 bits, where the SQL has no value;
    such ids are the same number less a multiple of 2^64.
    """
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rest = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    wide = line.cast("decimal(20,0)") * F.lit(10**11).cast("decimal(12,0)") + rest
    half, whole = F.lit(Decimal(2**63)), F.lit(Decimal(2**64))
    return F.when(F.abs(line) <= 92_000_000, line * F.lit(10**11) + rest).otherwise((F.pmod(wide + half, whole) - half).cast("long"))


def locs(spark: SparkSession, sf: str) -> DataFrame:
    """localizations from line items, one frame per ship day."""
    li = table(spark, sf, "lineitem")
    return li.select(line_id().alias("id"), F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01")).alias("frame"),
                     (F.col("l_extendedprice") % 128).alias("x"),
                     ((37 * F.col("l_partkey")) % 128 + F.col("l_discount")).alias("y"),
                     F.col("l_extendedprice").alias("intensity"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """one trace per user."""
    return tracks(spark, sf).select(F.col("track_id").alias("trace_id"), F.col("frame").alias("t"),
                                    F.col("intensity").alias("value"))


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """eight-band spectra."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pixel_id"),
        F.transform(F.slice("embedding", 1, 8), lambda v: F.abs(v.cast("double"))).alias("data"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """markers by event type and day."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("frame"),
        F.col("value").alias("x"), _k().alias("y"), F.col("event_id").alias("number"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """F8: box annotations, one image per supplier."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("image_id"), line_id().alias("id"),
                     (F.col("l_partkey") % 512).cast("double").alias("x"), (F.col("l_extendedprice") % 512).alias("y"),
                     (F.col("l_quantity") + 8).alias("width"), (F.col("l_quantity") / 2 + 8).alias("height"),
                     F.col("l_returnflag").alias("class_name"), (1 - F.col("l_discount")).alias("confidence"))


STACK = """stack AS (SELECT label AS movie_id, frame, CAST(k // 8 AS INT) AS y, CAST(k % 8 AS INT) AS x, CAST(v AS DOUBLE) AS value
  FROM (SELECT label, frame, unnest(range(64)) AS k, unnest(embedding) AS v FROM (
    SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame FROM embeddings) AS e) AS u)"""

CHANNELS = """chan AS (SELECT label AS movie_id, frame, CAST(k // 32 AS INT) AS c, CAST((k % 32) // 8 AS INT) AS y, CAST(k % 8 AS INT) AS x, CAST(v AS DOUBLE) AS value
  FROM (SELECT label, frame, unnest(range(64)) AS k, unnest(embedding) AS v FROM (
    SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame FROM embeddings) AS e) AS u)"""

PAIRS = CHANNELS + """,
pair AS (SELECT a.movie_id, a.frame, a.y, a.x, a.value AS v1, b.value AS v2 FROM chan a JOIN chan b
  ON a.movie_id = b.movie_id AND a.frame = b.frame AND a.y = b.y AND a.x = b.x WHERE a.c = 0 AND b.c = 1)"""

TRACKS = """trk AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
  value AS x, CAST(props->>'k' AS DOUBLE) AS y, value AS intensity FROM events),
pts AS (SELECT *, frame AS idx, count(*) OVER (PARTITION BY track_id) AS n,
  lag(x, 1) OVER w AS xm1, lag(y, 1) OVER w AS ym1, lag(x, 2) OVER w AS xm2, lag(y, 2) OVER w AS ym2,
  lead(x, 1) OVER w AS xp1, lead(y, 1) OVER w AS yp1, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0
  FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame))"""

TRACKS_GAPPY = """trk AS (SELECT track_id, frame, p.value AS x, p.k AS y, p.value AS intensity FROM (
  SELECT user_id AS track_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 60) AS INT) AS frame,
    arg_min({'value': value, 'k': CAST(props->>'k' AS DOUBLE)}, {'ts': ts, 'event_id': event_id}) AS p
  FROM events GROUP BY 1, 2) AS g),
pts AS (SELECT *, lead(x) OVER w AS xp1, lead(y) OVER w AS yp1, lag(frame) OVER w AS fm1,
  first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(frame) OVER w AS f0
  FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame))"""

LOCS = """locs AS (SELECT (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS frame, l_extendedprice % 128 AS x,
  (37 * l_partkey) % 128 + l_discount AS y, l_extendedprice AS intensity FROM lineitem)"""

TRACES = """trc AS (SELECT user_id AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t, value FROM events)"""

SPECTRA = """spec AS (SELECT vec_id AS pixel_id, [abs(CAST(v AS DOUBLE)) FOR v IN embedding[1:8]] AS data FROM embeddings)"""

MARKERS = """mk AS (SELECT event_type AS category, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame,
  value AS x, CAST(props->>'k' AS DOUBLE) AS y, event_id AS number FROM events)"""

BOXES = """box AS (SELECT l_suppkey AS image_id, (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS id,
  CAST(l_partkey % 512 AS DOUBLE) AS x, l_extendedprice % 512 AS y, l_quantity + 8 AS width, l_quantity / 2 + 8 AS height,
  l_returnflag AS class_name, 1 - l_discount AS confidence FROM lineitem)"""
