"""Result tables in the shape they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.session import spread


def trace_table(traces: DataFrame, roi_ids: list[str]) -> DataFrame:
    """A frame column plus one column per ROI."""
    keys = [k for k in ("movie_id", "frame") if k in traces.columns]
    return traces.groupBy(*keys).pivot("roi_id", roi_ids).agg(F.avg("value"))


def write_trace_table(traces: DataFrame, roi_ids: list[str], path: str) -> None:
    trace_table(traces, roi_ids).write.mode("overwrite").option("header", True).csv(path)


def count_table(markers: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Markers by (category, frame, number) with positions to two decimals.

    ``categories`` renames category ids; an unnamed one becomes cat_<id>.
    """
    name = F.col("category")
    if categories is not None:
        table = F.create_map(*[F.lit(v) for pair in categories.items() for v in pair])
        name = F.coalesce(F.try_element_at(table, F.col("category")), F.concat(F.lit("cat_"), F.col("category")))

    def two(c):
        return F.regexp_replace(F.format_number(c, 2), ",", "")

    return markers.orderBy("category", "frame", "number").select("number", name.alias("category"), two("x").alias("x"), two("y").alias("y"), "frame")


def write_rois(rois: DataFrame, path: str, name: str = "image_id") -> None:
    """ROI texts (name, text) to one folder <name>=<value> with one file for each value of ``name``, however the rows are dealt."""
    spread(rois, name).write.partitionBy(name).text(path)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """ROI text files to vertices (file, roi, kind, pos, x, y).

    A ROI is a line with its kind and a line per vertex, closed by a blank line.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    blocks = text.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n[ \t]*\n")).alias("roi", "block")).where(F.trim("block") != "")
    lines = blocks.select("file", "roi", F.split(F.trim("block"), "\n").alias("l"))
    points = lines.select("file", "roi", F.trim(F.col("l")[0]).alias("kind"), F.posexplode(F.slice("l", 2, F.size("l"))).alias("pos", "p"))
    xy = F.split(F.trim("p"), r"\s+")
    return points.select("file", "roi", "kind", "pos", xy[0].cast("double").cast("int").alias("x"),
                         xy[1].cast("double").cast("int").alias("y"))


def batch_summary(locs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per file: localizations, tracks, mean track length, linking efficiency, error.

    locs has file and track_id (-1 = unlinked); errors (file, error) lists failed files.
    """
    linked = F.col("track_id") >= 0
    lengths = locs.where(linked).groupBy("file", "track_id").agg(F.count(F.lit(1)).alias("_l"))
    tracks = lengths.groupBy("file").agg(F.count(F.lit(1)).alias("n_tracks"), F.avg("_l").alias("mean_track_length"), F.sum("_l").alias("_linked"))
    base = locs.groupBy("file").agg(F.count(F.lit(1)).alias("n_localizations")).join(tracks, "file", "left")
    out = base.select("file", "n_localizations", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), F.coalesce("mean_track_length", F.lit(0.0)).alias("mean_track_length"),
                      (F.coalesce("_linked", F.lit(0)) / F.col("n_localizations")).alias("linking_efficiency"), F.lit("").alias("error"))
    if errors is None:
        return out
    failed = errors.select("file", F.lit(0).cast("long").alias("n_localizations"), F.lit(0).cast("long").alias("n_tracks"), F.lit(0.0).alias("mean_track_length"), F.lit(0.0).alias("linking_efficiency"), "error")
    return out.unionByName(failed)


def write_batch_outputs(locs: DataFrame, features: DataFrame, folder: str, errors: DataFrame | None = None) -> None:
    """Localizations and features partitioned by file, and the summary table."""
    locs.write.mode("overwrite").partitionBy("file").parquet(f"{folder}/localizations")
    features.write.mode("overwrite").partitionBy("file").parquet(f"{folder}/features")
    batch_summary(locs, errors).write.mode("overwrite").option("header", True).csv(f"{folder}/batch_summary")
