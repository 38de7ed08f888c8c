"""Pixel sources: image files, NumPy arrays, image sequences, metadata text."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.operators.blocks import dense_index

PIXEL_DDL = "movie_id string, frame int, c int, y int, x int, value double, h int, w int"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG, JPEG or BMP files, one movie each. Channels come out as R, G, B(, A)."""
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")
    rows = img.select(F.col("origin").alias("movie_id"), F.col("height").alias("h"), F.col("width").alias("w"), n, F.explode(
        F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "data")
    # one row of bytes at a time keeps the exploded array short
    line = F.substring("data", F.col("y") * F.col("w") * n + 1, F.col("w") * n)
    rows = rows.select("movie_id", "h", "w", n, "y", F.hex(line).alias("_hex"))
    rows = rows.select("movie_id", "h", "w", n, "y", "_hex", F.explode(F.sequence(F.lit(0), F.col("w") * n - 1)).alias("k"))
    value = F.conv(F.substring("_hex", F.col("k") * 2 + 1, F.lit(2)), 16, 10).cast("double")
    # stored order is B, G, R(, A)
    at = F.col("k") % n
    c = F.when((n >= 3) & (at < 3), 2 - at).otherwise(at)
    return rows.select("movie_id", F.lit(0).alias("frame"), c.cast("int").alias("c"), "y", F.floor(F.col("k") / n).cast("int").alias("x"), value.alias("value"), "h", "w")


def axis_canonicalise(array: np.ndarray, axes: str) -> tuple[np.ndarray, bool]:
    """An array with axis letters (any of T, Z, C, Y, X) as (t, z, c, y, x), and
    whether its channel axis (at most four entries) makes it a colour image."""
    axes = axes.upper().replace("S", "C")
    order = [axes.index(a) for a in "TZCYX" if a in axes]
    moved = np.transpose(array, order)
    shape = iter(moved.shape)
    full = [next(shape) if a in axes else 1 for a in "TZCYX"]
    return moved.reshape(full), "C" in axes and 1 < full[2] <= 4


def _default_axes(a: np.ndarray) -> str:
    if a.ndim == 2:
        return "YX"
    if a.ndim == 3:
        return "TYX"
    if a.ndim == 4:
        return "TYXC" if a.shape[-1] <= 4 else "TZYX"
    return "TZCYX"


def read_npy(spark: SparkSession, path: str, axes: str | None = None) -> DataFrame:
    """.npy arrays as pixel rows (movie_id = path), frame by frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                full, _ = axis_canonicalise(array, axes or _default_axes(array))
                t, z, c, h, w = full.shape
                yy, xx = np.divmod(np.arange(h * w), w)
                for f in range(t):
                    for p in range(z):
                        for k in range(c):
                            yield pd.DataFrame({"movie_id": name, "frame": f, "z": p, "c": k, "y": yy, "x": xx,
                                                "value": full[f, p, k].ravel().astype(float), "h": h, "w": w})

    return files.mapInPandas(decode, "movie_id string, frame int, z int, c int, y int, x int, value double, h int, w int")


def read_image_sequence(spark: SparkSession, folder: str, extension: str = "png") -> DataFrame:
    """All images of a folder as one stack; frames follow the sorted file names."""
    rows = read_images(spark, f"{folder}/*.{extension}")
    files = rows.select("movie_id").distinct().withColumn("_g", F.lit(0))
    order = dense_index(files, ["_g"], ["movie_id"], F.lit(0), "_i", None)
    return (rows.drop("frame").join(order.select("movie_id", F.col("_i").cast("int").alias("frame")), "movie_id")
            .withColumn("movie_id", F.lit(folder)))


def parse_metadata(text: Column) -> Column:
    """Metadata map: a JSON object, else lines of key: value or key = value."""
    as_json = F.from_json(text, "map<string,string>")
    plain = F.transform(F.split(text, "\r?\n"), lambda line: F.split(line, "[:=]"))
    entries = F.transform(F.filter(plain, lambda p: F.trim(p[0]) != ""), lambda p: F.struct(
        F.trim(p[0]).alias("key"), F.trim(F.coalesce(F.get(p, 1), F.lit(""))).alias("value")))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
                       lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(text.rlike(r"^\s*\{"), as_json).otherwise(last)
