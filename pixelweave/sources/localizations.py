"""Localization and track files: readers to the locs schema, and writers.

Parsing is separate from reading: every ``from_*`` maps a raw frame to the
schema and every ``to_*`` back, as plain projections.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.operators.blocks import union_all

# Header aliases of localization tables, lower case.
ALIASES = {
    "track_id": ("track_id", "track_number", "trackid", "particle"),
    "x": ("x",), "y": ("y",), "frame": ("frame",), "id": ("id",),
    "intensity": ("intensity", "intensities"),
    "sigma_x": ("sigma", "sigma_x", "sigma1"), "sigma_y": ("sigma_y", "sigma2"),
    "background": ("background", "offset", "bkgstd"), "uncertainty": ("uncertainty", "precision"),
}
#: Columns read as whole numbers and as text; all others are doubles.
WHOLE = {"id", "frame", "track_id", "track_number", "trackid", "particle"}
TEXT = {"file", "movie_id", "source", "category", "class", "class_name", "type", "name", "label", "error"}
DEFAULT_PIXEL = 108.0


def _pick(df: DataFrame, *names: str) -> Column | None:
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return None


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose types follow from its header line; text where a number belongs is an error."""
    raw = spark.read.option("header", True).csv(path)

    def typed(name: str) -> Column:
        c, plain = F.trim(F.col(f"`{name}`")), name.strip().lower()
        if plain in TEXT:
            return c.alias(name)
        whole = F.coalesce(c.try_cast("long"), c.cast("double").cast("long"))
        return (whole if plain in WHOLE else c.cast("double")).alias(name)

    return raw.select(*map(typed, raw.columns))


# -- parsing ----------------------------------------------------------------

def from_thunderstorm(df: DataFrame, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    """Nanometres to pixels, 1-based to 0-based frames, missing intensity 0."""
    light = _pick(df, "intensity [photon]", "intensity")
    extra = [F.col(f"`{c}`").alias(c.replace(" [nm]", "_nm")) for c in ("sigma [nm]", "uncertainty [nm]", "chi2") if c in df.columns]
    ident = [F.col("id").cast("long").alias("detection_id")] if "id" in df.columns else []
    return df.select((F.col("frame").cast("long") - 1).alias("frame"), (F.col("`x [nm]`") / pixel_size).alias("x"), (F.col("`y [nm]`") / pixel_size).alias("y"),
                     F.coalesce(light.cast("double") if light is not None else F.lit(0.0), F.lit(0.0)).alias("intensity"), *extra, *ident)


def from_thunderstorm_full(df: DataFrame, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    """The same with sigma, uncertainty and background in the particle schema."""
    def nm(*names):
        c = _pick(df, *names)
        return None if c is None else c / pixel_size

    sigma_x, sigma_y = nm("sigma1 [nm]", "sigma [nm]"), nm("sigma2 [nm]", "sigma [nm]")
    null = F.lit(None).cast("double")
    light = _pick(df, "intensity [photon]", "intensity")
    ident = F.col("id").cast("long") if "id" in df.columns else F.monotonically_increasing_id()
    x = nm("x [nm]") if "x [nm]" in df.columns else F.col("x")
    y = nm("y [nm]") if "y [nm]" in df.columns else F.col("y")
    return df.select(ident.alias("id"), (F.col("frame").cast("long") - 1).alias("frame"), x.alias("x"), y.alias("y"),
                     (light.cast("double") if light is not None else F.lit(0.0)).alias("intensity"),
                     *[(c if c is not None else null).alias(n) for n, c in (
                         ("sigma_x", sigma_x), ("sigma_y", sigma_y), ("background", _pick(df, "offset [photon]", "bkgstd [photon]")),
                         ("uncertainty", nm("uncertainty [nm]")))],
                     F.lit(-1).cast("long").alias("track_id"))


def from_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rename columns whose stripped lower-case name is a known alias."""
    lookup = {a: target for target, names in (aliases or ALIASES).items() for a in names}
    taken, cols = set(), []
    for c in df.columns:
        target = lookup.get(c.strip().lower(), c)
        target = c if target in taken else target
        taken.add(target)
        cols.append(F.col(f"`{c}`").alias(target))
    return df.select(*cols)


def from_native(df: DataFrame) -> DataFrame:
    """Case-insensitive track_id, x, y, frame, intensity; intensity defaults to 0."""
    out = from_aliases(df, {"track_id": ("track_number", "track_id", "trackid"), "x": ("x",), "y": ("y",), "frame": ("frame",), "intensity": ("intensity",)})
    if "frame" in out.columns:
        out = out.withColumn("frame", F.col("frame").cast("long"))
    return out if "intensity" in out.columns else out.withColumn("intensity", F.lit(0.0))


def from_spt_csv(df: DataFrame) -> DataFrame:
    """The wider alias map; null frame 0, null track -1, rows with a null id dropped.

    A generated id is unique and follows the file order, not dense.
    """
    if any("[nm]" in c for c in df.columns):
        return from_thunderstorm_full(df)
    out = from_aliases(df)
    if "x" not in out.columns or "y" not in out.columns:
        raise ValueError("no x and y columns")
    if "frame" not in out.columns:
        if "id" not in out.columns:
            raise ValueError("no frame column")
        out = out.withColumn("frame", F.lit(0))
    out = out.withColumn("frame", F.coalesce(F.col("frame").cast("long"), F.lit(0)))
    if "intensity" not in out.columns:
        out = out.withColumn("intensity", F.lit(0.0))
    out = out.withColumn("id", F.col("id").cast("long") if "id" in out.columns else F.monotonically_increasing_id())
    track = F.coalesce(F.col("track_id").cast("long"), F.lit(-1)) if "track_id" in out.columns else F.lit(-1)
    return out.dropna(subset=["id"]).withColumn("track_id", track.cast("long"))


JSON_POINT = "struct<frame:bigint,x:double,y:double,intensity:double>"
JSON_SCHEMA = (f"tracks array<struct<track_id:bigint,id:bigint,points:array<{JSON_POINT}>>>, "
               f"localizations array<{JSON_POINT}>")


def from_json_documents(df: DataFrame) -> DataFrame:
    """Documents with tracks (points inside) or flat localizations to rows."""
    p = F.col("p")
    body = [p.frame.alias("frame"), p.x.alias("x"), p.y.alias("y"), F.coalesce(p.intensity, F.lit(0.0)).alias("intensity")]
    tracks = (df.where("tracks is not null").select(F.explode("tracks").alias("t"))
              .select(F.coalesce("t.track_id", "t.id", F.lit(0)).alias("track_id"), F.explode("t.points").alias("p")).select(*body, "track_id"))
    flat = df.where("tracks is null").select(F.explode("localizations").alias("p")).select(*body, F.lit(-1).cast("long").alias("track_id"))
    return tracks.unionByName(flat)


# -- readers ----------------------------------------------------------------

def read_thunderstorm(spark: SparkSession, path: str, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    return from_thunderstorm(_csv(spark, path), pixel_size)


def read_thunderstorm_full(spark: SparkSession, path: str) -> DataFrame:
    return from_thunderstorm_full(_csv(spark, path))


def read_locs_csv(spark: SparkSession, path: str) -> DataFrame:
    return from_native(_csv(spark, path))


def read_spt_csv(spark: SparkSession, path: str) -> DataFrame:
    return from_spt_csv(_csv(spark, path))


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files that hold a document per line (as written here), and files that are one document."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")
    whole = F.startswith("line", F.lit("{")) & F.get_json_object("line", "$").isNotNull()
    files = lines.groupBy("file").agg(F.bool_and(whole).alias("by_line")).collect()  # a row per file
    return [r.file for r in files if r.by_line], [r.file for r in files if not r.by_line]


def read_locs_json(spark: SparkSession, path: str) -> DataFrame:
    """Localizations of JSON files of either form, also of both in one folder."""
    by_line, single = _json_files(spark, path)
    reader = spark.read.schema(JSON_SCHEMA)
    docs = [reader.option("multiLine", multi).json(files) for multi, files in ((False, by_line), (True, single)) if files]
    return from_json_documents(union_all(docs) if docs else spark.createDataFrame([], JSON_SCHEMA))


def read_spt_json(spark: SparkSession, path: str) -> DataFrame:
    """txy_pts with index-list tracks (tracks of one point stay unlinked), else as read_locs_json.

    Point and track numbers count from 0 in each file, which ``file`` names.
    """
    raw = spark.read.schema("txy_pts array<array<double>>, tracks array<array<bigint>>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    indexed = raw.where("txy_pts is not null").select(F.input_file_name().alias("file"), "txy_pts", "tracks")
    if indexed.isEmpty():
        return read_locs_json(spark, path).withColumn("id", F.monotonically_increasing_id())
    points = indexed.select("file", F.posexplode("txy_pts").alias("id", "p")).select(
        "file", F.col("id").cast("long").alias("id"), F.col("p")[0].cast("long").alias("frame"), F.col("p")[1].alias("x"), F.col("p")[2].alias("y"), F.lit(0.0).alias("intensity"))
    members = indexed.select("file", F.posexplode("tracks").alias("track_id", "m")).where(F.size("m") > 1).select(
        "file", F.col("track_id").cast("long").alias("track_id"), F.explode("m").alias("id"))
    owner = members.groupBy("file", "id").agg(F.max("track_id").alias("track_id"))
    return points.join(owner, ["file", "id"], "left").withColumn("track_id", F.coalesce("track_id", F.lit(-1).cast("long")))


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """Headerless numeric text as an array per non-empty line; '#' starts a comment."""
    text = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value")).where("value <> ''")
    return text.select(F.transform(F.split("value", r"\s+"), lambda v: v.cast("double")).alias("n"))


def read_spt_txt(spark: SparkSession, path: str) -> DataFrame:
    """frame, x, y[, intensity[, track_id]] separated by blanks."""
    n = F.col("n")
    return _numbers(spark, path).where(F.size(n) >= 3).select(
        F.monotonically_increasing_id().alias("id"), n[0].cast("long").alias("frame"), n[1].alias("x"), n[2].alias("y"),
        F.coalesce(F.get(n, 3), F.lit(0.0)).alias("intensity"), F.coalesce(F.get(n, 4).cast("long"), F.lit(-1)).cast("long").alias("track_id"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """t, x, y per line, or x, y with t = 0."""
    n = F.col("n")
    three = F.size(n) >= 3
    return _numbers(spark, path).select(F.when(three, n[0]).otherwise(0.0).cast("long").alias("t"),
                                        F.when(three, F.get(n, 1)).otherwise(n[0]).alias("x"), F.when(three, F.get(n, 2)).otherwise(F.get(n, 1)).alias("y"))


def write_points(df: DataFrame, path: str) -> None:
    df.select("t", "x", "y").write.mode("overwrite").option("sep", " ").csv(path)


def read_localizations(spark: SparkSession, path: str, format: str | None = None, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    """Dispatch on an explicit format, the .json suffix, or the header."""
    if pixel_size <= 0:
        raise ValueError("pixel_size must be positive")
    if format is None:
        if path.lower().rstrip("/").endswith(".json"):
            format = "json"
        else:
            header = spark.read.option("header", True).csv(path).columns
            low = {c.strip().lower() for c in header}
            if {"x [nm]", "y [nm]"} <= low:
                format = "thunderstorm"
            elif {"x", "y"} <= low and ("frame" in low or "id" in low):
                format = "native"
            else:
                raise ValueError(f"unknown localization format: {sorted(low)}")
    readers = {"json": lambda: read_locs_json(spark, path), "thunderstorm": lambda: read_thunderstorm(spark, path, pixel_size), "native": lambda: read_locs_csv(spark, path)}
    if format not in readers:
        raise ValueError(f"unknown localization format: {format}")
    return readers[format]()


def read_tracks(spark: SparkSession, path: str, format: str | None = None, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    df = read_localizations(spark, path, format, pixel_size)
    if "track_id" not in df.columns:
        warnings.warn("no track_id column in the file", stacklevel=2)
    return df


# -- writers ----------------------------------------------------------------

def to_thunderstorm(df: DataFrame, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    light = F.col("intensity") if "intensity" in df.columns else F.lit(0.0)
    return df.select((F.col("frame").cast("long") + 1).alias("frame"), (F.col("x") * pixel_size).alias("x [nm]"),
                     (F.col("y") * pixel_size).alias("y [nm]"), light.alias("intensity [photon]"))


def to_particle_csv(df: DataFrame, pixel_size: float = DEFAULT_PIXEL) -> DataFrame:
    """1-based id and frame, nanometre coordinates, optional fit columns."""
    optional = [(F.col(s) * pixel_size).alias(t) for s, t in (("sigma_x", "sigma [nm]"), ("uncertainty", "uncertainty [nm]")) if s in df.columns]
    offset = [F.col("background").alias("offset [photon]")] if "background" in df.columns else []
    return df.select((F.col("id") + 1).alias("id"), (F.col("frame").cast("long") + 1).alias("frame"), (F.col("x") * pixel_size).alias("x [nm]"),
                     (F.col("y") * pixel_size).alias("y [nm]"), F.col("intensity").alias("intensity [photon]"), *optional, *offset)


def track_documents(df: DataFrame) -> DataFrame:
    """One JSON document per track with its points in frame order; a track is as long as its document."""
    point = F.struct("frame", "x", "y", "intensity")
    return df.groupBy("track_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def write_thunderstorm(df: DataFrame, path: str, pixel_size: float = DEFAULT_PIXEL) -> None:
    to_thunderstorm(df, pixel_size).write.mode("overwrite").option("header", True).csv(path)


def write_locs_json(df: DataFrame, path: str) -> None:
    """Documents that read_locs_json accepts: {"tracks": [...]} or {"localizations": [...]}."""
    if "track_id" in df.columns:
        docs = track_documents(df).select(F.array(F.struct("track_id", "points")).alias("tracks"))
    else:
        docs = df.select(F.array(F.struct("frame", "x", "y", "intensity")).alias("localizations"))
    docs.write.mode("overwrite").json(path)


def write_localizations(df: DataFrame, path: str, format: str = "native", pixel_size: float = DEFAULT_PIXEL) -> None:
    missing = {"frame", "x", "y"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if pixel_size <= 0:
        raise ValueError("pixel_size must be positive")
    if format == "thunderstorm":
        write_thunderstorm(df, path, pixel_size)
    elif format == "json":
        write_locs_json(df, path)
    elif format == "native":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown localization format: {format}")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)
