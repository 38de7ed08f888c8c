"""Session defaults and the two pieces of plan control every operator shares:
cutting lineage for iterative work, and joining small keyed tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size of a keyed side table that is broadcast, as rows and as bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def local_session(cores: str = "8", partitions: int = 8, app: str = "pixelweave") -> SparkSession:
    """A local session for tests and bench.py; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` wins. Only a local master without
    the setting gets a temporary folder; a cluster without it is an error,
    since a machine-local folder would not survive losing an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: numbers count 8, text and arrays what they hold."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return 16 + F.coalesce(F.octet_length(c), F.lit(0))
        if kind.startswith(("array", "map")):
            return 24 + 16 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        return F.lit(8 if not kind.startswith("struct") else 16 * (1 + kind.count(":")))

    return sum((one(*c) for c in df.dtypes), F.lit(16)).cast("long")


def attach(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join an aggregate keyed by ``keys`` back onto its rows.

    The aggregate is materialised once and measured. Up to ``max_rows`` and
    BROADCAST_BYTES it is broadcast, so the large side is not shuffled; beyond
    that the join is left to Spark, where adaptive execution splits skewed keys. With no keys the
    side is a one-row aggregate and is broadcast as it is.
    """
    if not keys:
        return (df.withColumn("_one", F.lit(1))
                  .join(F.broadcast(side.withColumn("_one", F.lit(1))), "_one", how).drop("_one"))
    side = cut_lineage(side)
    rows, held = side.agg(F.count(F.lit(1)), F.sum(_bytes(side))).first()
    if rows <= max_rows and (held or 0) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return df.join(side, keys, how)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash rows over the configured number of shuffle partitions.

    The fixed number keeps adaptive execution from folding compute-heavy work
    (pair unrolling, long window lists, Python groups) into a few tasks just
    because its input is small in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
