"""From raw documents to a training mixture: five stages, each on all rows that the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the documents that go on, with the columns of ``docs`` (the last
one returns the mixture). Every stage takes nulls in any column, empty texts,
repeated rows, an empty table and further columns; what becomes of them is
stated at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, linededup, minhash, mixing, quality, queries
from pixelweave.session import cut_lineage, ensure_checkpoint_dir

#: No SQL: the classifier is learnt and near duplicates need connected components.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more).

    Null and empty texts have the constant's score; rows without an id are scored like all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs.select("doc_id", "text"), quality.known_labels(labels))
    rows = quality.score(docs.select("text", F.struct(*docs.columns).alias("doc")), weights)
    return rows.filter("score >= 0.3").select("doc.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, and pieces of long lines, that occurred before; one whose every line did goes.

    n_chars follows a text that changed. Texts without lines, null and empty ones stay as they are.
    """
    rows = linededup.dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")), pieces=True)
    rows = rows.filter("n_lines = 0 or n_removed < n_lines")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("text").eqNullSafe(F.col("doc.text")), F.col("doc.n_chars")).otherwise(F.length("text").cast(kind))
    return rows.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    Rows of one id and text are one document. Different texts under one id are
    documents of their own, compared like all: the least text (a null last) has
    the id's place in the order, the others come after all ids, so they go only
    if they are near duplicates. Texts without words and rows without an id are
    near no other and stay.
    """
    rows = docs.select(F.col("doc_id").alias("node"), "text", F.struct(*docs.columns).alias("doc"))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("node"))
    if not repeated.isEmpty():
        single, several = rows.join(repeated, "node", "left_anti"), rows.join(repeated, "node", "left_semi")
        texts = several.groupBy("node", F.xxhash64("text").alias("stamp")).agg(F.first("text").alias("text"), F.min("doc").alias("doc"))
        least = several.groupBy("node").agg(F.xxhash64(F.min("text")).alias("least"))
        later = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("node", "stamp"), 2)
        texts = texts.join(least, "node").select(F.when(F.col("stamp") == F.col("least"), F.col("node")).otherwise(later).alias("node"), "text", "doc")
        rows = cut_lineage(single.unionByName(texts))
    found = minhash.near_duplicates(rows, shingle=5, percent=80, id_col="node")
    gone = found.filter("not kept").select(F.col("doc_id").alias("node")).distinct()
    return rows.join(gone, "node", "left_anti").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item. Texts without words and rows without an id are judged like all."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    bad = found.filter("contaminated").select(F.struct("doc_id", "text_stamp").alias("bad")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.struct("doc_id", F.xxhash64("text")).alias("key"))
    return rows.join(bad, F.col("key").eqNullSafe(F.col("bad")), "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, copies``: what of each document the mixture takes.

    The mixture is as large as the corpus, up to three epochs of a source. Texts without words are in no mixture.
    """
    return mixing.mix(queries.with_domain(docs), queries.MIX_LEVELS, weights=queries.MIX_WEIGHTS, budget_percent=100, epochs=3, seed=8)


STAGES = [
    ("quality", keep_quality),
    ("lines", cut_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
