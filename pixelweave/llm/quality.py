"""Quality scores: hashed word n-gram logistic regression, learnt with FTRL-proximal updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.text import batch_of, mixed, slices
from pixelweave.session import cut_lineage

#: Weights of the model: fixed by this, not by the data (2 MB as doubles).
DIM = 1 << 18
#: Labelled ids to learn from at most (in expectation), and texts of each; more are thinned by hashes.
TRAIN_ROWS, TEXTS_PER_ID = 24_000, 4
#: Shards that learn side by side, and rounds in which they take up their common model.
SHARDS, ROUNDS = 6, 3
#: Fewer texts than this learn in one shard; fewer than UPDATES are gone through up to MOST_PASSES times a round.
ONE_SHARD, UPDATES, MOST_PASSES = 3_000, 6_000, 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the hashed words, runs of signs, and pairs of both; slot 0 is the constant.

    A token equal to one up to three places before also counts as that repeat,
    whatever the token. Values are counts divided by their Euclidean norm, so
    length itself is no feature.
    """
    tokens = [t.encode() for t in _TOKEN.findall(text or "")]
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    both = np.concatenate([mixed(h), mixed(h[:-1] * np.uint64(0x100000001B3) + h[1:] + np.uint64(1)),
                           *(np.full(int((h[:-d] == h[d:]).sum()), d, np.uint64) for d in (1, 2, 3))])
    slots, counts = np.unique((both % np.uint64(DIM - 1)).astype(np.int64) + 1, return_counts=True)
    norm = np.sqrt(float((counts * counts).sum())) or 1.0
    return np.append(slots, 0), np.append(counts / norm, 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of the sums of gradients z and of their squares n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _probability(score: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(score, -35, 35))))


def _learn(state, passes: int):
    schema = pa.schema([("slot", pa.int64()), ("z", pa.float64()), ("n", pa.float64())])

    def run(shard: pa.Table) -> pa.Table:
        z, n = (x.copy() for x in state.value) if state else (np.zeros(DIM), np.zeros(DIM))
        rows = sorted(zip(*(shard.column(c).to_pylist() for c in ("turn", "stamp", "text", "quality")), strict=True), key=lambda r: r[:2])
        known = [(*features(text), label) for _, _, text, label in rows] if passes > 1 else None
        for slots, x, label in known * passes if known else ((*features(text), label) for _, _, text, label in rows):
            w = _weights(z[slots], n[slots])
            g = (_probability(float(w @ x)) - label) * x
            grown = n[slots] + g * g
            z[slots] += g - (np.sqrt(grown) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] = grown
        used = np.flatnonzero(n)
        return pa.Table.from_arrays([pa.array(used), pa.array(z[used]), pa.array(n[used])], schema=schema)

    return run


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` (0/1) that may be learnt from: ids outside the held-out fold that have one label, however often."""
    marks = labels.select("doc_id", "quality").filter("quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    return (marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
                 .filter("quality = other").drop("other"))


def train(docs: DataFrame, marks: DataFrame, *, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """DIM weights learnt from ``docs`` (doc_id, text) and ``marks`` (doc_id, quality 0/1).

    About ``train_rows`` marks, chosen by a hash of the id, are broadcast (that
    bounds them). Equal texts of one id are one; of an id with more than
    TEXTS_PER_ID rows about so many different texts are taken, by a hash of the
    text, so one id on a third of the rows loads no task. The documents are dealt over
    SHARDS. Each round every shard runs FTRL over its documents from the common
    state; the states (sums per slot, at most DIM rows) are averaged. Few
    documents learn in one shard and in several passes, as many as bring the
    weights to rest. Without marks all weights are 0.
    """
    spark = docs.sparkSession
    total = marks.count()
    share = min(1.0, train_rows / total) if total else 0.0
    turn, whole = F.xxhash64(F.lit("turn"), "doc_id"), 1 << 30
    chosen = marks.filter(F.pmod(turn, F.lit(whole)) < int(share * whole))
    held = (docs.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("held")))
    stamp = F.xxhash64("text")
    rows = docs.join(F.broadcast(cut_lineage(held)), "doc_id").filter(
        (F.col("held") <= TEXTS_PER_ID) | (F.pmod(stamp, F.lit(whole)) * F.col("held") < TEXTS_PER_ID * whole))
    rows = cut_lineage(rows.groupBy("doc_id", stamp.alias("stamp")).agg(F.first("text").alias("text"), F.first("quality").cast("double").alias("quality"))
                           .select("text", "quality", turn.alias("turn"), "stamp", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard")))
    texts = rows.count()
    passes = max(1, min(MOST_PASSES, UPDATES // max(texts, 1)))
    if texts < ONE_SHARD:
        rows = rows.withColumn("shard", F.lit(0))
    shards = rows.select("shard").distinct().count()
    z, n, state = np.zeros(DIM), np.zeros(DIM), None
    for _ in range(ROUNDS if shards else 0):
        learnt = (rows.groupBy("shard").applyInArrow(_learn(state, passes), "slot long, z double, n double")
                      .groupBy("slot").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")))
        table = learnt.toArrow()  # DIM rows at most
        slots = table["slot"].to_numpy()
        z, n = np.zeros(DIM), np.zeros(DIM)
        z[slots], n[slots] = table["z"].to_numpy(), table["n"].to_numpy()
        state = spark.sparkContext.broadcast((z, n))
    return _weights(z, n)


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; a null or empty text has the constant's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != text_col]
    slim = docs.select(F.col(text_col).alias("text"), F.struct(*kept).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches, "text"):
            out = []
            for text in part.column(0).to_pylist():
                slots, x = features(text)
                out.append(_probability(float(w[slots] @ x)))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out, pa.float64())], names=["row", "score"])

    schema = slim.select("row").schema.add("score", "double")
    return slim.mapInArrow(run, schema).select("row.*", "score")


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that is never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, train_rows: int = TRAIN_ROWS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``.

    Labels (``doc_id, quality``) of the held-out fold, crc32(id as text) mod 5 =
    0, are never learnt from; the score sees the text alone. Null and empty
    texts get the score of the constant. Rows without an id are scored and are
    not held out; repeated rows are scored one by one; null labels and ids with
    both labels are ignored.
    Without labels every score is 0.5. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights = train(docs, known_labels(labels), train_rows=train_rows)
    return (score(docs, weights).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
