"""Near-duplicate documents: MinHash signatures, banding, verification, components.

1. Each text becomes its set of word shingles and, from that, ``perms`` minima
   under multiply-add universal hash functions. Documents with equal sets fall
   together through a digest of the set; one of them goes on.
2. Bands of the signature form buckets. A bucket never yields all its pairs:
   every member is paired with the smallest member only.
3. Pairs pass the signature estimate, then the full sets decide.
4. Members of one bucket that are in different components after that could
   still be linked with each other. They are compared through their rarest
   shingles: sets of n and m shingles with similarity t share at least
   o = t / (1 + t) (n + m), so with both in one order, rarest first, some shared
   shingle has at most n - o others before it in one and m - o in the other.
   Shingles that many texts share sort last, so a common passage, or a text that
   many others come from, does not bring all its documents together.
5. Components by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.components import connected_components
from pixelweave.llm.text import batch_of, grams, hashes, slices, space_words
from pixelweave.session import cut_lineage

PERMS, BANDS, SEED = 128, 32, 20240601
#: Standard deviations of the estimate that a pair may lie below the threshold.
MARGIN = 6.5
#: Counters of the rarity table; its size does not depend on the data.
RARITY_SLOTS = 1 << 18

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, no words are none."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    return np.unique(grams(h, min(k, len(h))))


def signature(items: np.ndarray, perms: int) -> np.ndarray:
    """The minima of ``perms`` functions (a x + b) mod 2^64 div 2^32 over the items."""
    draw = np.random.default_rng(SEED)
    a = draw.integers(0, 1 << 64, perms, np.uint64) | np.uint64(1)
    b = draw.integers(0, 1 << 64, perms, np.uint64)
    x = ((items ^ (items >> np.uint64(32))) & np.uint64(0xFFFFFFFF))[:, None]
    low = np.full(perms, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i:i + 1024] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _document_sets(k: int, perms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, keys, sigs = [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, perms).tobytes() if len(s) else None)
            yield batch_of(_SETS, [part.column(0), n, keys, sigs])

    return run


def _band_rows(bands: int):
    schema = pa.schema([("band", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(s, np.uint32) for s in batch.column(1).to_pylist()])
            rows = sig.reshape(len(sig), bands, -1).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
            for i in range(rows.shape[2]):
                key = grams((key ^ rows[:, :, i]).ravel() + key.ravel() * np.uint64(31), 1).reshape(key.shape)
            yield batch_of(schema, [key.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), bands)])

    return run


def _estimated(floor: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= floor
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch_of(schema, [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]])

    return run


def _full_sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield batch_of(schema, [part.column(0), [shingles(t, k).tobytes() for t in part.column(1).to_pylist()]])

    return run


def _confirmed(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch_of(schema, [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]])

    return run


def _with_both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """``a, b`` with the column of both ends; b first, so that a hub's column travels last."""
    right = side.select(F.col("rep").alias("b"), F.col(column).alias("y"))
    left = side.select(F.col("rep").alias("a"), F.col(column).alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")


def _links(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, perms: int) -> DataFrame:
    """The pairs that the signatures leave and the full sets confirm."""
    t = percent / 100
    floor = t - MARGIN * (t * (1 - t) / perms) ** 0.5
    close = _with_both(pairs, reps, "signature").mapInArrow(_estimated(floor), "a long, b long")
    return cut_lineage(_with_both(close, sets, "items").mapInArrow(_confirmed(percent), "a long, b long"))


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(RARITY_SLOTS, np.int64)
    for batch in batches:
        for items in batch.column(0):
            count += np.bincount((np.frombuffer(items.as_buffer(), np.uint64) % np.uint64(RARITY_SLOTS)).astype(np.int64),
                                 minlength=RARITY_SLOTS)
    used = np.flatnonzero(count)
    yield batch_of(pa.schema([("slot", pa.int64()), ("n", pa.int64())]), [used, count[used]])


def _rarest(percent: int, rarity):
    schema = pa.schema([("shingle", pa.int64()), ("rep", pa.int64()), ("component", pa.int64()), ("size", pa.int64()),
                        ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, component, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(items, np.uint64)
                take = len(x) - -(-percent * len(x) // 100) + 1
                order = np.lexsort((x, rarity.value[(x % np.uint64(RARITY_SLOTS)).astype(np.int64)]))
                x = x[order[:take]]
                yield batch_of(schema, [x.view(np.int64), *([v] * len(x) for v in (rep, component, len(order))), range(len(x))])

    return run


def _rest_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components of ``rest`` (rep, component) that share one of their rarest shingles."""
    spark = rest.sparkSession
    held = cut_lineage(rest.join(sets, "rep").select("rep", "component", "items"))
    slots = held.select("items").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(RARITY_SLOTS, np.int64)
    for row in slots.collect():  # RARITY_SLOTS rows at most
        table[row.slot] = row.n
    rows = cut_lineage(held.mapInArrow(_rarest(percent, spark.sparkContext.broadcast(table)),
                                       "shingle long, rep long, component long, size long, rank long"))
    other = rows.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("rep", "component", "size", "rank")))
    shared = f"{percent} * (size + size_2)"  # (100 + percent) times the least intersection
    return (rows.join(other, "shingle")
                .filter("rep < rep_2 and component <> component_2")
                .filter(f"{100 + percent} * (size - rank) >= {shared} and {100 + percent} * (size_2 - rank_2) >= {shared}")
                .select(F.col("rep").alias("a"), F.col("rep_2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, perms: int = PERMS, bands: int = BANDS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    sets of ``shingle``-word shingles; the component is the smallest id reachable
    over links, and kept marks it. A link of similarity t is proposed by the
    bands with probability 1 - (1 - t^(perms / bands))^bands, above 1 - 1e-7 at
    0.8 and above 1 - 1e-10 at 0.85, and always confirmed on the full sets.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows of one id are one node, which is linked if any of them is. A
    row without id is linked with nothing and kept. Other columns of ``docs``
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(docs.mapInArrow(_document_sets(shingle, perms),
                                       "doc_id long, n_shingles long, set_key binary, signature binary"))
    known = rows.filter("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    copies = (known.select("doc_id", "set_key").join(reps.select("set_key", "rep"), "set_key")
                   .filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())

    banded = reps.select("rep", "signature").mapInArrow(_band_rows(bands), "band long, rep long")
    buckets = (banded.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"))
                     .filter("centre < last").select("band", "centre"))
    members = cut_lineage(banded.join(buckets, "band").filter("rep <> centre"))
    needed = members.select("rep").union(members.select("centre")).distinct()
    sets = cut_lineage(docs.join(needed, docs.doc_id == needed.rep).select("rep", "text")
                           .mapInArrow(_full_sets(shingle), "rep long, items binary"))
    pairs = members.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = _links(pairs, reps, sets, percent, perms)

    found = cut_lineage(connected_components(links))
    placed = (members.join(found, members.rep == found.node, "left")
                     .select("band", "rep", F.coalesce("component", "rep").alias("component")))
    split = (placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .filter("low < high").select("band"))
    rest = cut_lineage(placed.join(split, "band").select("rep", "component").distinct())
    more = None if rest.isEmpty() else _links(_rest_pairs(rest, sets, percent), reps, sets, percent, perms)

    # the components found so far are stars already; only what is new can join them
    stars = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected_components(stars.unionByName(copies) if more is None else stars.unionByName(copies).unionByName(more))
    return (rows.select("doc_id", "n_shingles").join(final, rows.doc_id == final.node, "left")
                .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
                .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
