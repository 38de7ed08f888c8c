"""Benchmark decontamination by winnowing: fingerprints, a join, and extension of the hits.

A text's fingerprints are the least K-gram hashes of every W consecutive
K-grams. Two texts that share K + W - 1 words share the fingerprint of that
span at the same place in it, so with K = 5 and W = 6 no shared window of ten
words is missed. Hits are extended word by word on both sides and count where
they reach ten words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.text import alnum_words, batch_of, grams, hashes, mixed, slices
from pixelweave.session import cut_lineage

K = 5
#: Bits of the filter that keeps fingerprints no item has out of the join; its size does not follow the data.
FILTER_BITS = 1 << 24


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least of every ``w`` consecutive values, the last of equal ones."""
    if len(g) < w:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(windows)) + w - 1 - windows[:, ::-1].argmin(axis=1))


def _around(h: np.ndarray, at: np.ndarray, side: int, pad: int) -> np.ndarray:
    """The word hashes from ``side`` before to ``side`` after the K-grams at ``at``; ``pad`` beyond the text."""
    h = np.concatenate([np.full(side, pad, np.uint64), h, np.full(side, pad, np.uint64)])
    return h[at[:, None] + np.arange(2 * side + K)]


_PRINT = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("around", pa.list_(pa.int64()))])


def _item_prints(window: int):
    schema = pa.schema([("item_id", pa.int64()), ("prints", pa.list_(_PRINT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for text in part.column(1).to_pylist():
                h = hashes(alnum_words(text))
                rows = []
                if 0 < len(h) < window:
                    rows = [(int(grams(h, len(h)).view(np.int64)[0]), 0, len(h), None)]
                elif len(h):
                    g = grams(h, K)
                    at = winnow(g, window - K + 1)
                    rows = list(zip(g[at].view(np.int64).tolist(), at.tolist(), [0] * len(at),
                                    _around(h, at, window - K, 1).view(np.int64).tolist(), strict=True))
                out.append([dict(zip(("h", "at", "length", "around"), r, strict=True)) for r in rows])
            yield batch_of(schema, [part.column(0), out])

    return run


def _filter_slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _document_prints(window: int, shorts: list[int], known):
    schema = pa.schema([("row", pa.struct([("id", pa.int64()), ("stamp", pa.int64())])), ("n_words", pa.int64()),
                        ("prints", pa.list_(_PRINT))])

    def seen(h):
        a, b = _filter_slots(h)
        return known.value[a] & known.value[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = [alnum_words(t) for t in part.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words])
            # one run of words for all texts of the slice; a hash that no word has stands between texts
            starts = np.concatenate([[0], np.cumsum(sizes + 1)])
            h = np.empty(starts[-1], np.uint64)
            for i, w in enumerate(words):
                h[starts[i]:starts[i] + sizes[i]] = hashes(w)
                h[starts[i] + sizes[i]] = mixed(np.array([i + 2], np.uint64))[0]
            found = [[] for _ in words]

            def add(at, g, length, around):
                for doc, q, x, c in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(),
                                        g[at].view(np.int64).tolist(), around, strict=True):
                    if q + (length or K) <= starts[doc] + sizes[doc]:
                        found[doc].append({"h": x, "at": q - int(starts[doc]), "length": length, "around": c})

            g = grams(h, K)
            at = winnow(g, window - K + 1)
            at = at[seen(g[at])] if len(at) else at
            add(at, g, 0, _around(h, at, window - K, 0).view(np.int64).tolist())
            for m in shorts:
                g = grams(h, m)
                at = np.flatnonzero(seen(g))
                add(at, g, m, [None] * len(at))
            yield batch_of(schema, [part.column(0), sizes, found])

    return run


def _extended(window: int):
    """Spans of document words that the aligned surroundings of a shared fingerprint confirm."""
    side = window - K
    schema = pa.schema([("row", pa.struct([("id", pa.int64()), ("stamp", pa.int64())])), ("item_id", pa.int64()),
                        ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item, at, length, mine, theirs = batch.columns
            at, length = at.to_numpy(), length.to_numpy()
            start, stop = at.copy(), at + length
            long = np.flatnonzero(length == 0)
            if len(long):
                same = np.array(mine.take(pa.array(long)).to_pylist()) == np.array(theirs.take(pa.array(long)).to_pylist())
                whole = same[:, side:side + K].all(axis=1)
                start[long] = at[long] - np.cumprod(same[:, side - 1::-1] if side else same[:, :0], axis=1).sum(axis=1)
                stop[long] = at[long] + K + np.cumprod(same[:, side + K:], axis=1).sum(axis=1)
                stop[long[~whole]] = start[long[~whole]]
            keep = pa.array((stop - start >= np.where(length, length, window)) & (stop > start))
            yield batch_of(schema, [c.filter(keep) for c in (row, item, pa.array(start), pa.array(stop))])

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Documents ``row (id, stamp), n_words`` and spans ``row, item_id, start, stop`` (words) that items share.

    ``docs`` has ``row, text`` and ``benchmark`` item_id, text. Fingerprints of
    documents pass a filter of fixed size first, so only those an item may have
    are shuffled; a frequent passage is a hot join key on the document side
    alone, which adaptive execution splits.
    """
    spark = docs.sparkSession
    items = cut_lineage(benchmark.select(F.col("item_id").cast("long"), "text")
                        .mapInArrow(_item_prints(window), "item_id long, prints array<struct<h:long,at:int,length:int,around:array<long>>>")
                        .select("item_id", F.inline("prints")))
    shorts = [r.length for r in items.filter("length > 0").select("length").distinct().collect()]  # lengths below window
    slots = items.select(F.explode(F.array(
        F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(FILTER_BITS - 1))).alias("slot"))
    known = np.zeros(FILTER_BITS, bool)
    table = slots.distinct().toArrow()["slot"].to_numpy()  # FILTER_BITS rows at most
    known[table] = True
    rows = cut_lineage(docs.mapInArrow(
        _document_prints(window, sorted(shorts), spark.sparkContext.broadcast(known)),
        "row struct<id:long,stamp:long>, n_words long, prints array<struct<h:long,at:int,length:int,around:array<long>>>"))
    mine = rows.select("row", F.inline("prints"))
    theirs = items.select("item_id", "h", "length", F.col("around").alias("theirs")).distinct()
    spans = (mine.join(theirs, ["h", "length"])
                 .select("row", "item_id", "at", "length", "around", "theirs")
                 .mapInArrow(_extended(window), "row struct<id:long,stamp:long>, item_id long, start int, stop int"))
    return rows.select("row", "n_words"), cut_lineage(spans.distinct())


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_stamp``: one row per row of ``docs``.

    A window is ``window`` consecutive words of an item (``item_id, text``); an
    item of fewer words, but not none, is one window. Words of a document inside
    any occurrence of a window are hit. items_sha256 digests the ids of the
    items with occurring windows, sorted as text and joined by commas. text_stamp
    is xxhash64 of the text, which with the id names the row.

    Null and empty texts have no words, as items and as documents. Items without
    an id are ignored. Rows of one id and text get the same result each; rows of
    one id with other texts are separate. Other columns are not read.
    """
    if window < K:
        raise ValueError(f"windows have {K} words at least")
    text = F.col(text_col)
    docs = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("stamp")).alias("row"), text.alias("text"))
    rows, spans = contaminated_spans(docs, benchmark.filter("item_id is not null"), window)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hit = (spans.select("row", "start", "stop").distinct().withColumn("fresh", fresh)
                .groupBy("row").agg(F.sum("fresh").alias("n_hit")))
    listed = (spans.select("row", "item_id").distinct().groupBy("row")
                   .agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    found = hit.join(listed, "row").select(F.col("row").alias("_row"), "n_hit", "items")
    return (rows.join(found, F.col("row").eqNullSafe(F.col("_row")), "left")
                .select(F.col("row.id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        F.col("n_hit").isNotNull().alias("contaminated"), F.col("row.stamp").alias("text_stamp")))
