"""Small text helpers that run inside Arrow batches, and the batch plumbing around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once inside a task, so that memory follows this and not the Arrow batch.
SLICE_BYTES = 2 << 20

_SPACED = bytes(
    (i + 32 if 65 <= i <= 90 else i) if i >= 128 or 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 else 32
    for i in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def space_words(text: str | None) -> list[bytes]:
    """Runs without space or \\t \\n \\v \\f \\r, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters above ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mixed(out + h[i:i + n])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about SLICE_BYTES of text."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size) + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
