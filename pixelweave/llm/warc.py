"""WARC derivatives: each response becomes a metadata and a plain-text conversion record that refer to it.

A record here is its bytes: a version line, header lines, an empty line, the
block, two empty lines. Reading and writing are exact inverses for such records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.extract import page_lines
from pixelweave.llm.text import batch_of, slices

CRLF = b"\r\n"
VERSION = b"WARC/1.1"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based record id: the same record gets the same id in every run and every retried task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Serialise a record; Content-Length is written from the block."""
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in headers if k.lower() != "content-length"),
             b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def split_head(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines after the first line, and what follows the empty line; folded lines are joined."""
    head, _, rest = data.partition(CRLF + CRLF)
    headers = []
    for line in head.split(CRLF)[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + text.strip())
        elif ":" in text:
            k, _, v = text.partition(":")
            headers.append((k.strip(), v.strip()))
    return headers, rest


def from_bytes(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record; a block shorter than its stated length is what is there."""
    headers, rest = split_head(record)
    stated = next((v for k, v in headers if k.lower() == "content-length"), "")
    size = int(stated) if stated.isascii() and stated.isdigit() else max(0, len(rest) - 4)
    return headers, rest[:size]


def value(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def visible_text(page: bytes, content_type: str | None) -> str:
    """All lines of an HTML body outside scripts and styles; other text as it is."""
    charset = (content_type or "").lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        text = page.decode(charset, "replace")
    except LookupError:
        text = page.decode("utf-8", "replace")
    return "\n".join(t for _, t in page_lines(text)) if "html" in (content_type or "").lower() else text


def _responses(date: str):
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            out = []
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]) + CRLF + CRLF + body
                out.append(to_bytes([
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", digest(http))), ("WARC-Date", date),
                    *([("WARC-Target-URI", url)] if url and not set(url) & set("\r\n") else []),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(body))], http))
            yield batch_of(schema, [part.column(0), out])

    return run


def responses(pages: DataFrame, date: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, record``: a response record of every row of ``pages``, as fetched at ``date`` (a null page has an empty body)."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_responses(date), "page_id long, record binary")


_OUT = [("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
        ("block_digest", pa.string()), ("source_digest_ok", pa.bool_()), ("block", pa.binary()), ("record", pa.binary())]


def derivatives(response: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response record; other records have none."""
    headers, block = from_bytes(response or b"")
    if (value(headers, "WARC-Type") or "").lower() != "response":
        return []
    http, body = split_head(block)
    source, uri = value(headers, "WARC-Record-ID") or "", value(headers, "WARC-Target-URI")
    stated = {k: value(headers, f"WARC-{k}-Digest") for k in ("Block", "Payload")}
    found = {"Block": digest(block), "Payload": digest(body)}
    fits = all(stated[k] in (None, found[k]) for k in found)
    common = [("WARC-Refers-To", source), *([("WARC-Target-URI", uri)] if uri else []),
              *([("WARC-Date", value(headers, "WARC-Date"))] if value(headers, "WARC-Date") else []),
              ("WARC-Refers-To-Target-URI", uri or ""), ("WARC-Refers-To-Date", value(headers, "WARC-Date") or ""),
              ("WARC-Source-Payload-Digest", stated["Payload"] or found["Payload"])]
    text = visible_text(body, value(http, "Content-Type")).encode("utf-8", "surrogatepass")
    facts = {"source-headers": headers, "http-status": block.split(CRLF, 1)[0].decode("utf-8", "replace"), "http-headers": http,
             "payload-length": len(body), "block-digest": found["Block"], "payload-digest": found["Payload"], "digests-fit": fits}
    out = []
    for kind, mime, data in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False).encode("utf-8", "surrogatepass")),
                             ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, source, digest(data))
        record = to_bytes([("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("Content-Type", mime),
                           ("WARC-Block-Digest", digest(data))], data)
        out.append(dict(zip((n for n, _ in _OUT), (kind, own, source, uri, digest(data), fits, data, record), strict=True)))
    links = {r["type"]: r["record_id"] for r in out}
    for r, other in zip(out, ("conversion", "metadata"), strict=True):  # each names its companion
        head, block = from_bytes(r["record"])
        r["record"] = to_bytes([*head, ("WARC-Concurrent-To", links[other])], block)
    return out


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), *_OUT])
    for part in slices(batches, "record"):
        ids, rows = [], []
        for i, record in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            made = derivatives(record)
            ids += [i] * len(made)
            rows += made
        yield batch_of(schema, [ids, *([r[n] for r in rows] for n, _ in _OUT)])


def derive(records: DataFrame, *, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Metadata and conversion records of response records: ``page_id, type, record_id, refers_to, target_uri,
    block_digest, source_digest_ok, block, record``.

    The metadata block (JSON) holds the source's WARC and HTTP headers in their
    order and the digests found; the conversion block is the plain text. Both
    refer to the response's record id and to each other, and carry its URI, date
    and payload digest. source_digest_ok says whether the stated digests fit the
    bytes. Records of other types, null, empty or broken ones give no rows;
    repeated ones give equal rows each. One pass, no shuffle; ids are name-based,
    so a task that is run again writes the same records. Other columns are not read.
    """
    slim = records.select(F.col(id_col).cast("long").alias("page_id"), F.col(record_col).alias("record"))
    return slim.mapInArrow(_derived, "page_id long, type string, record_id string, refers_to string, target_uri string, "
                                     "block_digest string, source_digest_ok boolean, block binary, record binary")
