"""Main text of HTML pages: markup settles what it can, nearest-URL page differencing the rest.

Lines come from block elements. Elements of navigation, forms, adverts, notices,
comments and the like are dropped, lines in an article stay. Where a page marks
no article, its other lines are compared with those of the page of the same
host whose URL path is nearest: lines that the two have in common, aligned by
longest common subsequence, are the site's own and go.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.text import batch_of, hashes, slices
from pixelweave.llm.urltrees import split_url
from pixelweave.session import cut_lineage

MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)""", re.S)
HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
UNREAD = {"script", "style", "title", "noscript", "template", "textarea", "svg", "iframe", "object"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that close by themselves, so their end tags say nothing about what holds them.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "html", "body"}
ARTICLE = {"article", "main"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                "consent", "cookie", "cookies", "disqus", "footer", "form", "header", "masthead", "menu", "modal", "nav", "navbar",
                "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted", "related", "replies",
                "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
                "widget", "contentinfo", "complementary", "alert", "dialog"}


#: First parts of a class name that speak of a piece without being it, as in with-sidebar.
ABOUT = {"no", "not", "with", "without", "has", "have", "hide", "hides", "is", "show", "shows"}


def is_hint(value: str) -> bool:
    """Whether a class, id or role names a piece of the site: a whole name, or one whose first or last part (at - or _) is such a name."""
    for name in value.lower().split():
        parts = re.split(r"[-_]+", name)
        if name in CHROME_WORDS or parts[0] not in ABOUT and (parts[0] in CHROME_WORDS or parts[-1] in CHROME_WORDS):
            return True
    return False


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """Zone and text of the lines of a page: 0 dropped by markup, 1 in an article, 2 neither, 3 in an article inside an element with a hint."""
    page = page or ""
    lines, text, open_ = [], [], []

    def zone():
        kinds = [k for _, k in open_]
        if 0 in kinds:
            return 0
        last = max((i for i, k in enumerate(kinds) if k == 1), default=-1)
        if "hint" in kinds[last + 1:]:
            return 0
        return 2 if last < 0 else 3 if "hint" in kinds[:last] else 1

    def flush():
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((zone(), line))

    at = 0
    while m := MARKUP.search(page, at):
        text.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in INLINE:
            continue
        flush()
        if m[1]:
            if name not in LOOSE and any(n == name for n, _ in open_):
                while open_.pop()[0] != name:
                    pass
        elif name in UNREAD:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name not in EMPTY and name not in LOOSE and not m[3].endswith("/"):
            values = ["".join(h) for h in HINTS.findall(m[3])] if m[3] else []
            main = name in ARTICLE or "role" in m[3] and any("main" in v.lower().split() for v in values)
            open_.append((name, 0 if name in CHROME else 1 if main else "hint" if any(map(is_hint, values)) else None))
    text.append(page[at:])
    flush()
    return lines


def common(a: list, b: list) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``, in bit-parallel rows."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    places = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full, row, rows = (1 << len(y)) - 1, 0, []
    for v in x:  # bit j of a row: the subsequence grows with y[j]; of each block of ``seen`` up to an old bit, the lowest stays
        seen = row | places.get(v, 0)
        row = seen & (seen - (row << 1 | 1) ^ seen) & full
        rows.append(row)
    middle, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        now = (rows[i] & ((1 << j) - 1)).bit_count()
        before = (rows[i - 1] & ((1 << j) - 1)).bit_count() if i else 0
        if now > before:
            middle.append(i + head)
            while (rows[i] & ((1 << j) - 1)).bit_count() == now:
                j -= 1
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


_ROW = pa.struct([("id", pa.int64()), ("stamp", pa.int64())])


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", _ROW), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.int64()))])
    for part in slices(batches, "html"):
        out = [hashes([t.encode("utf-8", "surrogatepass") for _, t in page_lines(h)]).view(np.int64) for h in part.column(3).to_pylist()]
        yield batch_of(schema, [*part.columns[:3], out])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", _ROW), ("shared", pa.list_(pa.int32()))])
    for batch in batches:
        yield batch_of(schema, [batch.column(0), [common(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                                                               strict=True)]])


def _candidate_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines markup leaves: an article's, else those of an article inside a hint, else those in no zone with their places on the page."""
    schema = pa.schema([("row", _ROW), ("url", pa.string()), ("text", pa.string()), ("places", pa.list_(pa.int32()))])
    for part in slices(batches, "html"):
        texts, places = [], []
        for page in part.column(2).to_pylist():
            lines = page_lines(page)
            zones = {z for z, _ in lines}
            taken = 1 if 1 in zones else 3 if 3 in zones else 2
            keep = [i for i, (z, _) in enumerate(lines) if z == taken]
            texts.append("\n".join(lines[i][1] for i in keep))
            places.append(keep if taken == 2 else None)
        yield batch_of(schema, [part.column(0), part.column(1), texts, places])


def _same_start(a: Column, b: Column) -> Column:
    """How many path segments two paths share from the start."""
    return F.array_position(F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y)), False)


def nearest_pages(rows: DataFrame) -> DataFrame:
    """``row, partner``: for each page (``row, host, path``) the one of its host with the nearest path.

    In the order of host, path segments and row the nearest path stands just
    before or just after; the one with more leading segments in common is taken, the one
    before if they tie. The order is a range partitioning, so a host of any size
    is spread; only the edges of the partitions, one row each, are put side by side.
    """
    key = F.struct("host", "segments", "row", "path")
    rows = rows.withColumn("segments", F.split("path", "/"))
    ordered = cut_lineage(rows.repartitionByRange("host", "segments", "row").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("host", "segments", "row")
    edges = ordered.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    across = Window.orderBy("part")  # one row for each partition
    edges = edges.select("part", F.lag("high").over(across).alias("edge_before"), F.lead("low").over(across).alias("edge_after"))
    beside = (ordered.withColumn("before", F.lag(key).over(inside)).withColumn("after", F.lead(key).over(inside))
                     .join(edges, "part")
                     .withColumn("before", F.coalesce("before", "edge_before")).withColumn("after", F.coalesce("after", "edge_after")))

    def start(side):  # 0: no segment differs, so more than any other
        n = _same_start(F.col("path"), F.col(f"{side}.path"))
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(n == 0, F.lit(1 << 30)).otherwise(n)).otherwise(-1)

    first, last = start("before"), start("after")
    partner = F.when((first >= last) & (first >= 0), F.col("before.row")).when(last >= 0, F.col("after.row"))
    return beside.select("row", partner.alias("partner")).filter("partner is not null")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, decided_by``: one row per row of ``pages``.

    White space inside a line is one space, character references are decoded,
    lines are joined by \\n. n_shared counts the lines the page has in common
    with its nearest page; decided_by says whether an article's markup decided,
    the difference to the nearest page, or neither (alone: no other page of the
    host). A null or empty page has the text ''. A page whose URL has no :// has
    the empty host. Repeated rows (same id, URL and page) give the same text
    each; pages of one host with the same lines are one page in the comparison,
    so copies do not delete each other. An article is kept whole even inside an
    element whose class names a piece of the site, unless another article stands
    outside of such elements; a class that only speaks of a piece (with-sidebar)
    drops nothing. Ids are cast to long. Other columns are not read.
    """
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(url_col, html_col).alias("stamp")).alias("row")
    where = split_url(F.col(url_col))
    pages = pages.select(row, where["host"].alias("host"), where["path"].alias("path"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    lines = pages.select("row", "host", "path", "html").mapInArrow(_line_hashes, "row struct<id:long,stamp:long>, host string, path string, lines array<long>")
    same = [F.xxhash64("lines").alias("h"), F.xxhash64(F.lit(1), "lines").alias("g")]
    lines = cut_lineage(lines.dropDuplicates(["row"]).select("*", *same))
    # pages of one host with the same lines are one page in the comparison, at their least path
    least = F.struct(F.split("path", "/").alias("segments"), "path", "row")
    firsts = lines.groupBy("host", "h", "g").agg(F.min(least).alias("first")).select("host", "h", "g", "first.path", "first.row")
    firsts = cut_lineage(firsts)
    pairs = nearest_pages(firsts.select("row", "host", "path"))
    theirs = lines.select(F.col("row").alias("partner"), F.col("lines").alias("other"))
    found = (pairs.join(lines.select("row", "lines"), "row").join(theirs, "partner").select("row", "lines", "other")
                  .mapInArrow(_shared, "row struct<id:long,stamp:long>, shared array<int>"))
    of = lines.select("row", "host", "h", "g").join(firsts.select("host", "h", "g", F.col("row").alias("_first")), ["host", "h", "g"])
    shared = of.select("row", "_first").join(found.withColumnRenamed("row", "_first"), "_first").select("row", "shared")
    shared = shared.select(F.col("row").alias("_row"), "shared")
    texts = pages.select("row", "url", "html").mapInArrow(_candidate_text, "row struct<id:long,stamp:long>, url string, text string, places array<int>")
    found = texts.join(shared, F.col("row").eqNullSafe(F.col("_row")), "left")
    own = F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("shared", F.get("places", i)))
    compared = F.col("places").isNotNull() & F.col("shared").isNotNull()
    return (found.withColumn("text", F.when(compared, F.array_join(own, "\n")).otherwise(F.col("text")))
                 .select(F.col("row.id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"),
                         F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_shared"),
                         F.when(F.col("places").isNull(), "markup").when(compared, "difference").otherwise("alone").alias("decided_by")))
