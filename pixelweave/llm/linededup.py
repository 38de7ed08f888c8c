"""Line dedup over overlapping windows of three lines, or of pieces of lines, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.rules import SPACES

SPAN = 3
#: Words of a piece: 6 to 12, less only where a line has less. It ends at a sentence where it can, and the last one of a
#: line takes up to 5 more, so no piece has over 17 words and any 51 words of whole lines hold a window of three pieces.
PIECE = r"\s*(?:\S++\s++){0,5}(?:\S*[^\s.!?]\s++){0,6}\S++(?:(?:\s++\S++){0,5}\s*\z|\s*)"


def _counts(line: Column) -> Column:
    return F.translate(line, SPACES, "") != ""


def _windows(lines: Column, span: int) -> Column:
    """The hashed windows of the lines that hold more than white space, with their place among those lines."""
    def of(x):
        count = F.size(x)
        size = F.least(count, F.lit(span))

        def one(i):
            part = F.slice(x, i + 1, size)
            return F.struct(F.xxhash64(F.lit(0), part).alias("h"), F.xxhash64(F.lit(1), part).alias("g"), i.alias("at"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - size), one))

    return F.element_at(F.transform(F.array(lines), of), 1)


def _pieces(line: Column, number: Column) -> Column:
    """The pieces of a line, whose texts together are the line; a line of white space is one."""
    texts = F.when(_counts(line), F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))).otherwise(F.array(line))
    return F.transform(texts, lambda s: F.struct(s.alias("s"), number.alias("line")))


def _units(text: Column, pieces: bool) -> Column:
    """What windows are made of, in order: (s, line)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    if pieces:
        return F.flatten(F.transform(lines, _pieces))
    return F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("line")))


def dedup_lines(docs: DataFrame, *, span: int = SPAN, pieces: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and ``n_lines``, ``n_removed`` (long).

    Lines are \\n-split and count if they hold more than white space, compared
    without the white space around them. Every ``span`` such lines in a row are
    a window; a text of fewer lines is one window. The first occurrence of a
    window is in the document of the smallest id, at its first place there.
    Lines that any later occurrence covers are cut, overlapping occurrences
    merged: every cut line has an equal line that stays, in an earlier place.
    Other lines, blank ones too, stay as they are, so a text without repeats
    comes back unchanged.

    With ``pieces`` long lines are first cut into pieces (``PIECE``), and
    windows and cuts are of pieces: any repeated run of whole lines of over 50
    words goes, be it one line, and so do most repeats of whole sentences inside
    lines. What is left of a line stays. ``n_removed`` counts the lines of which
    nothing is left.

    Repeats inside a text are found in the row itself. Windows of different
    documents meet as hashes: a combinable minimum per window, joined back, so
    a window that a third of all texts hold is a hot join key, which adaptive
    execution splits. Null and empty texts have no lines and stay. Rows that
    share an id never cut one another's lines; a row without an id is last in
    order and keeps its lines against other such rows.
    """
    text = F.col(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
                       F.hash(text).alias("_stamp"))
    units = rows.select("_id", "_stamp", _units(F.col(f"row.{text_col}"), pieces).alias("_units"))
    trimmed = F.transform(F.filter("_units", lambda u: _counts(u["s"])), lambda u: F.trim(u["s"], F.lit(SPACES)))
    # sorted by hash and place, so that the first of each run of equal windows is the one that may stay
    slim = units.select("_id", "_stamp", F.array_sort(_windows(trimmed, span)).alias("w"))

    def again(x, j):
        before = F.get("w", j - 1)
        return F.coalesce((x["h"] == before["h"]) & (x["g"] == before["g"]), F.lit(False))

    marked = slim.select("_id", "_stamp", F.inline(F.transform(
        "w", lambda x, j: F.struct(x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("at"), again(x, j).alias("again")))))
    first = (marked.filter("not again").groupBy("h", "g").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
                   .filter("first < last").select("h", "g", "first"))
    cut = (marked.join(first, ["h", "g"], "left").filter("again or _id > first")
                 .groupBy("_id", "_stamp").agg(F.collect_set("at").alias("_cut")))
    joined = rows.join(cut, ["_id", "_stamp"], "left").withColumn("_units", _units(F.col(f"row.{text_col}"), pieces))

    def line_of(i):
        return F.get("_units", i)["line"]

    def with_break(i, j):
        starts = (j > 0) & (line_of(i) != line_of(F.get("_stay", j - 1)))
        return F.concat(F.when(starts, "\n").otherwise(""), F.get("_units", i)["s"])

    def lines_in(places):
        return F.size(F.array_distinct(F.transform(places, line_of)))

    every = F.sequence(F.lit(0), F.size("_units") - 1)
    covered = F.array_distinct(F.flatten(F.transform("_cut", lambda a: F.sequence(a, a + span - 1))))
    out = (joined.withColumn("_places", F.filter(every, lambda i: _counts(F.get("_units", i)["s"])))
                 .withColumn("_gone", F.transform(covered, lambda p: F.get("_places", p)))
                 .withColumn("_gone", F.filter("_gone", lambda p: p.isNotNull()))
                 .withColumn("_stay", F.array_except(every, "_gone"))
                 .withColumn("_n", lines_in("_places")))
    new = F.when(F.col("_cut").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(F.transform("_stay", with_break), ""))
    removed = F.when(F.col("_cut").isNull(), F.lit(0)).otherwise(F.col("_n") - lines_in(F.array_except("_places", "_gone")))
    finished = F.struct(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns),
                        F.col("_n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    # through a generator: a caller's filter on the counts must not be pushed below, into the cutting of each unit
    return out.select(F.inline(F.array(finished)))
