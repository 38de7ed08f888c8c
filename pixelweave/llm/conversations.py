"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, by iterative-deepening A*.

Edits in ASCII order: D deletes a row (3), I inserts an empty user or assistant
row (2), K keeps a row (0), R gives it the role user or assistant (2); a
truncated row that is not deleted adds 1, blank and repeated rows must be
deleted. After every prefix only one of user and assistant is possible, so the
initials of the edits say all. A depth-first search under a cost bound that grows
by one tries them in that order; its estimate is what the rows ahead cost at
least, and a table keeps, for each row and role before it, the largest budget
that failed. The first accepting path is the cheapest and, of those, the least.

Long conversations are cut into blocks. A block is searched from each state to
each state; its edits end with an edit of its last row, so no edit string of a
block is the start of another one, and the least string of a whole is made of
the least strings of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.text import batch_of
from pixelweave.session import attach, cut_lineage

WHITE = " \t\n\v\f\r"
DELETE, INSERT, RENAME, CUT_OFF = 3, 2, 2, 1
#: Conversations up to WHOLE rows are searched as one; longer ones in blocks of BLOCK rows.
WHOLE, BLOCK = 40, 16
#: States: nothing yet, after the system row, after a user row, after an assistant row. FINAL: the end of a conversation.
START, SYSTEM, USER, ASSISTANT, FINAL = range(5)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = [*((p, q) for p in range(4) for q in range(4)), *((p, FINAL) for p in range(4))]
#: What a row costs at least: d must go, x has a role that never fits; capitals are truncated.
LEAST = {"d": DELETE, "s": 0, "u": 0, "a": 0, "x": RENAME, "S": CUT_OFF, "U": CUT_OFF, "A": CUT_OFF, "X": DELETE}


def kept_state(code: str, state: int) -> int | None:
    """The state after a kept row, or None where its role does not fit."""
    role = code.lower()
    if role == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if (role, NEXT[state]) in (("u", USER), ("a", ASSISTANT)) else None


@lru_cache(maxsize=1 << 16)
def search(codes: str, start: int, goal: int) -> tuple[int, str] | None:
    """Cost and edits of the cheapest, ASCII-least way from a state through all rows to a state (FINAL: to an end)."""
    reachable = (start == START if goal == START else
                 start == SYSTEM or start == START and "s" in codes.lower() if goal == SYSTEM else goal == FINAL or bool(codes))
    if not reachable:
        return (0, "") if not codes and start == goal else None
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + LEAST[codes[i]]
    failed: dict[tuple[int, int], int] = {}

    def path(i: int, state: int, left: int) -> str | None:
        if left < ahead[i] or failed.get((i, state), -1) >= left:
            return None
        if i == n and (state == goal or goal == FINAL and state in (START, ASSISTANT)):
            return ""
        found = None
        if i < n:
            code = codes[i]
            cut = CUT_OFF if code.isupper() else 0
            if (rest := path(i + 1, state, left - DELETE)) is not None:
                found = "D" + rest
            elif (rest := path(i, NEXT[state], left - INSERT)) is not None:
                found = "I" + rest
            elif code != "d":
                after = kept_state(code, state)
                if after is not None and (rest := path(i + 1, after, left - cut)) is not None:
                    found = "K" + rest
                elif (rest := path(i + 1, NEXT[state], left - RENAME - cut)) is not None:
                    found = "R" + rest
        elif goal == FINAL and (rest := path(i, NEXT[state], left - INSERT)) is not None:
            found = "I" + rest
        if found is None:
            failed[i, state] = max(left, failed.get((i, state), -1))
        return found

    bound = ahead[0]
    while (edits := path(0, start, bound)) is None:
        bound += 1
    return bound, edits


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None):
    return b if a is None or b is not None and b < a else a


def _joined(first: dict, then: dict) -> dict:
    out = {}
    for (p, q), one in first.items():
        if one is not None and q != FINAL:
            for r in range(5):
                two = then[q, r]
                if two is not None:
                    out[p, r] = _better(out.get((p, r)), (one[0] + two[0], one[1] + two[1]))
    return {g: out.get(g) for g in GOALS}


def through(codes: str) -> dict:
    """``search`` for all of GOALS over any number of rows: blocks, joined two by two."""
    parts = [{g: search(codes[i:i + BLOCK], *g) for g in GOALS} for i in range(0, len(codes), BLOCK)]
    while len(parts) > 1:
        parts = [_joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def code_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """The fault of a row ('' if none) and its code for the search."""
    body = text.rstrip(WHITE)
    if not body:
        return "blank", "d"
    if seen:
        return "duplicate", "d"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return ("", code) if body[-1] in ".!?" else ("truncated", code.upper())


def walk(rows, edits: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows of edits that start in ``state``; ``rows`` is read as far as the edits go."""
    rows = iter(rows)
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "K":
            state = SYSTEM if role[:1] == "s" else NEXT[state]
            yield role, text
        elif e != "D":
            state = NEXT[state]
            yield NAMES[state], text


def state_after(rows, edits: str, state: int) -> int:
    """The state after edits of rows of (role, text)."""
    rows = iter(rows)
    for e in edits:
        role = "" if e == "I" else next(rows)[0]
        state = state if e == "D" else SYSTEM if e == "K" and role[:1] == "s" else NEXT[state]
    return state


_COUNTS = ["n", "turns", "blank", "duplicate", "truncated", "illegal"]
_PIECE = pa.schema([("kind", pa.int32()), ("conv", pa.string()), ("part", pa.int64()), ("seq", pa.int64()),
                    *((c, pa.int64()) for c in _COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                    ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
                    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECE_SQL = ("kind int, conv string, part long, seq long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", low long, high long, first string, "
              "last string, cost long, audit string, sha string, costs array<long>, audits array<string>, roles array<string>, texts array<string>")
DONE, PIECE, ROWS = range(3)


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _sha(lines: Iterator[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for i, (role, text) in enumerate(lines):
        h.update(("\n" * (i > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _summary(rows: list[tuple]) -> tuple[dict, str, list[tuple[str, str]]]:
    """Counts, codes and (role, text) of the rows (conv, turn, role, text, copies, seen) of one stretch of a conversation."""
    turns = sorted({r[1] for r in rows if r[1] is not None})
    counts = dict.fromkeys(_COUNTS, 0) | {"turns": len(turns)}
    codes, lines, before = [], [], None
    for _, turn, role, text, copies, seen in rows:
        for copy in range(copies):
            fault, code = code_of(role, text, seen or copy > 0 or before == (turn, role, text))
            before = turn, role, text
            if fault:
                counts[fault] += 1
            if lines and not _legal(lines[-1][0], role):
                counts["illegal"] += 1
            codes.append(code)
            lines.append((role, text))
    counts |= {"n": len(lines), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}
    return counts, "".join(codes), lines


def _edge(conv: str, part: int, counts: dict, codes: str, lines: list[tuple[str, str]]) -> Iterator[dict]:
    """A stretch of a conversation that may go on in other partitions: its costs from state to state, and its rows in blocks."""
    ways = [through(codes)[g] for g in GOALS]
    yield {"kind": PIECE, "conv": conv, "part": part, "seq": -1, **counts, "first": lines[0][0], "last": lines[-1][0],
           "costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]}
    for i in range(0, len(lines), BLOCK):
        roles, texts = zip(*lines[i:i + BLOCK], strict=True)
        yield {"kind": ROWS, "conv": conv, "part": part, "seq": i // BLOCK, "roles": roles, "texts": texts}


def _whole(conv: str, part: int, counts: dict, codes: str, lines: list[tuple[str, str]], keep: bool) -> dict:
    """A finished conversation, with its repaired rows if asked for."""
    cost, audit = search(codes, START, FINAL) if len(codes) <= WHOLE else through(codes)[START, FINAL]
    new = list(walk(lines, audit, START))
    rows = {"roles": [r for r, _ in new], "texts": [t for _, t in new]} if keep else {}
    return {"kind": DONE, "conv": conv, "part": part, "seq": 0, **counts, "cost": cost, "audit": audit, "sha": _sha(new), **rows}


def _pieces(keep: bool):
    """Over a sorted partition: finished conversations, but the first and the last one, which may go on elsewhere, as pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []

        def flushed():
            batch = batch_of(_PIECE, [[r.get(c) for r in out] for c in _PIECE.names])
            out.clear()
            return batch

        waiting, n = None, 0
        for conv, rows in groupby(_read(batches), key=lambda r: r[0]):
            if waiting:
                out.extend(_edge(*waiting) if n == 1 else [_whole(*waiting, keep)])
            waiting, n = (conv, part, *_summary(list(rows))), n + 1
            if len(out) >= 256:
                yield flushed()
        if waiting:
            out.extend(_edge(*waiting))
        yield flushed()

    return run


def _chain(table: pa.Table) -> pa.Table:
    """The way through the pieces of one conversation: per piece which of GOALS it takes, and the counts of the whole."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    togo = {q: 0 for q in range(4)}  # least cost from a state to the end, behind the pieces seen so far
    plans = []
    for i, r in enumerate(reversed(rows)):
        ways, best = dict(zip(GOALS, r["costs"], strict=True)), {}
        for p in range(4):
            for q in [FINAL] if i == 0 else range(4):
                behind = 0 if q == FINAL else togo[q]
                if ways[p, q] is not None and behind is not None:
                    place = GOALS.index((p, q))
                    key = ways[p, q] + behind, r["ranks"][place], place, q
                    best[p] = min(best[p], key) if p in best else key
        plans.append(best)
        togo = {p: best[p][0] if p in best else None for p in range(4)}
    total, state, out = togo[START], START, []
    counts = {c: sum(r[c] for r in rows) for c in _COUNTS}
    for a, b in zip(rows, rows[1:], strict=False):
        counts["illegal"] += not _legal(a["last"], b["first"])
        counts["turns"] -= a["high"] is not None and a["high"] == b["low"]
    lows, highs = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
    counts |= {"low": min(lows, default=None), "high": max(highs, default=None), "cost": total}
    for r, best in zip(rows, reversed(plans), strict=True):
        _, _, place, after = best[state]
        out.append({"conv": r["conv"], "part": r["part"], "place": place, "state": state, **counts})
        state = after
    return pa.Table.from_pylist(out, schema=_PLAN)


_PLAN = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("place", pa.int32()), ("state", pa.int32()),
                   *((c, pa.int64()) for c in [*_COUNTS, "low", "high", "cost"])])
_PLAN_SQL = "conv string, part long, place int, state int, " + ", ".join(f"{c} long" for c in [*_COUNTS, "low", "high", "cost"])


def _repaired(rows: Iterator[tuple], audits: list[str]) -> Iterator[tuple[str, str]]:
    """Repaired lines of the rows (part, seq, state, audit, roles, texts) of one conversation, piece by piece; edits go to ``audits``."""
    edits, state, at = "", START, 0
    for part, seq, begins, audit, roles, texts in rows:
        if seq < 0:
            edits, state, at = audit, begins, 0
            audits.append(audit)
            continue
        end, left = at, len(roles)
        while left:
            left -= edits[end] != "I"
            end += 1
        lines = list(zip(roles, texts, strict=True))
        yield from walk(lines, edits[at:end], state)
        state, at = state_after(lines, edits[at:end], state), end
    yield from walk([], edits[at:], state)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("sha", pa.string())])
    for conv, rows in groupby(_read(batches), key=lambda r: r[0]):
        audits: list[str] = []
        sha = _sha(_repaired((r[1:] for r in rows), audits))
        yield batch_of(schema, [[conv], ["".join(audits)], [sha]])


def _finished_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for conv, rows in groupby(_read(batches), key=lambda r: r[0]):
        held: list[tuple] = []
        for i, (role, text) in enumerate(_repaired((r[1:] for r in rows), [])):
            held.append((conv, i, role, text))
            if len(held) == 256:
                yield batch_of(schema, list(zip(*held, strict=True)))
                held = []
        if held:
            yield batch_of(schema, list(zip(*held, strict=True)))


def _name(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with known faults, and ``copies``, how often a row stands.

    By crc32(``conv_id:turn``) % 20, a null being one space throughout: 0 drops
    the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes
    its role user.
    """
    kind = F.crc32(F.concat(_name(F.col("conv_id")), F.lit(":"), _name(F.col("turn")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                                F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind")).filter("kind <> 0").drop("kind")


def _stretches(rows: DataFrame, keep: bool) -> DataFrame:
    """The rows of ``_PIECE``, from a range partitioning by conversation, turn and role; with ``keep`` also all repaired rows."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(_name(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("int").alias("copies"))
    rows = rows.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64(F.lit(1), "text", "role")})
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (rows.groupBy("conv", "h", "g").agg(F.min(turn).alias("earliest"), F.max(turn).alias("latest")).filter("earliest < latest")
                 .drop("latest"))
    rows = attach(rows, again, ["conv", "h", "g"])
    seen = F.coalesce(turn > F.col("earliest"), F.lit(False)).alias("seen")
    order = ["conv", "turn", "role", "text"]
    dealt = rows.select(*order, "copies", seen).repartitionByRange("conv", "turn", "role").sortWithinPartitions(*order)
    return cut_lineage(dealt.mapInArrow(_pieces(keep), _PIECE_SQL))


def _edge_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of the conversations at partition edges, and their rows in order with it."""
    pieces = found.filter(F.col("kind") == PIECE)
    sorted_audits = F.array_sort(F.filter("audits", lambda a: a.isNotNull()))
    ranks = F.transform("audits", lambda a: F.coalesce(F.array_position(sorted_audits, a), F.lit(0)))
    slim = pieces.select("conv", "part", *_COUNTS, "low", "high", "first", "last", "costs", ranks.alias("ranks"))
    plan = cut_lineage(slim.groupBy("conv").applyInArrow(_chain, _PLAN_SQL))
    rows = found.filter(F.col("kind") != DONE).select("conv", "part", "seq", "audits", "roles", "texts")
    chosen = F.when(F.col("seq") < 0, F.get("audits", F.col("place")))
    rows = (rows.join(plan.select("conv", "part", "place", "state"), ["conv", "part"])
                .select("conv", "part", "seq", "state", chosen.alias("audit"), "roles", "texts"))
    return plan, rows.repartition("conv").sortWithinPartitions("conv", "part", "seq")


def repair(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: one row per conversation.

    ``rows`` are ``conv_id, turn, role, text`` and perhaps ``copies``;
    ``everyone`` (conv_id) names conversations that have a row in any case, with
    zeros, an empty audit and the hash of the empty text where no row is left.

    The rows of a conversation stand by turn, nulls first; rows of one turn by
    role and text, and copies side by side. A null role or text is one space, a
    null conv_id one conversation. A role whose first letter is not s, u or a,
    or that is empty, fits nowhere. Each row counts once: blank (no character
    but white space), else duplicate (role and text seen before), else truncated
    (the last character that is not white space is none of ``.!?``). gaps counts
    the missing turns between the least and the greatest; illegal counts
    neighbours whose initials are not su, ua or au. An empty table gives no rows.
    Other columns are not read.

    Rows are dealt by ranges of conversation, turn and role, so one conversation
    on a third of all rows is spread. What lies inside a range is finished there; the first and
    last conversation of each range leave a table of costs from state to state,
    these are chained (one row per range), and only their rows are dealt once
    more: one task then reads the repaired rows of such a conversation in order,
    without holding them, since their hash can only be taken in order. Rows of one
    conversation, turn and role stay in one range.
    """
    everyone = rows if everyone is None else everyone
    found = _stretches(rows, False)
    plan, edges = _edge_rows(found)
    hashed = edges.mapInArrow(_finished, "conv string, audit string, sha string")
    numbers = ["turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "cost"]
    whole = plan.groupBy("conv").agg(*(F.first(c).alias(c) for c in numbers)).join(hashed, "conv")
    done = found.filter(F.col("kind") == DONE).select("conv", *numbers, "audit", "sha").unionByName(whole.select("conv", *numbers, "audit", "sha"))
    names = everyone.select(F.col("conv_id"), _name(F.col("conv_id")).alias("conv")).distinct()
    gaps = F.col("high") - F.col("low") + 1 - F.col("turns")
    empty = hashlib.sha256().hexdigest()
    return names.join(done, "conv", "left").select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` of the repaired conversations, places from 0; as ``repair`` otherwise."""
    found = _stretches(rows, True)
    _, edges = _edge_rows(found)
    inside = found.filter(F.col("kind") == DONE).select("conv", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    both = inside.select("conv", F.col("place").cast("long").alias("place"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text")).unionByName(
        edges.mapInArrow(_finished_rows, "conv string, place long, role string, text string"))
    return both.select(F.when(F.col("conv") != " ", F.col("conv")).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "place", "role", "text")
