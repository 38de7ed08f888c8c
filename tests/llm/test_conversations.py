"""Conversation repair against a dynamic program over all edits, whole and in blocks, and against rows worked out by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import conversations as c

WHITE = " \t\n\v\f\r"


def by_table(codes, start=c.START, goal=c.FINAL):
    """The least (cost, edits) from state to goal, by a table over rows and states with at most four inserts in a row."""
    best = {start: (0, "")}

    def inserted(states):
        for _ in range(4):
            more = dict(states)
            for s, (cost, edits) in states.items():
                to = (cost + 2, edits + "I")
                more[c.NEXT[s]] = min(more.get(c.NEXT[s], to), to)
            states = more
        return states

    for code in codes:
        new = {}
        for s, (cost, edits) in inserted(best).items():
            cut = code.isupper()
            steps = [(s, 3, "D")]
            if code != "d":
                steps.append((c.NEXT[s], 2 + cut, "R"))
                if c.kept_state(code, s) is not None:
                    steps.append((c.kept_state(code, s), cut, "K"))
            for to, more, e in steps:
                way = cost + more, edits + e
                new[to] = min(new.get(to, way), way)
        best = new
    if goal != c.FINAL:
        return best.get(goal)
    ends = inserted(best)
    return min(ends[s] for s in (c.START, c.ASSISTANT) if s in ends)


def expected(rows):
    """What ``repair`` says of one conversation's damaged rows (turn, role, text), by plain loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        code = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = by_table(codes) if rows else (0, "")
    lines, state, left = [], c.START, iter(rows)
    for e in audit:
        row = next(left) if e != "I" else (0, "", "")
        if e == "D":
            continue
        state = c.SYSTEM if e == "K" and row[1][:1] == "s" else c.NEXT[state]
        lines.append((row[1] if e == "K" else c.NAMES[state]) + ":" + row[2])
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults.values(), illegal, cost, audit, sha, lines


def damaged(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def table(df):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[x] for x in cols) for r in df.collect()}


def test_search_is_cheapest_and_least():
    draw = random.Random(1)
    for _ in range(1500):
        codes = "".join(draw.choice("dsuaxSUAX" if draw.random() < .5 else "uuaas") for _ in range(draw.randrange(9)))
        assert c.search(codes, c.START, c.FINAL) == by_table(codes)
        for p, q in c.GOALS:
            assert c.search(codes, p, q) == by_table(codes, p, q) or not codes and q != c.FINAL, (codes, p, q)


def test_blocks_joined_equal_the_whole():
    draw = random.Random(2)
    for n in (1, 16, 17, 33, 90, 400):
        codes = "".join(draw.choice("dsuauauaxSUAX") for _ in range(n))
        found = c.through(codes)
        assert all(found[p, q] == by_table(codes, p, q) for p, q in c.GOALS), codes
    assert c.through("s" * 20)[c.START, c.FINAL] == by_table("s" * 20)


@pytest.fixture(scope="module")
def awkward():
    draw = random.Random(3)
    texts = ["All is well.", "cut off", "", " \t", "Why?", "é ü.", None, "again.", "again.", "no stop"]
    rows = [(conv, t, draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice(texts))
            for conv in [None, *range(40)] for t in [None, *range(0, draw.randrange(9), draw.choice([1, 2]))] for _ in range(draw.choice([1, 1, 2]))]
    return rows + [(77, t, ["user", "assistant"][t % 2] if t % 7 else "user", f"text {t % 50}{'.' if t % 5 else ''}") for t in range(700)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repair_equals_plain_loops(spark, awkward, partitions):
    """Also with ranges far smaller than a conversation, which then passes through all of them."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(awkward, "conv_id long, turn long, role string, text string").withColumns(
            {x: F.lit(1) for x in ("conv", "part", "kind", "state", "h", "seen", "first")})
        found = table(c.repair(c.damage(df), df))
        lines = {}
        for r in c.repaired_rows(c.damage(df)).collect():
            lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {conv: expected(rows) for conv, rows in damaged(awkward).items()}
    assert found == {conv: w[:-1] for conv, w in want.items()}
    assert {conv: [x for _, x in sorted(v)] for conv, v in lines.items()} == {conv: w[-1] for conv, w in want.items() if w[-1]}


def test_known_answers(spark):
    good = [(1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So.")]
    alone = [(2, 0, "user", "Hello.")]
    df = spark.createDataFrame(good + alone, "conv_id long, turn long, role string, text string")
    found = table(c.repair(df))
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "KKK")
    assert found[1][7] == hashlib.sha256(b"system:Be kind.\nuser:Why?\nassistant:So.").hexdigest()
    assert found[2][5:] == (2, "KI", hashlib.sha256(b"user:Hello.\nassistant:").hexdigest())
    assert c.repair(df.limit(0)).count() == 0 and c.repaired_rows(df.limit(0)).count() == 0
    assert table(c.repair(df.filter("conv_id = 1"), df))[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_query_on_the_test_table(spark):
    from pixelweave.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert table(QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01")) == {k: expected(v)[:-1] for k, v in damaged(rows).items()}
