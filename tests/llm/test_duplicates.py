"""Near-duplicates and line dedup against brute force, with every awkward row."""

import random

from pyspark.sql import functions as F

from pixelweave.llm import linededup, minhash
from pixelweave.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=3):
    rng = random.Random(seed)
    rows, bases = [], [[rng.choice(WORDS) for _ in range(60)] for _ in range(6)]
    for i in range(150):
        words = list(rng.choice(bases)) if i % 3 else [rng.choice(WORDS) for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    return [*rows, (500, None), (501, ""), (502, " \n\t "), (503, "One"), (504, "one"), (505, "one two"), (506, "x " * 30_000),
            (507, "X\u000bx " + "x " * 40_000), (None, "one"), (None, None), (3, rows[3][1]), (4, "a row of its own under a used id")]


def brute(rows, k, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if None not in (i, j) and i != j and s & t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def test_groups_equal_brute_force(docs_of):
    rows = corpus()
    for k, percent in ((3, 85), (5, 80)):
        found = minhash.near_duplicates(docs_of(rows), shingle=k, percent=percent)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows, k, percent)


def test_links_between_members_that_are_not_centres(docs_of):
    """A bucket of mutually distant texts with one linked pair besides its smallest member."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(200), 18):
            words[p] = f"own{i}x{p}"
        rows.append((i, " ".join(words)))
    rows.append((60, rows[41][1] + " tail"))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(rows), shingle=3, percent=85).collect()}
    assert found[60] == 41 and len(set(found.values())) == 60


def test_no_documents(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.near_duplicates(docs_of([(None, None)])).collect()[0].kept
    assert linededup.dedup_lines(docs_of([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def brute_lines(rows, span=3):
    space, seen, out = " \t\n\v\f\r", {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        counted = [j for j, s in enumerate(lines) if s.strip(space)]
        size, gone = min(span, len(counted)), set()
        for a in range(len(counted) - size + 1 if size else 0):
            window = tuple(lines[j].strip(space) for j in counted[a:a + size])
            if window in seen and (seen[window] != i or a > 0):
                gone |= set(counted[a:a + size])
            seen.setdefault(window, i)
        out[i] = (text if not gone else "\n".join(s for j, s in enumerate(lines) if j not in gone), len(counted), len(gone))
    return out


def test_lines_equal_brute_force(docs_of):
    rng = random.Random(1)
    pool = [f"line {i}" for i in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, "x\n" * 5000), (204, "only"), (205, " only "), (None, "a\nb\nc"), (206, "a\nb\nc")]
    df = docs_of(rows)
    found = linededup.dedup_lines(df)
    assert found.columns == [*df.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()} == brute_lines(rows)


def test_repeated_rows_do_not_cut_each_other(docs_of):
    found = linededup.dedup_lines(docs_of([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "z\na\nb\nc")])).orderBy("doc_id").collect()
    assert [r.text for r in found] == ["a\nb\nc", "a\nb\nc", "z"]


def test_hot_window_and_row_order(docs_of):
    rows = [(i, f"head {i}\na\nb\nc\ntail {i}") for i in range(300)]
    found = linededup.dedup_lines(docs_of(rows).orderBy(F.desc("doc_id")))
    assert found.filter("n_removed = 3").count() == 299 and found.filter("n_removed = 0").first().doc_id == 0


def test_long_passages_on_one_or_two_lines(docs_of):
    rng = random.Random(7)

    def words(n, stop=True):
        return " ".join(rng.choice(WORDS) + ("." if stop and rng.random() < 0.12 else "") for _ in range(n))

    one, plain, a, b, blank = words(51), words(300, stop=False), words(20), words(31), "  "
    rows = [(1, f"{words(9)}\n{one}\n{words(9)}\n{plain}"), (2, f"{words(9)}\n{a}\n{b}\n{words(9)}")]
    new = [words(40) for _ in range(4)]
    rows += [(3, f"{new[0]}\n {one}\n{blank}\n{new[1]}"), (4, f"{new[2]}\n{plain}"), (5, f"{a}\n{b}\n{new[3]}"), (6, words(500)), (7, None)]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs_of(rows), pieces=True).collect()}
    assert found[3] == (f"{new[0]}\n{blank}\n{new[1]}", 3, 1)
    assert found[4] == (new[2], 2, 1) and found[5] == (new[3], 3, 2)
    assert all(found[i][0] == t for i, t in rows if i in (1, 2, 6, 7))


def test_repeated_sentences_leave_the_rest_of_their_line(docs_of):
    passage = " ".join(f"p{i} q{i} r{i} s{i} t{i} u{i} v{i}." for i in range(8))
    rows = [(1, f"a b c d e f g. {passage}"), (2, f"o p q r s t u. {passage} A tail of its own that stays here.")]
    found = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs_of(rows), pieces=True).collect()}
    assert found[1][0] == rows[0][1]
    assert found[2] == ("o p q r s t u. A tail of its own that stays here.", 0)
