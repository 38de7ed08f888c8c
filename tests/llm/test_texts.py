"""Decontamination, quality scores and quality rules."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, quality, queries, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark, docs_of):
    rng = random.Random(2)
    pool = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 4, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!?"), (None, "t1 t2"), (7, items[7][1]), (103, items[7][1])]
    rows = []
    for i in range(120):
        text = [rng.choice(pool) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(60))]
        cut = rng.choice(items)[1] or ""
        rows.append((i, " ".join(text[:20]) + " " + cut.upper() + "; " + " ".join(text[20:])))
    rows += [(300, None), (301, ""), (302, "t1 " * 30_000), (5, rows[5][1]), (6, "another text of a used id"), (None, items[3][1])]
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            if item is not None:
                windows[tuple(w[i:i + n])].add(item)
    sizes = {len(w) for w in windows}

    def expected(i, text):
        w, hit, named = words_of(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a:a + n])):
                    hit |= set(range(a, a + n))
                    named |= found
        return i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)

    found = decontaminate.decontaminate(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).drop("text_stamp")
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_decontamination_without_rows(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs_of([]), none).count() == 0
    row = decontaminate.decontaminate(docs_of([(1, "a b")]), none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_quality_learns_and_keeps_the_fold_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = (found[found.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert (good >= 0.3).mean() > 0.99 and (bad >= 0.3).mean() < 0.1


def test_quality_of_awkward_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (9, 1)], "doc_id long, quality int")
    rows = docs_of([(1, "fine words here"), (2, "$$$ ### $$$"), (3, None), (4, ""), (None, "fine"), (1, "fine words here"), (5, "x " * 50_000)])
    found = quality.classify(rows, labels).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    blank = [r.score for r in found if r.doc_id in (3, 4)]
    assert blank[0] == blank[1]
    assert quality.classify(docs_of([]), labels).count() == 0
    plain = quality.classify(docs_of([(1, "a")]), labels.filter("false")).first()
    assert plain.score == pytest.approx(0.5)


def test_score_sees_the_text_alone(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, "good text" if i % 2 else "&&& bad", f"src{i}", "en") for i in range(40)]
    a = quality.classify(docs_of(rows), labels).filter("doc_id < 2").select("score").collect()
    b = quality.classify(docs_of([(i, t, "other", "fr") for i, t, _, _ in rows]), labels).filter("doc_id < 2").select("score").collect()
    assert a == b


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    covered = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(docs_of):
    texts = [None, "", " ", "a", "a b c a b c", "a a a a", "x\ny\nx\n \n", "# $$ <é> ü z 😀", "one two three " * 40, "w " * 60_000,
             *(" ".join(str(i * j % 97) for j in range(60)) for i in range(1, 8))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "q")]
    found = rules.judge(docs_of(rows)).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found if r.doc_id is not None)
    assert got == sorted((i, *brute_measures(t)) for i, t in rows if i is not None)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert rules.judge(docs_of([])).count() == 0


def test_hosts_are_shrunk_and_judged(docs_of):
    good = " ".join(f"v{i}" for i in range(60))
    rows = [(100 * h + i, "short" if i < 2 + h % 3 else good, f"clean{h}") for h in range(12) for i in range(20)]
    rows += [(9000 + i, good if i % 10 == 0 else "short", "junk") for i in range(200)]
    rows += [(20_000, "short", "tiny"), (20_001, good, "tiny"), (30_000, good, None)]
    found = {r.doc_id: r for r in rules.judge(docs_of(rows)).collect()}
    assert found[10].kept and not found[0].kept
    assert not found[9010].kept and not found[9010].base_failed and 0.85 < found[9010].host_rate < 0.9
    assert 0.1 < found[10].host_rate < 0.2 and found[20_001].host_rate < 0.5 and found[20_001].kept  # one failure of two is little evidence
    assert found[30_000].host is None and 0 < found[30_000].host_rate < 0.5


def test_equal_hosts_share_the_common_rate(docs_of):
    rows = [(i, "short", f"h{i % 4}") for i in range(40)]
    assert {round(r.host_rate, 6) for r in rules.judge(docs_of(rows)).collect()} == {1.0}


def test_base_columns_stay_under_any_partitioning(spark):
    sf = "/root/testdata/sf0.001"
    a = queries.QUERIES["op7_quality_rules"](spark, sf).agg(F.sum(F.xxhash64("doc_id", "n_words", "n_repeat_words", "kept").cast("decimal(38,0)"))).first()[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    b = rules.judge(docs).agg(F.sum(F.xxhash64("doc_id", "n_words", "n_repeat_words", "kept").cast("decimal(38,0)"))).first()[0]
    assert a == b
