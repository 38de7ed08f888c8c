"""Mixing sources to weights, and surrogates of personal data."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pixelweave.llm import mixing, surrogates


def pour(children, amount):
    """(name, cap, weight) filled in proportion, shortages going to siblings."""
    given, left, rest = {}, amount, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while rest:
        weight = sum(w for _, _, w in rest)
        name, cap, w = rest[0]
        if cap * weight <= left * w:
            given[name] = cap
            left -= cap
            rest = rest[1:]
        else:
            return given | {n: left * w // weight for n, _, w in rest}
    return given


def brute_mix(rows, weights, percent, epochs, seed):
    tokens = {}
    docs = [(i, lang or "\x00", source or "\x00", len((t or "").split())) for i, t, source, lang in rows]
    docs = [d for d in docs if d[3]]
    for _, lang, source, n in docs:
        tokens[lang, source] = tokens.get((lang, source), 0) + n
    total = sum(tokens.values())
    amount = min(total * percent // 100, total * epochs)
    langs = {k: sum(n for (a, _), n in tokens.items() if a == k) for k in {a for a, _ in tokens}}
    top = pour([(k, n * epochs, weights.get(k, 1)) for k, n in langs.items()], amount)
    out = {}
    for lang in langs:
        low = pour([(s, n * epochs, 1) for (a, s), n in tokens.items() if a == lang], top[lang])
        for source, given in low.items():
            whole, part = divmod(given, tokens[lang, source])
            order = sorted((hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), i, n)
                           for i, a, s, n in docs if (a, s) == (lang, source))
            upto = 0
            for _, i, n in order:
                upto += n
                if whole + (upto <= part):
                    out[i] = whole + (upto <= part)
    return out


def test_mixture_equals_brute_force(docs_of):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "en", "en", "de", None])) for i in range(300)]
    rows += [(1000, None, "a", "en"), (1001, "", "b", "de"), (1002, "x " * 30_000, "a", "en")]
    for weights, percent, epochs in (({"en": 1, "de": 5}, 80, 2), ({}, 100, 1), ({"de": 100}, 250, 3), ({"en": 9}, 5, 2)):
        found = mixing.mix(docs_of(rows), ["lang", "source"], weights={"lang": weights}, budget_percent=percent, epochs=epochs, seed=4).collect()
        assert {r.doc_id: r.copies for r in found} == brute_mix(rows, weights, percent, epochs, 4)
        assert all(r.lang != "\x00" and r.source != "\x00" for r in found)


def test_budget_is_kept_and_weights_hold(docs_of):
    rows = [(i, "w " * 10, f"s{i % 2}", "en" if i % 4 else "de") for i in range(2000)]
    found = mixing.mix(docs_of(rows), ["lang", "source"], weights={"lang": {"de": 1, "en": 1}}, budget_percent=40, epochs=2)
    totals = {r.lang: r.n for r in found.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    assert totals == {"de": 4000, "en": 4000}


def test_zero_weight_repeated_rows_and_no_rows(docs_of):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "c", "s", "de")]
    found = mixing.mix(docs_of(rows), ["lang"], weights={"lang": {"de": 0}}, budget_percent=100, epochs=1).collect()
    assert [(r.doc_id, r.copies) for r in found] == [(1, 1), (1, 1)]
    assert mixing.mix(docs_of([]), ["lang", "source"]).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, " ")]), ["lang"]).count() == 0


def rewritten(df, key="k"):
    return {r.doc_id: r for r in surrogates.pseudonymise(df, key).collect()}


def test_surrogates_keep_format_and_coreference(docs_of):
    texts = ["Mail jo.12@mail1.example.com or JO.12@mail1.example.com!", "again jo.12@mail1.example.com, ann@mail1.example.com.",
             "Call +1 (017) 555-7713 or (017) 555-7713; card 4111 1111 1111 1111, 4111111111111111", "from 10.20.30.40, not 1.2.3.4.5 or 12.5",
             "Mr John Smith, Mrs Smith and Herr MÜLLER", "Господин Иван Петров и Госпожа Петров", 'token = "0123456789abcdef0123456789abcdef01234567"']
    found = rewritten(docs_of(list(enumerate(texts))))
    out = [found[i].text for i in range(len(texts))]
    assert [found[i].n_entities for i in range(len(texts))] == [2, 2, 4, 1, 3, 2, 1]
    a, b = re.findall(r"\S+@[\w.]+\w", out[0])
    assert a == b.lower() == re.findall(r"\S+@[\w.]+\w", out[1])[0] and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    assert re.findall(r"@(\S+\w)", out[1])[0] == re.findall(r"@(\S+\w)", out[1])[1].rstrip(".")
    phone = re.fullmatch(r"Call (\+1) (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}); card (\d{4} \d{4} \d{4} \d{4}), (\d{16})", out[2])
    assert phone and phone[2] == phone[3] and phone[4].replace(" ", "") == phone[5] and "555-7713" not in out[2]
    assert re.fullmatch(r"from \d+\.\d+\.\d+\.\d+, not 1\.2\.3\.4\.5 or 12\.5", out[3]) and "10.20.30.40" not in out[3]
    names = re.fullmatch(r"Mr ([A-Z][a-z]+) ([A-Z][a-z]+), Mrs ([A-Z][a-z]+) and Herr ([A-Z]+)", out[4])
    assert names and names[2] == names[3] and any(names[1].startswith(n) for n in surrogates.GIVEN["latin", "m"])
    cyrillic = re.fullmatch(r"Господин ([А-Яа-я]+) ([А-Яа-я]+) и Госпожа ([А-Яа-я]+)", out[5])
    assert cyrillic and cyrillic[2] == cyrillic[3] and cyrillic[2] != "Петров"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[6]) and out[6] != texts[6]
    assert rewritten(docs_of([(0, texts[0])]))[0].text == out[0] and rewritten(docs_of([(0, texts[0])]), "other")[0].text != out[0]


def test_surrogates_are_distinct_and_new(spark):
    units = spark.createDataFrame([("local", f"{a}{b}") for a in "abcdefghij" for b in "abcdefghij"] + [("ip", f"1.1.1.{i}") for i in range(50)], "kind string, unit string")
    chosen = surrogates.assign(units, "k").collect()
    assert len(chosen) == 150 and len({(r.kind, r.surrogate) for r in chosen}) == 150
    assert not {(r.kind, r.surrogate) for r in chosen} & {(r.kind, r.unit) for r in chosen}


def test_more_units_than_short_surrogates(spark):
    units = spark.createDataFrame([("local", c) for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, unit string")
    chosen = surrogates.assign(units, "k").collect()
    assert len({r.surrogate for r in chosen}) == 26 and not {r.surrogate for r in chosen} & set("abcdefghijklmnopqrstuvwxyz")


def test_awkward_texts_come_back(docs_of):
    rows = [(1, None), (2, ""), (3, "no data"), (3, "no data"), (4, "a@b.cc"), (4, "a@b.cc"), (4, "x a@b.cc"), (None, "a@b.cc"), (5, "word" * 30_000),
            (6, "a@b.cc " * 3000), (7, "1" * 50_000), (8, "a." * 40_000 + "@")]
    df = docs_of(rows)
    out = surrogates.pseudonymise(df, "k")
    assert out.columns == [*df.columns, "n_entities"] and out.count() == len(rows)
    found = out.collect()
    new = next(r.text for r in found if r.doc_id is None)
    assert new != "a@b.cc" and {r.text for r in found if r.doc_id == 4} == {new, f"x {new}"}
    assert {r.doc_id: r.text for r in found if r.doc_id in (1, 2, 3, 5, 7, 8)} == {i: t for i, t in rows if i in (1, 2, 3, 5, 7, 8)}
    assert next(r for r in found if r.doc_id == 6).text == f"{new} " * 3000
    assert surrogates.pseudonymise(docs_of([]), "k").count() == 0


def test_no_entity_of_the_test_documents_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    both = docs.join(surrogates.pseudonymise(docs, "k").select("doc_id", F.col("text").alias("new")), "doc_id")
    left = both.select(F.explode(F.regexp_extract_all("text", F.lit(surrogates.PATTERN), F.lit(0))).alias("e"), "new")
    assert left.count() > 10 and left.filter(F.contains("new", "e")).count() == 0


def test_a_full_number_space_trades_places(spark):
    """All 100 two-digit numbers and 7000 of four digits: nobody keeps a number, nobody shares one."""
    units = [("phone", f"{i:02d}") for i in range(100)] + [("phone", f"{i:04d}") for i in range(7000)] + [("card", "1234567890123456"), ("surname", "weber")]
    found = {(r.kind, r.unit): r.surrogate for r in surrogates.assign(spark.createDataFrame(units, "kind string, unit string"), "k").collect()}
    assert found.keys() == set(units)
    assert len({(k, s) for (k, _), s in found.items()}) == len(units)
    assert all(s != u and (k == "surname" or len(s) == len(u) and s.isdigit()) for (k, u), s in found.items())
