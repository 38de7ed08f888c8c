"""The pipeline's stages one by one on awkward rows, and against what brute force would keep."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import minhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_stage_takes_awkward_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other text"), (None, None), (None, "a\nb\nc"), (4, "x " * 20_000)]
    for data in (rows, []):
        docs = docs_of(data)
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert i == len(pipeline.STAGES) - 1 or out.columns == docs.columns, name
            assert out.count() <= len(data)


def test_one_document_of_each_group_stays(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (6, text), (7, text + " tail"), (8, "quite another text"), (8, "quite another text"), (8, "a text"), (8, None),
            (9, text), (9, "of its own"), (None, text), (None, None)]
    kept = pipeline.keep_one_of_near_duplicates(spark, docs_of(rows), SF).collect()
    left = [(5, text), (8, "quite another text"), (8, "a text"), (8, None), (9, "of its own"), (None, text), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(left, key=str)


def test_the_lines_stage_cuts_each_text_once(spark, docs_of):
    """The filter on the counts stays above the cut: one regular expression for each scan."""
    out = pipeline.cut_repeated_lines(spark, docs_of([(1, "a b c")]), SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == plan.count("LogicalRDD") > 0


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_the_quality_stage_rejects_what_is_labelled_bad(spark, scale):
    from pixelweave.llm import quality

    folder = f"/root/testdata/sf{scale}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = pipeline.keep_quality(spark, docs, folder).select("doc_id", F.lit(1).alias("stays"))
    held = labels.filter(quality.held_out(F.col("doc_id"))).join(kept, "doc_id", "left").groupBy("quality").agg(
        F.avg(F.coalesce("stays", F.lit(0))).alias("share"))
    share = {r.quality: r.share for r in held.collect()}
    assert share[0] <= 0.1 and share[1] >= 0.99


def test_copies_lose_their_lines_and_go(spark, docs_of):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "new\na\nb\nc"), (4, ""), (5, None)]
    kept = {r.doc_id: (r.text, r.n_chars) for r in pipeline.cut_repeated_lines(spark, docs_of(rows), SF).collect()}
    assert kept == {1: ("a\nb\nc", 5), 3: ("new", 3), 4: ("", None), 5: (None, None)}


def test_a_repeated_long_line_goes_alone(spark, docs_of):
    line = " ".join(f"w{i}" for i in range(60))
    kept = {r.doc_id: (r.text, r.n_chars) for r in pipeline.cut_repeated_lines(spark, docs_of([(1, f"x\n{line}\ny"), (2, f"u\n{line}\nv")]), SF).collect()}
    assert kept == {1: (f"x\n{line}\ny", len(line) + 4), 2: ("u\nv", 3)}


def test_contaminated_documents_go(spark, docs_of):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    kept = pipeline.drop_contaminated(spark, docs_of([(1, item), (2, "clean text"), (None, item), (3, None)]), SF).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3]


def test_stages_on_the_test_documents(spark, raw, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs, seen = raw, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == raw.columns
    good = raw.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert seen["quality"].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()
    left = minhash.near_duplicates(seen["near_duplicates"], shingle=5, percent=80)
    assert left.filter("not kept").count() == 0
    assert docs.filter(F.col("text").isNull()).count() == 0


def test_run_gives_the_mixture(spark):
    found = pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "domain", "lang", "source", "tokens", "copies"]
    rows = found.collect()
    assert rows and all(1 <= r.copies <= 3 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
