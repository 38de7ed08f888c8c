"""URL verdicts: prefix rules, and boosted trees on lexical features for the URLs that no rule decides."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs to train on at most (in expectation); more are thinned by a hash of the URL.
TRAIN_ROWS = 50_000
#: Rows that the common rate counts for in the rate of a suffix.
SUFFIX_PRIOR = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens",
            "entropy", "parameters", "query_length", "upper", "last_rate", "pair_rate"]


def split_url(url: Column) -> dict[str, Column]:
    """Host (lower-case), path, and the rest from ? or # on; all empty without ://."""
    url = F.coalesce(url, F.lit(""))
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    return {"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            "tail": F.regexp_replace(rest, r"^[^?#]*", "")}


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null.

    A rule ``host/path`` fits its host and the subdomains of it if the path
    starts with the rule's path. Of equally long rules the greater text counts.
    """
    table = F.array(*(F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"),
                               F.lit(r[:r.index("/")]).alias("host"), F.lit(r[r.index("/"):]).alias("path"))
                      for v, r in rules))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"),
                                                            r["verdict"].alias("verdict"))))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    def share(c):
        return (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)

    distinct = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(F.transform(distinct, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of ``url, host, path, tail`` and the two host suffixes."""
    url, host, tail = F.coalesce("url", F.lit("")), F.col("host"), F.col("tail")
    query = F.regexp_extract(tail, r"^\?([^#]*)", 1)
    add = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _count(host, "0123456789"), "hyphens": _count(url, "-_"), "entropy": _entropy(url),
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")), "query_length": F.length(query),
        "upper": _count(url, UPPER),
    }
    return (rows.withColumns({k: v.cast("double") for k, v in add.items()})
                .withColumn("last", F.substring_index(host, ".", -1)).withColumn("pair", F.substring_index(host, ".", -2)))


def _half(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col(url)), F.lit(2))


def _with_rates(rows: DataFrame, train: DataFrame, mean: float) -> DataFrame:
    """Add the blocked share of each suffix among the labelled URLs of one half.

    The trees learn from the other half only, so no URL's own label is in its features.
    """
    for suffix in ("last", "pair"):
        stats = (train.filter(_half() == 0).groupBy(suffix).agg(F.count("*").alias("_n"), F.sum("label").alias("_k"))
                      .withColumnRenamed(suffix, "_suffix"))
        rate = (F.coalesce("_k", F.lit(0.0)) + SUFFIX_PRIOR * mean) / (F.coalesce("_n", F.lit(0)) + SUFFIX_PRIOR)
        rows = (rows.join(stats, rows[suffix] == stats["_suffix"], "left").withColumn(f"{suffix}_rate", rate)
                    .drop("_suffix", "_n", "_k"))
    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], *, labelled: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4,
               block_at: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, score, verdict``: one row per row of ``pages``.

    A URL that a rule fits gets the rule's verdict. The rest get the verdict of
    gradient-boosted trees: block from ``block_at`` on. The trees learn from
    ``labelled`` (url, blocked 0/1), or without it from the URLs of ``pages``
    that the rules decide. Training
    uses about ``train_rows`` of one half of them, chosen by a hash of the URL; the
    suffix statistics use the whole other half. Where that half has no labels of
    both kinds, the score is the blocked share of all labels (0 without labels).

    A null URL, or one without ://, has an empty host and path and takes the
    trees' verdict. Repeated rows are judged one by one. An empty table gives no
    rows. Other columns are not read.
    """
    def parsed(df, *more):
        rows = df.select(F.col(url_col).alias("url"), *more)
        return rows.withColumns(split_url(F.col("url")))

    rows = parsed(pages, F.col(id_col).alias("page_id"))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_hit", hit).withColumn("rule", F.col("_hit.rule")).withColumn("given", F.col("_hit.verdict")).drop("_hit")
    rows = lexical(rows).withColumn("label", F.when(F.col("given") == "block", 1.0).when(F.col("given") == "allow", 0.0))
    rows = cut_lineage(rows)
    if labelled is None:
        train = rows.filter("label is not null")
    else:
        train = cut_lineage(lexical(parsed(labelled, F.col("blocked").cast("double").alias("label"))).filter("label is not null"))
    n, blocked, kinds = train.agg(F.count("*"), F.sum("label"), F.countDistinct(F.when(_half() == 1, F.col("label")))).first()
    mean = blocked / n if n else 0.0
    if kinds < 2:
        scored = rows.withColumn("score", F.lit(mean))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        share = min(1.0, 2 * train_rows / n)
        chosen = train.filter((_half() == 1) & (F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7).fit(
            vectors.transform(_with_rates(chosen, train, mean)).select("features", "label"))
        known = _with_rates(rows.drop("label"), train, mean)
        scored = model.transform(vectors.transform(known)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("page_id", "host", "path", "rule", "score",
                         F.coalesce("given", F.when(F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"))
