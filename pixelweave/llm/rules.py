"""Quality rules with host verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def word_list(text: Column) -> Column:
    """Words of a text between spaces and \\t \\n \\v \\f \\r; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, also where lambdas inside use it for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window found twice or more in the same text.

    Windows are sorted by hash with their positions, so equal ones stand side
    by side: n log n for one text, whatever its length.
    """

    def windows(w):
        last = F.size(w) - (n - 1)
        return F.array_sort(F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.struct(F.xxhash64(*(F.get(w, i - 1 + k) for k in range(n))).alias("h"), i.alias("i"))))

    def covered(s):
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*(x["i"] + k for k in range(n)))))))

    return _bound(words, lambda w: F.when(F.size(w) >= n, _bound(windows(w), covered)).otherwise(0))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of every text.

    A null text has no words and no lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def repeated_lines(lines):
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counts = _bound(word_list(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    return (docs.withColumn("_counts", counts)
                .withColumn("n_words", F.col("_counts.n").cast("long"))
                .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
                .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
                .withColumn("n_dup_lines", _bound(lines, repeated_lines).cast("long"))
                .withColumn("n_repeat_words", F.col("_counts.repeat").cast("long"))
                .drop("_counts"))


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, n_failed, rate``: failure rates shrunk with a beta prior fitted to all hosts.

    The prior has the mean and the between-host variance of the raw rates
    (weighted by rows, sampling variance taken off); hosts that do not differ
    at all give a prior worth all rows, so every host gets the common rate.
    """
    hosts = cut_lineage(rows.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("hosts"),
                      F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    n, hosts_n = total.n or 0, total.hosts
    mean = (total.k or 0) / n if n else 0.0
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("n_failed") / F.col("n") - mean, 2))).first()[0] or 0.0
    noise = (hosts_n - 1) * mean * (1 - mean)
    room = n - (total.nn or 0) / n if n else 0.0
    between = max(0.0, (spread - noise) / room) if room > 0 else 0.0
    weight = max(0.0, mean * (1 - mean) / between - 1) if between > 0 else float(n)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n") + weight))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the measures, base_failed, the host's shrunk rate and ``kept``.

    A text fails when it has fewer than ``min_words`` words or more than
    ``max_repeat_percent`` of them lie in repeated three-word windows. Failures
    are counted per host (``host_col``; null is a host of its own), shrunk by
    ``host_rates``, and every document of a host above ``max_host_rate`` goes
    with its host. Texts are read once; only the measures travel. Null and empty
    texts have no words and fail. Repeated rows are judged one by one. An empty
    table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = cut_lineage(measures(rows).drop("text").withColumn("base_failed", failed))
    rates = host_rates(rows, "host", "base_failed").select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    return (rows.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
                .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)))
