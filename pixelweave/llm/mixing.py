"""Mixing sources to target weights: a token budget handed down a tree, and seeded epochs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.rules import word_list
from pixelweave.session import cut_lineage

#: Hex digits of the order hash that name a bucket of a leaf: 65 536 buckets.
BUCKET_DIGITS = 4
#: Stands for null in the tree.
NO_VALUE = "\x00"


def _pour(children: DataFrame, parent: list[str]) -> DataFrame:
    """``given`` of the children (``name, cap, weight, amount``) of each parent, whose tokens are ``amount``.

    Children get shares in proportion to their weights. A child that holds less
    than its share gives all it has, and its siblings share the rest. Children
    fill in the order of cap / weight, so the first that does not fill sets the
    level for itself and all after it. Whole numbers throughout; shares are
    rounded down.
    """
    order = Window.partitionBy(*parent).orderBy("need", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (children.withColumn("need", F.col("cap") / F.col("weight"))
                    .withColumn("left", F.col("amount") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                    .withColumn("open", F.sum("weight").over(onward))
                    .withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight")))
    level = F.min(F.when(~F.col("full"), F.struct("need", "name", "left", "open"))).over(Window.partitionBy(*parent))
    return (rows.withColumn("level", level)
                .withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(level.left * weight) div level.open")))
                .select(*children.columns, "given"))


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict], budget_percent: int, epochs: int) -> DataFrame:
    """Budget of every leaf (``levels..., tokens``), from the root down: ``levels..., tokens, given``.

    A leaf can give ``epochs`` times its tokens, an inner node what its leaves
    can. The root hands out ``budget_percent`` of all tokens, or what all leaves
    can give if that is less. What a node cannot use goes to its siblings, since
    their parent keeps its amount; only what a whole subtree cannot use moves on
    to the parent's siblings. ``weights`` maps a level to {value: whole weight};
    other values weigh 1, and a weight of 0 takes a subtree out.
    """
    def weight(level):
        out = F.lit(1)
        for value, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == value, w).otherwise(out)
        return out.cast("long")

    for level in levels:
        leaves = leaves.filter(weight(level) > 0)
    leaves = cut_lineage(leaves.filter("tokens > 0"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    amounts = leaves.select(F.lit(0).alias("root"), F.lit(min(total * budget_percent // 100, total * epochs)).alias("given")).distinct()
    for depth, level in enumerate(levels):
        path = ["root", *levels[:depth]]
        children = (leaves.withColumn("root", F.lit(0)).groupBy(*path, level).agg((F.sum("tokens") * epochs).alias("cap"))
                          .withColumn("weight", weight(level)).withColumn("name", F.col(level))
                          .join(amounts.withColumnRenamed("given", "amount"), path))
        amounts = _pour(children, path).select(*path, level, "given")
    return leaves.join(amounts, levels).select(*levels, "tokens", "given")


def mix(docs: DataFrame, levels: list[str], *, weights: dict[str, dict] | None = None, budget_percent: int = 50, epochs: int = 2,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, <levels>, tokens, copies``: the documents of the mixture and how often each is taken.

    Tokens are words. Every leaf of the tree ``levels`` (columns of ``docs``,
    read as text) gets its budget from ``allocate`` and is filled from seeded
    epochs: an epoch is the leaf's documents in the order of md5(seed:epoch:id);
    whole epochs are taken while they fit, and of the next one the longest
    prefix that fits. copies is the number of epochs that hold the document;
    documents in none are left out.

    The prefix of a leaf needs no ordered pass over the leaf: token totals of
    16^BUCKET_DIGITS hash buckets say in which bucket it ends, and only that one
    is ordered. Null and empty texts have no tokens and are left out. A null
    level value is a node of its own. Rows with one id stand in one place of the
    order and are taken together or not at all; a null id counts as ''. An empty
    table gives no rows. Other columns are not read.
    """
    keys = [f"_k{i}" for i in range(len(levels))]
    given = {k: (weights or {}).get(c, {}) for c, k in zip(levels, keys, strict=True)}
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)).alias(k) for c, k in zip(levels, keys, strict=True)),
        F.size(word_list(F.col(text_col))).cast("long").alias("tokens")).filter("tokens > 0"))
    leaves = rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    budget = cut_lineage(allocate(leaves, keys, given, budget_percent, epochs).select(
        *keys, F.expr("given div tokens").alias("whole"), F.expr("given % tokens").alias("part")))

    order = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = rows.join(budget, keys).withColumn("place", order).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    ends = (dealt.filter("part > 0").groupBy(*keys, "part", "bucket").agg(F.sum("tokens").alias("n"))
                 .withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))).filter("upto > part")
                 .groupBy(*keys).agg(F.min(F.struct("bucket", F.expr("part - upto + n").alias("room"))).alias("end"))
                 .select(*keys, "end.*"))
    last = (dealt.join(ends, [*keys, "bucket"])
                 .withColumn("upto", F.sum("tokens").over(Window.partitionBy(*keys, "bucket").orderBy("place"))).filter("upto <= room")
                 .groupBy(*keys).agg(F.max("place").alias("last")))
    # a place in an earlier bucket is less than the bucket's digits, and one in this bucket greater
    bounds = ends.join(last, keys, "left").select(*keys, F.coalesce("last", "bucket").alias("bound"))
    taken = dealt.join(bounds, keys, "left").withColumn(
        "copies", F.col("whole") + F.coalesce(F.col("place") <= F.col("bound"), F.lit(False)).cast("long"))
    return taken.filter("copies > 0").select(
        "doc_id", *(F.when(F.col(k) != NO_VALUE, F.col(k)).alias(c) for c, k in zip(levels, keys, strict=True)), "tokens", "copies")
