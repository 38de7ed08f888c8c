"""Registry of the checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}
DIGITS = 6


def nudge(digits: int) -> float:
    return 3.1e-2 * 10.0 ** -digits


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and turn NaN into null, so both engines hash alike.

    Means of short decimals often end exactly on a rounding tie, where the
    order of summation decides; a fixed nudge moves ties off the edge.
    """
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c), F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register ``fn(spark, sf_dir)``; ``doubles`` names the columns the oracle rounds."""

    def wrap(fn):
        assert name not in QUERIES, name
        MODULE_OF[name] = fn.__module__
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
        if sql:
            body = sql.strip()
            if doubles:
                swaps = ", ".join(f"round(CAST({d} AS DOUBLE) + {nudge(digits)}, {digits}) + 0.0 AS {d}" for d in doubles.split())
                body = f"SELECT * REPLACE ({swaps}) FROM ({body}) AS q"
            ORACLES[name] = body
        return fn

    return wrap
