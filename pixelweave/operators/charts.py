"""Table views behind charts: row filters, orderings, sorted pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_query(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a SQL condition over the columns holds."""
    return df.where(F.expr(expression))


def table_sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def line_sort(df: DataFrame, x: str, y: str) -> DataFrame:
    """Finite (x, y) pairs in x order."""
    def finite(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return df.where(finite(x) & finite(y)).select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy("x", "y")
