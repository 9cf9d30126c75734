"""Window helpers. frame_* give a value once one row is in the frame, full_* only when the frame is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP = Window.unboundedPreceding


def symbol_window():
    return Window.partitionBy("symbol").orderBy("timestamp")


def day_window():
    return Window.partitionBy("symbol", "day").orderBy("timestamp")


def frame(agg, col: str | Column, n: int) -> Column:
    """Aggregate of the n rows before this one."""
    return agg(col).over(symbol_window().rowsBetween(-n, -1))


def full(agg, col: str | Column, n: int) -> Column:
    """Aggregate of this row and the n - 1 before it; null until there are n."""
    w = symbol_window().rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == n, agg(col).over(w))


def steps(col: str) -> Column:
    """Bins of a ratio: 2 and more, 1.5, 1, below 0.7, else 0."""
    c = F.col(col)
    return F.when(c >= 2, 3).when(c >= 1.5, 2).when(c >= 1, 1).when(c < 0.7, -1).otherwise(0)


def islands(df: DataFrame, flag: Column, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Numbers runs: a new one begins where flag holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(UP, 0)
    return df.withColumn(name, F.sum(F.when(flag, 1).otherwise(0)).over(w))
