"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tick_quality(ticks: DataFrame, spread_limit: float, jump_limit: float) -> DataFrame:
    """Counts of duplicates, bad prices, wide spreads and jumps for each symbol."""
    # a task holds a day of a symbol at most; days are joined at their edges
    w = Window.partitionBy("symbol", "day").orderBy("timestamp", "seq")
    at = F.struct("timestamp", "seq")
    x = ticks.withColumn("day", F.to_date("timestamp"))
    x = x.withColumns({"move": F.abs(F.col("mid") - F.lag("mid").over(w)), "again": (F.col("timestamp") == F.lag("timestamp").over(w)).cast("int")})
    days = x.groupBy("symbol", "day").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.sum("again").alias("again"), F.count_if(F.expr("bid <= 0 OR ask <= 0")).alias("bad"), F.count_if(F.expr("ask < bid")).alias("crossed"),
        F.sum("spread").alias("spread"), F.count("spread").alias("spreads"), F.max("spread").alias("most"), F.count_if(F.col("spread") > spread_limit).alias("wide"), F.count_if(F.col("move") > jump_limit).alias("jumps"), F.min_by("mid", at).alias("opens"), F.max_by("mid", at).alias("ends"))
    edge = F.abs(F.col("opens") - F.lag("ends").over(Window.partitionBy("symbol").orderBy("day")))
    return days.withColumn("edge", (edge > jump_limit).cast("int")).groupBy("symbol").agg(
        F.sum("n").alias("n_rows"), F.min("a").alias("first_time"), F.max("b").alias("last_time"), F.coalesce(F.sum("again"), F.lit(0)).alias("duplicates"), F.sum("bad").alias("non_positive"), F.sum("crossed").alias("crossed"),
        (F.sum("spread") / F.sum("spreads")).alias("mean_spread"), F.max("most").alias("max_spread"), F.sum("wide").alias("wide"), (F.sum("jumps") + F.coalesce(F.sum("edge"), F.lit(0))).alias("jumps"))


def bar_quality(bars: DataFrame, minutes: int, jump_limit: float) -> DataFrame:
    """Counts of gaps inside days, invalid OHLC and jumps for each symbol."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    x = bars.withColumn("prev", F.lag("timestamp").over(w)).withColumn("move", F.abs(F.col("close") - F.lag("close").over(w)))
    gap = (F.to_date("prev") == F.to_date("timestamp")) & (F.col("timestamp") > F.col("prev") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return x.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if(gap).alias("gaps"), F.count_if(F.expr("high < greatest(open, close, low) OR low > least(open, close, high)")).alias("invalid"),
        F.count_if(F.expr("least(open, high, low, close) <= 0")).alias("non_positive"), F.count_if(F.col("move") > jump_limit).alias("jumps"), F.avg("avg_spread").alias("mean_spread"))


def duplicate_excess(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("excess"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def quote_coverage(quotes: DataFrame) -> DataFrame:
    """Per day: count, first and last time, mean spread, negative spreads, duplicate times."""
    return quotes.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n_rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.avg("spread").alias("mean_spread"),
        F.count_if(F.col("spread") < 0).alias("negative"), (F.count("*") - F.count_distinct("timestamp")).alias("duplicates"))


def missing_partitions(expected: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Keys that are expected and not there."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
