"""Bars from ticks and from bars, by one shuffle each with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str | Column, minutes: int) -> Column:
    """Start of the bucket of a time; minutes divides a day."""
    return F.window(ts, f"{minutes} minutes").start


def tick_bars(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """OHLC of mid, last bid and ask, count, size sums and mean spread for each symbol and bucket; ties of time go by seq."""
    at = F.struct("timestamp", "seq")
    return ticks.groupBy("symbol", bucket("timestamp", minutes).alias("bar")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"),
        F.max_by("bid", at).alias("bid_close"), F.max_by("ask", at).alias("ask_close"), F.count("*").cast("int").alias("tick_count"),
        F.sum("bid_size").alias("bid_size_sum"), F.sum("ask_size").alias("ask_size_sum"), F.avg("spread").alias("avg_spread")).withColumnRenamed("bar", "timestamp")


def rebucket(bars: DataFrame, minutes: int, label: str = "left") -> DataFrame:
    """Coarser bars; the mean spread is weighted by ticks, null without any. label: the bucket's start or its end."""
    w = F.window("timestamp", f"{minutes} minutes")
    out = bars.groupBy("symbol", w.alias("w")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
        F.sum("tick_count").cast("int").alias("tick_count"), F.expr("sum(avg_spread * tick_count) / nullif(sum(tick_count), 0)").alias("avg_spread"))
    return out.select("symbol", (F.col("w.start") if label == "left" else F.col("w.end")).alias("timestamp"), "open", "high", "low", "close", "tick_count", "avg_spread")


def quote_bars(quotes: DataFrame, minutes: int) -> DataFrame:
    """Bid, ask and mid extremes, mean spread and imbalance, least sizes and count of positive, uncrossed quotes."""
    at = F.struct("timestamp", "seq")
    q = quotes.where("bid > 0 AND ask > 0 AND ask >= bid")
    return q.groupBy("symbol", bucket("timestamp", minutes).alias("bar")).agg(
        F.min_by("bid", at).alias("bid_open"), F.max("bid").alias("bid_high"), F.min("bid").alias("bid_low"), F.max_by("bid", at).alias("bid_close"),
        F.min_by("ask", at).alias("ask_open"), F.max("ask").alias("ask_high"), F.min("ask").alias("ask_low"), F.max_by("ask", at).alias("ask_close"),
        F.avg("spread").alias("avg_spread"), F.min("bid_size").alias("min_bid_size"), F.min("ask_size").alias("min_ask_size"),
        F.avg(F.expr("(bid_size - ask_size) / (bid_size + ask_size)")).alias("avg_imbalance"), F.count("*").alias("quote_count")).withColumnRenamed("bar", "timestamp")


def session_days(bars: DataFrame, first_minute: int, last_minute: int, least_bars: int) -> DataFrame:
    """Daily bars of a session; days with too few bars are left out."""
    m = F.hour("timestamp") * 60 + F.minute("timestamp")
    out = bars.where(m.between(first_minute, last_minute)).groupBy("symbol", F.to_date("timestamp").alias("day")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.count("*").alias("bars"))
    return out.where(F.col("bars") >= least_bars)


def active_contract(rows: DataFrame) -> DataFrame:
    """For each day the contract of most rows, then of the largest size, then the first by name."""
    n = rows.groupBy("day", "contract").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    best = F.max_by(F.struct("contract", "n", "total"), F.struct("n", "total", (-F.col("contract")).alias("o")))
    return n.groupBy("day").agg(best.alias("b")).select("day", "b.contract", "b.n", "b.total")


def last_per_second(quotes: DataFrame, seconds: int = 1) -> DataFrame:
    """The last quote of each symbol and step of seconds."""
    step = F.window("timestamp", f"{seconds} seconds").start
    row = F.max_by(F.struct("timestamp", "bid", "ask", "seq"), F.struct("timestamp", "seq"))
    return quotes.groupBy("symbol", step.alias("step")).agg(row.alias("q")).select("symbol", "step", "q.*")


def uncross(quotes: DataFrame) -> DataFrame:
    """Swaps bid and ask, with their sizes, where they are crossed."""
    crossed = F.col("bid") > F.col("ask")
    pick = lambda a, b: F.when(crossed, F.col(b)).otherwise(F.col(a))
    return quotes.select("symbol", "timestamp", "seq", pick("bid", "ask").alias("bid"), pick("ask", "bid").alias("ask"), pick("bid_size", "ask_size").alias("bid_size"), pick("ask_size", "bid_size").alias("ask_size"))
