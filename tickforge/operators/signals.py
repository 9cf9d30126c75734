"""Signals of strategy families as columns: 1 to go long, -1 to go short, 0 otherwise. Windows run by symbol in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import UP, day_window, full, symbol_window
from .features import ema_features


def _sides(long: Column, short: Column, direction: str = "long_short") -> Column:
    none = F.lit(False)
    return F.when(long if direction != "short" else none, 1).when(short if direction != "long" else none, -1).otherwise(0)


def _before(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(symbol_window())


def trend_pullback(bars: DataFrame, fast: int = 9, slow: int = 21, direction: str = "long_short") -> DataFrame:
    """The close comes back through the fast EMA on the side of the trend."""
    d = bars.join(ema_features(bars, fast, slow).select("symbol", "timestamp", "ema_fast", "ema_slow"), ["symbol", "timestamp"])
    was = _before("close") - _before("ema_fast")
    up = (F.col("ema_fast") > F.col("ema_slow")) & (was < 0) & (F.col("close") >= F.col("ema_fast"))
    down = (F.col("ema_fast") < F.col("ema_slow")) & (was > 0) & (F.col("close") <= F.col("ema_fast"))
    return d.withColumn("signal", _sides(up, down, direction))


def mean_reversion(bars: DataFrame, window: int = 20, threshold: float = 1.5, direction: str = "long_short") -> DataFrame:
    """The close is so many standard deviations from the mean of a full window that holds it."""
    sd = full(F.stddev_pop, "close", window)
    z = F.round(F.when(sd > 0, (F.col("close") - full(F.avg, "close", window)) / sd).when(sd.isNotNull(), 0.0), 9)
    return bars.withColumn("z", z).withColumn("signal", _sides(F.col("z") <= -threshold, F.col("z") >= threshold, direction))


def volatility_expansion(bars: DataFrame, window: int = 5, multiple: float = 1.5, direction: str = "long_short") -> DataFrame:
    """A bar's range is a multiple of the mean range of the full window before it, and it closes beyond the bar before."""
    d = bars.withColumn("rng", F.col("high") - F.col("low"))
    d = d.withColumn("mean_range", full(F.avg, "rng", window))
    wide = F.round(F.col("rng") - _before("mean_range") * multiple, 9) >= 0
    return d.withColumn("signal", _sides(wide & (F.col("close") > _before("high")), wide & (F.col("close") < _before("low")), direction))


def intraday_momentum(bars: DataFrame, lookback: int = 3, threshold: float = 1.0, direction: str = "long_short") -> DataFrame:
    """The close has moved by points since a bar of the same day so many bars ago."""
    move = F.round(F.col("close") - F.lag("close", lookback).over(day_window()), 9)
    return bars.withColumn("day", F.to_date("timestamp")).withColumn("signal", _sides(move >= threshold, move <= -threshold, direction))


def time_of_day(bars: DataFrame, minute: int, side: int) -> DataFrame:
    """Every bar from a minute of the day on; a runner with one trade a day takes the first."""
    return bars.withColumn("signal", F.when(F.hour("timestamp") * 60 + F.minute("timestamp") >= minute, side).otherwise(0))


def opening_gap(bars: DataFrame, first: int, threshold: float = 1.0, mode: str = "fade", direction: str = "long_short") -> DataFrame:
    """The first bar of a day's session opens away from the close of the bar before; fade goes against the gap, continuation with it."""
    if mode not in ("fade", "continuation"):
        raise ValueError("mode must be fade or continuation")
    d = bars.withColumn("day", F.to_date("timestamp")).withColumn("prior_close", _before("close"))
    inside = F.hour("timestamp") * 60 + F.minute("timestamp") >= first
    opens = inside & (F.sum(inside.cast("int")).over(day_window().rowsBetween(UP, 0)) == 1)
    gap = F.round(F.col("open") - F.col("prior_close"), 9)
    up, down = opens & (gap >= threshold) & (gap > 0), opens & (gap <= -threshold) & (gap < 0)
    return d.withColumn("signal", _sides(down, up, direction) if mode == "fade" else _sides(up, down, direction))


def micro_entries(quotes: DataFrame, *, most_spread: float, least_depth: float, imbalance: float, fast: int, slow: int, move: float, mode: str = "continuation") -> DataFrame:
    """Quotes with a narrow spread, depth on both sides, and imbalance and mid moves over two numbers of rows that agree; reversal goes against them."""
    w = Window.partitionBy("symbol", F.to_date("timestamp")).orderBy("timestamp", "seq")
    total = F.col("bid_size") + F.col("ask_size")
    lean = F.when(total > 0, (F.col("bid_size") - F.col("ask_size")) / total).otherwise(0.0)
    moved = lambda k: F.round(F.col("mid") - F.lag("mid", k).over(w), 9)
    good = (F.col("spread") <= most_spread) & (F.least("bid_size", "ask_size") >= least_depth)
    up = good & (lean >= imbalance) & (moved(fast) >= move) & (moved(slow) >= move)
    down = good & (lean <= -imbalance) & (moved(fast) <= -move) & (moved(slow) <= -move)
    sign = 1 if mode == "continuation" else -1
    return quotes.withColumn("signal", _sides(up, down) * sign)


def last_bar(features: DataFrame, least_bars: int = 200) -> DataFrame:
    """The latest bar of each symbol that has a full history."""
    w = Window.partitionBy("symbol")
    d = features.withColumns({"n_bars": F.count("*").over(w), "latest": F.max("timestamp").over(w)})
    return d.where((F.col("timestamp") == F.col("latest")) & (F.col("n_bars") >= least_bars)).drop("n_bars", "latest")
