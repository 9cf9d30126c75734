"""Replays. The exit of a signal doesn't depend on other signals, so it is a relational range join; only the choice under slots, cooldown or overlap is sequential, over the signals of one symbol."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1)


def exit_sim(signals: DataFrame, bars: DataFrame, hold: int, first: int = 1, flatten: bool = False) -> DataFrame:
    """Adds exit_i, exit_price and reason. signals: signal_id, symbol, i, direction, entry, stop, target; bars: symbol, i, high, low, close (and timestamp, to flatten).

    Looks at bars i + first to i + hold; where stop and target fall in one bar the stop counts. Without either
    the close of the last bar counts, and a signal without a bar has nulls. With flatten a position is closed at
    the last close of its entry day. Signals and bars meet by bins of hold bars, two a signal.
    """
    width = F.lit(max(hold - first + 1, 1))
    bin_ = lambda c: F.floor(c / width)
    s = signals.withColumn("bin", F.explode(F.array_distinct(F.array(bin_(F.col("i") + first), bin_(F.col("i") + hold)))))
    b = bars.select("symbol", F.col("i").alias("bar_i"), "high", "low", "close", bin_(F.col("i")).alias("bin"), *([F.to_date("timestamp").alias("bar_day")] if flatten else []))
    x = s.join(b, ["symbol", "bin"]).where(F.col("bar_i").between(F.col("i") + first, F.col("i") + hold))
    if flatten:
        x = x.join(bars.select("symbol", "i", F.to_date("timestamp").alias("day")), ["symbol", "i"]).where("bar_day = day")
    down = F.when(F.col("direction") == 1, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    up = F.when(F.col("direction") == 1, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    hit = F.when(down, F.struct(F.col("bar_i").alias("exit_i"), F.col("stop").alias("exit_price"), F.lit("stop").alias("reason"))).when(up, F.struct(F.col("bar_i").alias("exit_i"), F.col("target").alias("exit_price"), F.lit("target").alias("reason")))
    time = F.when(F.col("bar_i") < F.col("i") + hold, "date_change").otherwise("time") if flatten else F.lit("time")
    last = F.struct(F.col("bar_i").alias("exit_i"), F.col("close").alias("exit_price"), time.alias("reason"))
    out = x.groupBy("signal_id").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("bar_i"))).alias("h"), F.max_by(last, "bar_i").alias("l"))
    out = out.select("signal_id", F.coalesce("h", "l").alias("e")).select("signal_id", "e.*")
    return signals.join(out, "signal_id", "left")


def select_signals(exits: DataFrame, slots: int = 1, cooldown: int = 0, regime: str | None = None) -> DataFrame:
    """Signals that are entered: at most `slots` open at once, and with a regime at least cooldown bars between its entries.

    One slot is free again after the exit bar; of several, one is free from the exit bar on.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["i", "signal_id"])
        open_, last, keep = [], {}, []
        for row in g.itertuples():
            while open_ and (open_[0] < row.i or (slots > 1 and open_[0] == row.i)):
                heapq.heappop(open_)
            key = getattr(row, regime) if regime else None
            ok = len(open_) < slots and (regime is None or key not in last or row.i - last[key] >= cooldown)
            keep.append(ok)
            if ok:
                heapq.heappush(open_, row.exit_i)
                last[key] = row.i
        return g[keep]

    return exits.where("exit_i IS NOT NULL").groupBy("symbol").applyInPandas(run, exits.schema)


def pivots(bars: DataFrame, left: int = 2, right: int = 2, tolerance: float = 0.0) -> DataFrame:
    """Bars whose high (low) is the only extreme of the bars around them; usable from confirmed_at."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    around = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    full = F.count("*").over(w.rowsBetween(-left, right)) == left + right + 1
    high = F.greatest(*[F.max("high").over(a) for a in around])
    low = F.least(*[F.min("low").over(a) for a in around])
    x = bars.withColumns({"is_high": full & (F.round(F.col("high") - high, 9) > tolerance), "is_low": full & (F.round(low - F.col("low"), 9) > tolerance), "confirmed_at": F.lead("timestamp", right).over(w)})
    return x.where("is_high OR is_low").select("symbol", "timestamp", "high", "low", "is_high", "is_low", "confirmed_at")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Gaps between a bar and the second one before it."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    x = bars.withColumns({"h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w)})
    up, down = F.col("low") > F.col("h2"), F.col("high") < F.col("l2")
    x = x.withColumns({"direction": F.when(up, 1).when(down, -1), "gap_low": F.when(up, F.col("h2")).when(down, F.col("high")), "gap_high": F.when(up, F.col("low")).when(down, F.col("l2"))})
    return x.where("direction IS NOT NULL").select("symbol", "timestamp", "direction", "gap_low", "gap_high")


def sweeps(bars: DataFrame, lookback: int = 20, reclaim: int = 3, buffer: float = 0.25, direction: int = 1) -> DataFrame:
    """Bars that pierce the extreme of the bars before them by more than buffer, and the bar within `reclaim` bars that closes back beyond it.

    direction 1 sweeps lows, -1 highs; extreme is the farthest price from the piercing bar to the reclaiming one.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    side, worst, farther = ("low", F.min, F.least) if direction == 1 else ("high", F.max, F.greatest)
    x = bars.withColumns({"level": worst(side).over(w.rowsBetween(-lookback, -1)), **{f"c{k}": F.lead("close", k).over(w) for k in range(reclaim + 1)}, **{f"x{k}": F.lead(side, k).over(w) for k in range(reclaim + 1)}})
    found = F.lit(None)
    for k in range(reclaim, -1, -1):
        extreme = farther(*[F.col(f"x{j}") for j in range(k + 1)]) if k else F.col("x0")
        found = F.when(F.col(f"c{k}") * direction > F.col("level") * direction, F.struct(F.lit(k).alias("bars_to_reclaim"), extreme.alias("extreme"), F.col(f"c{k}").alias("reclaim_close"))).otherwise(found)
    pierced = F.round((F.col("level") - F.col(side)) * direction, 9) > buffer
    return x.where(pierced).withColumn("found", found).where("found IS NOT NULL").select("symbol", "timestamp", F.lit(direction).alias("direction"), "level", "found.extreme", "found.bars_to_reclaim", "found.reclaim_close")


def equal_pivots(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Pivots whose extreme may be reached by other bars around them too."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    around = w.rowsBetween(-left, right)
    full = F.count("*").over(around) == left + right + 1
    x = bars.withColumns({"is_high": full & (F.col("high") == F.max("high").over(around)), "is_low": full & (F.col("low") == F.min("low").over(around)), "confirmed_at": F.lead("timestamp", right).over(w)})
    return x.where("is_high OR is_low").select("symbol", "timestamp", "high", "low", "is_high", "is_low", "confirmed_at")


def structure_events(bars: DataFrame, left: int = 2, right: int = 2, buffer: float = 0.25, tolerance: float = 0.0) -> DataFrame:
    """Closes beyond the latest unbroken confirmed pivot by more than buffer: BOS with the trend, else CHOCH (the first break too); a pivot breaks once.

    Pivots come from windows; what is sequential is a stack of unbroken pivots for each side, one pass a symbol.
    """
    p = pivots(bars, left, right, tolerance).select("symbol", F.col("confirmed_at").alias("timestamp"), F.when(F.col("is_high"), F.col("high")).alias("top"), F.when(F.col("is_low"), F.col("low")).alias("bottom"), F.col("timestamp").alias("pivot_time"))
    d = bars.select("symbol", "timestamp", "close").join(p, ["symbol", "timestamp"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", ignore_index=True)
        tops, bottoms, trend, out = [], [], 0, []
        for r in g.itertuples():
            if r.top == r.top:
                tops.append((float(r.top), r.pivot_time))
            if r.bottom == r.bottom:
                bottoms.append((float(r.bottom), r.pivot_time))
            if tops and r.close > tops[-1][0] + buffer:
                out.append((r.symbol, r.timestamp, 1, "BOS" if trend == 1 else "CHOCH", *tops.pop()))
                trend = 1
            if bottoms and r.close < bottoms[-1][0] - buffer:
                out.append((r.symbol, r.timestamp, -1, "BOS" if trend == -1 else "CHOCH", *bottoms.pop()))
                trend = -1
        return pd.DataFrame(out, columns=["symbol", "timestamp", "direction", "event", "level", "pivot_time"])

    return d.groupBy("symbol").applyInPandas(run, "symbol string, timestamp timestamp_ntz, direction int, event string, level double, pivot_time timestamp_ntz")


def liquidity_pivots(blocks: DataFrame, marks: DataFrame, clearance: float = 1.0, reach: int = 48) -> DataFrame:
    """The latest pivot after a block's origin and before its event that keeps clear of the block. blocks: symbol, event_i, direction, origin_i, block_low, block_high; marks: symbol, i, high, low, is_high, is_low.

    Blocks and pivots meet by bins of reach bars, the longest way from origin to event.
    """
    bin_ = lambda c: F.floor(F.col(c) / F.lit(reach))
    b = blocks.withColumn("bin", F.explode(F.sequence(bin_("origin_i"), bin_("event_i"))))
    x = b.join(marks.select("symbol", "i", "high", "low", "is_high", "is_low", bin_("i").alias("bin")), ["symbol", "bin"]).where("origin_i < i AND i < event_i")
    clear = F.when(F.col("direction") == 1, F.col("is_low") & (F.col("low") > F.col("block_high") + clearance)).otherwise(F.col("is_high") & (F.col("high") < F.col("block_low") - clearance))
    price = F.when(F.col("direction") == 1, F.col("low")).otherwise(F.col("high"))
    found = x.where(clear).groupBy("symbol", "event_i", "direction").agg(F.max("i").alias("pivot_i"), F.max_by(price, "i").alias("pivot_price"))
    return blocks.join(found, ["symbol", "event_i", "direction"], "left")
