"""Bar and tick strategies whose state runs from row to row: one group for each symbol and day (or symbol), rows sorted inside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADES = "symbol string, side string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, contracts int, gross_pnl double, net_pnl double, entry_reason string, exit_reason string"
NAMES = [c.split()[0] for c in TRADES.split(", ")]


def close_trade(symbol, side, entry, exit_, reasons, costs: dict, contracts: int = 1) -> tuple:
    """A trade with its profit: move by point value, less fees and two slips of a side. entry, exit_: (time, price)."""
    sign = 1 if side == "long" else -1
    gross = (exit_[1] - entry[1]) * sign * costs["point_value"] * contracts
    cost = (costs["fees"] + 2 * costs["slippage_ticks"] * costs["tick_size"] * costs["point_value"]) * contracts
    return symbol, side, entry[0], exit_[0], entry[1], exit_[1], contracts, gross, gross - cost, *reasons


COSTS = {"tick_size": 0.25, "point_value": 20.0, "fees": 5.0, "slippage_ticks": 1}


def signal_bars(bars: DataFrame, signal: Column, stop: float | Column, target: float | Column, hold: int, per_day: int = 1, costs: dict = COSTS, session: tuple[int, int, int] = (0, 1439, 1439), contracts: int = 1) -> DataFrame:
    """One position at a time within a day: entered at the side's close of a signal bar (1 long, -1 short), tested from the next bar on for stop, target, hold and the flatten time, closed at the day's last bar.

    session: first and last minute of the day in which a position may be opened, and the minute from which one is
    closed; later bars don't count. bars: symbol, timestamp, high, low, close, bid_close, ask_close. The signal and
    distances are columns, so they stay in the JVM; only the choice of trades is a pass over the day.
    """
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    minute = F.hour("timestamp") * 60 + F.minute("timestamp")
    d = bars.select("symbol", F.to_date("timestamp").alias("day"), "timestamp", minute.alias("minute"), "high", "low", "close", "bid_close", "ask_close", F.coalesce(signal.cast("int"), F.lit(0)).alias("signal"), as_col(stop).alias("stop"), as_col(target).alias("target"))
    first, last, flatten = session
    d = d.where(F.col("minute").between(first, flatten))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, held, n, r = [], None, 0, None
        for k, r in enumerate(g.sort_values("timestamp").itertuples()):
            if held:
                side, entry, low, high, at = held
                long = side == "long"
                away = r.bid_close if long else r.ask_close
                down, up = r.low <= low, r.high >= high
                hit = None
                if down if long else up:
                    hit = (low if long else high), "stop_loss"
                elif up if long else down:
                    hit = (high if long else low), "take_profit"
                elif k - at >= hold:
                    hit = away, "max_hold"
                elif flatten < 1439 and r.minute >= flatten:
                    hit = away, "flatten"
                if hit:
                    out.append(close_trade(r.symbol, side, entry, (r.timestamp, float(hit[0])), ("signal", hit[1]), costs, contracts))
                    held = None
            elif r.signal and n < per_day and r.minute <= last:
                side, price = ("long", r.ask_close) if r.signal > 0 else ("short", r.bid_close)
                low, high = (price - r.stop, price + r.target) if r.signal > 0 else (price - r.target, price + r.stop)
                held, n = (side, (r.timestamp, float(price)), low, high, k), n + 1
        if held:
            out.append(close_trade(r.symbol, held[0], held[1], (r.timestamp, float(r.bid_close if held[0] == "long" else r.ask_close)), ("signal", "end_of_data"), costs, contracts))
        return pd.DataFrame(out, columns=NAMES)

    return d.groupBy("symbol", "day").applyInPandas(run, TRADES)


def grammar_batch(features: DataFrame, specs: list[dict], hold: int, per_day: int = 1) -> DataFrame:
    """Trades of many predicate specifications in one job: spec (name), and the columns of a trade.

    specs: name, entry, side, stop, target. Signals of all of them are one array of columns; specifications that agree
    in all but the name run once.
    """
    from ..functions.grammar import compile_node
    from .variants import stable_hash

    once: dict[str, dict] = {}
    for s in specs:
        once.setdefault(stable_hash({k: v for k, v in s.items() if k != "name"}), s)
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.when(compile_node(s["entry"], features.columns), 1 if s.get("side", "long") == "long" else -1).otherwise(0).alias("signal"), F.lit(float(s["stop"])).alias("s"), F.lit(float(s["target"])).alias("t")) for h, s in once.items()])
    d = features.withColumn("x", F.explode(rows)).select(F.concat_ws("|", "symbol", "x.h").alias("symbol"), "timestamp", "high", "low", "close", "bid_close", "ask_close", "x.signal", "x.s", "x.t")
    out = signal_bars(d, F.col("signal"), F.col("s"), F.col("t"), hold, per_day)
    names = features.sparkSession.createDataFrame([(s["name"], stable_hash({k: v for k, v in s.items() if k != "name"})) for s in specs], "spec string, h string")
    out = out.withColumns({"h": F.substring_index("symbol", "|", -1), "symbol": F.substring_index("symbol", "|", 1)})
    return out.join(names, "h").drop("h")


def opening_range(bars: DataFrame, first: int, stop: float, target: float, hold: int = 10_000, costs: dict = COSTS) -> DataFrame:
    """Breakout of the extremes of a day's first bars."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", F.to_date("timestamp")).orderBy("timestamp")
    d = bars.withColumn("k", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"top": F.max(F.when(F.col("k") <= first, F.col("high"))).over(before), "bottom": F.min(F.when(F.col("k") <= first, F.col("low"))).over(before)})
    signal = F.when((F.col("k") > first) & (F.col("close") > F.col("top")), 1).when((F.col("k") > first) & (F.col("close") < F.col("bottom")), -1).otherwise(0)
    return signal_bars(d, signal, stop, target, hold, 1, costs)


def _align(price: float, tick: float, up: bool) -> float:
    n = price / tick
    whole = round(n)
    if abs(n - whole) < 1e-9:
        return whole * tick
    return (int(n // 1) + (1 if up else 0)) * tick


def tick_replay(ticks: DataFrame, opening_minutes: int, stop: float, target: float, costs: dict = COSTS) -> DataFrame:
    """Breakout on the mid of a day's opening minutes; filled on the next tick at the aligned ask (bid), exits on the bid (ask)."""
    d = ticks.select("symbol", F.to_date("timestamp").alias("day"), "timestamp", "bid", "ask", "mid", "seq")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["timestamp", "seq"])
        end = g["timestamp"].iloc[0] + pd.Timedelta(minutes=opening_minutes)
        first = g[g["timestamp"] < end]
        top, bottom, tick = first["mid"].max(), first["mid"].min(), costs["tick_size"]
        side, held = None, None
        for r in g[g["timestamp"] >= end].itertuples():
            if held:
                long = held[0] == "long"
                price = r.bid if long else r.ask
                move = (price - held[1][1]) * (1 if long else -1)
                if move <= -stop or move >= target:
                    trade = close_trade(r.symbol, held[0], held[1], (r.timestamp, _align(price, tick, not long)), ("breakout", "stop_loss" if move < 0 else "take_profit"), costs)
                    return pd.DataFrame([trade], columns=NAMES)
            elif side:
                held = side, (r.timestamp, _align(r.ask if side == "long" else r.bid, tick, side == "long"))
            elif r.mid > top:
                side = "long"
            elif r.mid < bottom:
                side = "short"
        if held:
            price = r.bid if held[0] == "long" else r.ask
            return pd.DataFrame([close_trade(r.symbol, held[0], held[1], (r.timestamp, _align(price, tick, held[0] == "short")), ("breakout", "flatten"), costs)], columns=NAMES)
        return pd.DataFrame([], columns=NAMES)

    return d.groupBy("symbol", "day").applyInPandas(run, TRADES)


def event_blocks(bars: DataFrame, events: DataFrame, least: int = 1, most: int = 10_000, tick: float = 0.25, reach: int = 64) -> DataFrame:
    """The last bar against the direction from an event's pivot to the event itself, if its height in ticks lies within bounds.

    bars: symbol, timestamp, open, high, low, close; events: symbol, timestamp, direction, pivot_time. A block reaches from
    the extreme of the bar to the far end of its body. Events meet bars by bins of reach bars from pivot to event.
    """
    from .replay import indexed

    b = indexed(bars).select("symbol", "timestamp", "i", "open", "high", "low", "close")
    at = b.select("symbol", "timestamp", "i")
    e = events.join(at.withColumnRenamed("i", "event_i"), ["symbol", "timestamp"]).join(at.select("symbol", F.col("timestamp").alias("pivot_time"), F.col("i").alias("pivot_i")), ["symbol", "pivot_time"])
    bin_ = lambda c: F.floor(F.col(c) / F.lit(reach))
    x = e.select("symbol", "event_i", "pivot_i", "direction", F.explode(F.sequence(bin_("pivot_i"), bin_("event_i"))).alias("bin")).join(b.withColumn("bin", bin_("i")).drop("timestamp"), ["symbol", "bin"])
    against = F.when(F.col("direction") == 1, F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open"))
    bar = F.max_by(F.struct("open", "high", "low", "close"), "i").alias("b")
    x = x.where(F.col("i").between(F.col("pivot_i"), F.col("event_i")) & against).groupBy("symbol", "event_i", "direction").agg(F.max("i").alias("origin_i"), bar)
    low = F.when(F.col("direction") == 1, F.col("b.low")).otherwise(F.least("b.open", "b.close"))
    high = F.when(F.col("direction") == 1, F.greatest("b.open", "b.close")).otherwise(F.col("b.high"))
    x = x.select("symbol", "event_i", "direction", "origin_i", low.alias("block_low"), high.alias("block_high"))
    return x.where(F.bround((F.col("block_high") - F.col("block_low")) / tick).between(least, most))


def order_blocks(bars: DataFrame, events: DataFrame, lookback: int = 12) -> DataFrame:
    """The last bar against the direction before each structure event (symbol, timestamp, direction), with its bounds; through equal (symbol, index) only."""
    from .replay import indexed

    b = indexed(bars)
    e = events.join(b.select("symbol", "timestamp", F.col("i").alias("event_i")), ["symbol", "timestamp"])
    x = e.withColumn("i", F.explode(F.sequence(F.col("event_i") - lookback, F.col("event_i") - 1)))
    x = x.join(b.select("symbol", "i", "open", "high", "low", "close"), ["symbol", "i"]).where(F.when(F.col("direction") == 1, F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open")))
    return x.groupBy("symbol", "event_i", "direction").agg(F.max("i").alias("origin_i"), F.max_by("low", "i").alias("block_low"), F.max_by("high", "i").alias("block_high"))


def block_status(blocks: DataFrame, bars: DataFrame, horizon: int = 48) -> DataFrame:
    """First bar after the event that touches a block and first that closes beyond it, within a horizon."""
    from .replay import indexed

    b = indexed(bars).select("symbol", "i", "high", "low", "close")
    x = blocks.withColumn("i", F.explode(F.sequence(F.col("event_i") + 1, F.col("event_i") + horizon))).join(b, ["symbol", "i"])
    touch = F.when(F.col("direction") == 1, F.col("low") <= F.col("block_high")).otherwise(F.col("high") >= F.col("block_low"))
    broke = F.when(F.col("direction") == 1, F.col("close") < F.col("block_low")).otherwise(F.col("close") > F.col("block_high"))
    out = x.groupBy("symbol", "event_i", "direction").agg(F.min(F.when(touch, F.col("i"))).alias("mitigated_i"), F.min(F.when(broke, F.col("i"))).alias("invalidated_i"))
    return blocks.join(out, ["symbol", "event_i", "direction"], "left")
