"""The first later row that reaches a level, found over blocks of rows with their extremes; brackets and gates built on it.

Rows of a key are numbered. WIDTH rows make a block, WIDTH blocks a block of the next level, and so on; a block is one row
with an array of its parts, each with least and greatest values. A search looks at the rest of its own block, then at the
blocks after it one level up, and so on until a block is sure to hold a row that fits, then goes down to that row.
So it is a join with one block for each level up and down, however far away the row is, and no row is exploded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 64


class Passage:
    """An index of rows (keys, i, and columns of which a search needs the least or the greatest); i counts from 0 in each key."""

    def __init__(self, rows: DataFrame, keys: list[str], mins: list[str], maxs: list[str], longest: int | None = None):
        self.keys, self.mins, self.maxs = keys, mins, maxs
        names = [*mins, *maxs]
        if longest is None:
            longest = (rows.agg(F.max("i")).first()[0] or 0) + 1
        depth = max(1, math.ceil(math.log(max(2, longest), WIDTH) - 1e-9))
        parts = rows.select(*keys, F.col("i").cast("long").alias("i"), *names)
        self.levels = []
        for _ in range(depth):
            item = F.struct("i", *names)
            level = parts.groupBy(*keys, F.floor(F.col("i") / WIDTH).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
            self.levels.append(level)
            least = [F.array_min(F.expr(f"transform(items, x -> x.{c})")).alias(c) for c in mins]
            most = [F.array_max(F.expr(f"transform(items, x -> x.{c})")).alias(c) for c in maxs]
            parts = level.select(*keys, F.col("block").alias("i"), *least, *most)

    def first(self, searches: DataFrame, start: str, fits: str) -> DataFrame:
        """searches with `found`, the first row from number `start` on that fits, as a struct, or null.

        fits is an SQL condition on x and on columns of searches, made by OR of `x.least <= value` and `x.greatest >= value`
        (with AND where both parts are such and hold for one row whenever they hold for a block), so that it holds for a
        block only if it holds for one of its rows.
        """
        names = searches.columns
        item = "struct<i: bigint" + "".join(f", {c}: {dict(self.levels[0].selectExpr('inline(items)').dtypes)[c]}" for c in [*self.mins, *self.maxs]) + ">"
        q = searches.select(*names, F.col(start).cast("long").alias("_at"), F.lit(-1).alias("_level"), F.lit(None).cast(item).alias("_found"))
        for k, level in enumerate(self.levels):
            x = self._met(q, F.floor(F.col("_at") / WIDTH), level)
            part = F.expr(f"get(filter(_items, x -> x.i >= _at AND ({fits})), 0)")
            now = (F.col("_level") < 0) & F.col("_part").isNotNull()
            x = x.withColumn("_part", part)
            q = x.select(*names, F.when(F.col("_level") < 0, F.floor(F.col("_at") / WIDTH) + 1).otherwise(F.col("_at")).alias("_at"),
                         F.when(now, k).otherwise(F.col("_level")).alias("_level"), F.when(now, F.col("_part")).otherwise(F.col("_found")).alias("_found"))
        for k in range(len(self.levels) - 1, 0, -1):
            down = F.col("_level") == k
            x = self._met(q, F.when(down, F.col("_found.i")).otherwise(-1 - F.col("_at")), self.levels[k - 1])
            part = F.expr(f"get(filter(_items, x -> {fits}), 0)")
            q = x.select(*names, "_at", F.when(down, k - 1).otherwise(F.col("_level")).alias("_level"), F.when(down, part).otherwise(F.col("_found")).alias("_found"))
        return q.select(*names, F.col("_found").alias("found"))

    def _met(self, q: DataFrame, block, level: DataFrame) -> DataFrame:
        held = level.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col("block").alias("_block"), F.col("items").alias("_items"))
        at = [F.col(k) == F.col(f"_{k}") for k in self.keys]
        q = q.withColumn("_want", block)
        return q.join(held, [*at, F.col("_want") == F.col("_block")], "left").drop("_want", "_block", *(f"_{k}" for k in self.keys))


def numbered(rows: DataFrame, *order: str, keys: list[str]) -> DataFrame:
    """i, from 0 in each key. A key holds what one task may sort: a symbol's bars, a day's quotes."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


#: Columns that brackets need of rows: what a long position is closed at (bid) and a short one (ask).
SIDES = ["bid_low", "ask_low", "bid_close", "ask_close"], ["bid_high", "ask_high", "at"]


def bracket_exits(entries: DataFrame, rows: DataFrame, keys: list[str], time_first: bool, longest: int | None = None) -> DataFrame:
    """entries with exit_i, exit_price and reason (stop, target, time), or nulls if the key's rows end before.

    entries: keys, direction, first_i (the first row that is tested), stop, target and until; rows: keys, i, SIDES, at. The stop counts where
    both are reached. The row with at >= until is the last: tested for stop and target first, or not at all with time_first.
    """
    index = Passage(rows, keys, *SIDES, longest)
    fits = "direction = 1 AND (x.bid_low <= stop OR x.bid_high >= target) OR direction = -1 AND (x.ask_high >= stop OR x.ask_low <= target) OR x.at >= until"
    x = index.first(entries, "first_i", fits)
    f = lambda c: F.col(f"found.{c}")
    long = F.col("direction") == 1
    late = f("at") >= F.col("until")
    stop = F.when(long, f("bid_low") <= F.col("stop")).otherwise(f("ask_high") >= F.col("stop"))
    target = F.when(long, f("bid_high") >= F.col("target")).otherwise(f("ask_low") <= F.col("target"))
    reason = F.when(late, "time") if time_first else F
    reason = reason.when(stop, "stop").when(target, "target").when(late, "time")
    x = x.withColumns({"exit_i": f("i"), "reason": reason})
    price = F.when(F.col("reason") == "stop", F.col("stop")).when(F.col("reason") == "target", F.col("target")).when(F.col("reason") == "time", F.when(long, f("bid_close")).otherwise(f("ask_close")))
    return x.withColumn("exit_price", price).drop("found")


def _days(rows: DataFrame, first: bool) -> DataFrame:
    """For each symbol and day the first row of the next day, or the last row of the day with whether it is the symbol's last day."""
    w = Window.partitionBy("symbol").orderBy("day")
    pick = (F.min_by if first else F.max_by)(F.struct("i", "timestamp", "bid_close", "ask_close"), "i")
    days = rows.groupBy("symbol", "day").agg(pick.alias("edge"))
    if first:
        return days.select("symbol", "day", F.lead("edge").over(w).alias("edge"))
    return days.select("symbol", "day", "edge", F.lead("day").over(w).isNull().alias("last_day"))


def _priced(entries: DataFrame, points, reward: float) -> DataFrame:
    d = F.col("direction")
    return entries.withColumns({"stop": F.col("entry") - d * points, "target": F.col("entry") + d * points * reward})


def quote_brackets(signals: DataFrame, quotes: DataFrame, stop_points: float, reward: float, hold_seconds: int) -> DataFrame:
    """signals (symbol, timestamp, seq, direction) entered at their own quote's side: entry, exit_time, exit_price, reason.

    The next quote is the first that is tested; the first quote after the hold or of a later day closes at its side, before any
    test. Signals without a later quote are left out. quotes: symbol, timestamp, seq, bid, ask.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    q = quotes.withColumns({"day": F.to_date("timestamp"), "at": micros})
    q = numbered(q, "timestamp", "seq", keys=["symbol", "day"]).withColumns({f"{s}_{k}": F.col(s) for s in ("bid", "ask") for k in ("low", "high", "close")})
    e = signals.select("symbol", "timestamp", "seq", "direction").join(q.select("symbol", "timestamp", "seq", "day", "i", "at", "bid", "ask"), ["symbol", "timestamp", "seq"])
    e = e.withColumns({"entry": F.when(F.col("direction") == 1, F.col("ask")).otherwise(F.col("bid")), "first_i": F.col("i") + 1, "until": F.col("at") + F.lit(hold_seconds * 1_000_000 + 1)})
    e = _priced(e, F.lit(stop_points), reward).drop("at", "bid", "ask")
    x = bracket_exits(e, q, ["symbol", "day"], True)
    x = x.join(q.select("symbol", "day", F.col("i").alias("exit_i"), F.col("timestamp").alias("exit_time")), ["symbol", "day", "exit_i"], "left").join(_days(q, True), ["symbol", "day"], "left")
    side = F.when(F.col("direction") == 1, F.col("edge.bid_close")).otherwise(F.col("edge.ask_close"))
    out = x.select("symbol", "timestamp", "seq", "direction", "entry", F.coalesce("exit_time", "edge.timestamp").alias("exit_time"), F.when(F.col("reason").isNull(), side).otherwise(F.col("exit_price")).alias("exit_price"),
                   F.coalesce("reason", F.lit("time")).alias("reason"))
    return out.where("exit_time IS NOT NULL")


def minute_brackets(signals: DataFrame, bars: DataFrame, stop_points: float, reward: float, hold: int) -> DataFrame:
    """signals (symbol, timestamp, direction) entered at the open of their own bar's side: entry, exit_time, exit_price, reason.

    The entry bar is tested too. After hold bars the position is closed at that bar's close; at the end of its day (reason date) at the day's
    last close, and at the end of all bars by time. bars: symbol, timestamp, bid and ask open, high, low, close.
    """
    return _minute_brackets(signals.select("symbol", "timestamp", "direction"), bars, F.lit(stop_points), F.lit(reward), F.lit(hold), [])


def _minute_brackets(signals: DataFrame, bars: DataFrame, stop_points, reward, hold, keep: list[str]) -> DataFrame:
    b = numbered(bars.withColumn("day", F.to_date("timestamp")), "timestamp", keys=["symbol", "day"]).withColumn("at", F.col("i"))
    e = signals.join(b.select("symbol", "timestamp", "day", "i", "bid_open", "ask_open"), ["symbol", "timestamp"])
    e = e.withColumns({"entry": F.when(F.col("direction") == 1, F.col("ask_open")).otherwise(F.col("bid_open")), "first_i": F.col("i"), "until": F.col("i") + hold})
    x = bracket_exits(_priced(e, stop_points, reward), b, ["symbol", "day"], False, longest=1440)
    x = x.join(b.select("symbol", "day", F.col("i").alias("exit_i"), F.col("timestamp").alias("exit_time")), ["symbol", "day", "exit_i"], "left").join(_days(b, False), ["symbol", "day"])
    none = F.col("reason").isNull()
    side = F.when(F.col("direction") == 1, F.col("edge.bid_close")).otherwise(F.col("edge.ask_close"))
    return x.select(*keep, "symbol", "timestamp", "direction", "entry", F.when(none, F.col("edge.timestamp")).otherwise(F.col("exit_time")).alias("exit_time"), F.when(none, side).otherwise(F.col("exit_price")).alias("exit_price"),
                    F.when(none, F.when(F.col("last_day"), "time").otherwise("date")).otherwise(F.col("reason")).alias("reason"))


def bracket_sweep(signals: DataFrame, bars: DataFrame, specs: list[dict], round_trip: float = 0.0) -> DataFrame:
    """Results of a grid of brackets over all signals: name, stop, reward, hold, trades, wins, net, gross_win, gross_loss, stops, targets, and the rank by net.

    specs (name, stop, reward, hold) are a list that the caller holds; each signal is taken with each of them, and all go through one index
    of the bars. Results are whole micro-points before they are added, so sums don't depend on the order of rows.
    """
    grid = F.array(*(F.struct(F.lit(s["name"]).alias("name"), F.lit(float(s["stop"])).alias("stop_points"), F.lit(float(s["reward"])).alias("reward"), F.lit(int(s["hold"])).alias("hold")) for s in specs))
    s = signals.select("symbol", "timestamp", "direction", F.explode(grid).alias("g")).select("symbol", "timestamp", "direction", "g.*")
    keep = ["name", "stop_points", "reward", "hold"]
    x = _minute_brackets(s, bars, F.col("stop_points"), F.col("reward"), F.col("hold"), keep)
    p = F.round(((F.col("exit_price") - F.col("entry")) * F.col("direction") - round_trip) * 1_000_000).cast("long")
    total = lambda c: F.sum(c) / F.lit(1e6)
    out = x.withColumn("p", p).groupBy(*keep).agg(F.count("*").alias("trades"), F.count_if(F.col("p") > 0).alias("wins"), total("p").alias("net"), total(F.greatest("p", F.lit(0))).alias("gross_win"), total(F.greatest(-F.col("p"), F.lit(0))).alias("gross_loss"),
                                                  F.count_if(F.col("reason") == "stop").alias("stops"), F.count_if(F.col("reason") == "target").alias("targets"))
    rank = F.row_number().over(Window.orderBy(F.desc("net"), "name"))  # a row for each of specs
    return out.withColumn("rank", rank).withColumnRenamed("stop_points", "stop")


def atr_brackets(signals: DataFrame, bars: DataFrame, atr_multiple: float, reward: float, hold: int, tick: float = 0.25, ticks: tuple[float, float] = (8, 400), length: int = 20) -> DataFrame:
    """signals (symbol, timestamp, direction) entered at the open of their own bar, with a stop of atr_multiple mean true ranges between ticks[0] and ticks[1] ticks: entry, stop, exit_time, exit_price, reason.

    The mean is over up to `length` bars that end with the entry bar and have one before. The entry bar is tested too; after hold bars, or at the last bar, the position is closed at the close.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = bars.select("symbol", "timestamp", "open", "high", "low", "close", F.when(before.isNotNull(), true_range).alias("tr"))
    b = numbered(b.withColumn("atr", F.coalesce(F.round(F.avg("tr").over(w.rowsBetween(1 - length, 0)), 9), F.lit(0.0))), "timestamp", keys=["symbol"])
    b = b.withColumns({"at": F.col("i"), **{f"{s}_{k}": F.col(k) for s in ("bid", "ask") for k in ("low", "high", "close")}})
    ends = b.groupBy("symbol").agg(F.max("i").alias("last_i"))
    e = signals.select("symbol", "timestamp", "direction").join(b.select("symbol", "timestamp", "i", F.col("open").alias("entry"), "atr"), ["symbol", "timestamp"]).join(ends, "symbol")
    points = F.least(F.greatest(F.col("atr") * atr_multiple / tick, F.lit(float(ticks[0]))), F.lit(float(ticks[1]))) * tick
    e = _priced(e.withColumns({"first_i": F.col("i"), "until": F.least(F.col("i") + hold, F.col("last_i"))}), points, reward)
    x = bracket_exits(e, b, ["symbol"], False)
    return x.join(b.select("symbol", F.col("i").alias("exit_i"), F.col("timestamp").alias("exit_time")), ["symbol", "exit_i"]).select("symbol", "timestamp", "direction", "entry", "stop", "exit_time", "exit_price", "reason")


def gap_fills(gaps: DataFrame, bars: DataFrame) -> DataFrame:
    """Fair-value gaps (symbol, timestamp, direction, gap_low, gap_high) with filled_at, the first later bar that trades through the whole gap, however much later; null if none does."""
    b = numbered(bars.select("symbol", "timestamp", "high", "low"), "timestamp", keys=["symbol"])
    s = gaps.join(b.select("symbol", "timestamp", (F.col("i") + 1).alias("from_i")), ["symbol", "timestamp"])
    x = Passage(b, ["symbol"], ["low"], ["high"]).first(s, "from_i", "direction = 1 AND x.low <= gap_low OR direction = -1 AND x.high >= gap_high")
    return _timed(x, b, "filled_at", gaps.columns)


def level_takes(pivots: DataFrame, bars: DataFrame, buffer: float = 0.0) -> DataFrame:
    """A row for each pivot and side (symbol, timestamp, confirmed_at, side, level) with taken_at, the first bar from its confirmation on that trades beyond its level by more than buffer."""
    b = numbered(bars.select("symbol", "timestamp", "high", "low"), "timestamp", keys=["symbol"])
    sides = F.explode(F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit(1).alias("side"), F.col("high").alias("level"))), F.when(F.col("is_low"), F.struct(F.lit(-1).alias("side"), F.col("low").alias("level"))))))
    p = pivots.where("confirmed_at IS NOT NULL").select("symbol", "timestamp", "confirmed_at", sides.alias("p")).select("symbol", "timestamp", "confirmed_at", "p.side", "p.level")
    s = p.join(b.select("symbol", F.col("timestamp").alias("confirmed_at"), F.col("i").alias("from_i")), ["symbol", "confirmed_at"])
    x = Passage(b, ["symbol"], ["low"], ["high"]).first(s.withColumn("beyond", F.col("level") + F.col("side") * F.lit(buffer)), "from_i", "side = 1 AND x.high > beyond OR side = -1 AND x.low < beyond")
    return _timed(x, b, "taken_at", p.columns)


def _timed(x: DataFrame, bars: DataFrame, name: str, columns: list[str]) -> DataFrame:
    at = bars.select("symbol", F.col("i").alias("_i"), F.col("timestamp").alias(name))
    return x.withColumn("_i", F.col("found.i")).join(at, ["symbol", "_i"], "left").select(*columns, name)


def retest_gates(bars: DataFrame, pivots: DataFrame, lookback: int = 40, right: int = 2, buffer: float = 0.0) -> DataFrame:
    """For each bar whether it passes the gates of a retest: sweep_low, sweep_high, gap_up, gap_down.

    Lows are swept if the lowest low of the last `lookback` bars and this one is at or below the floor by buffer; the floor is the highest of the
    confirmed low pivots within lookback but the last one, or the last one if there are no others; null before the first. Highs likewise. pivots: symbol, timestamp, high, low, is_high, is_low, confirmed `right` bars later.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    marks = pivots.select("symbol", "timestamp", F.when(F.col("is_low"), F.col("low")).alias("bottom"), F.when(F.col("is_high"), F.col("high")).alias("top"))
    x = numbered(bars.select("symbol", "timestamp", "high", "low"), "timestamp", keys=["symbol"]).join(marks, ["symbol", "timestamp"], "left")
    seen, near, here = w.rowsBetween(Window.unboundedPreceding, -right), w.rowsBetween(-lookback, -right), w.rowsBetween(-lookback, 0)
    for c in ("bottom", "top"):
        held = F.when(F.col(c).isNotNull(), F.struct("i", F.col(c).alias("price")))
        x = x.withColumns({f"last_{c}": F.last(held, ignorenulls=True).over(seen), f"near_{c}": F.collect_list(held).over(near)})
    others = lambda c, pick: pick(F.expr(f"transform(filter(near_{c}, p -> p.i < last_{c}.i), p -> p.price)"))
    floor, ceiling = F.coalesce(others("bottom", F.array_max), F.col("last_bottom.price")), F.coalesce(others("top", F.array_min), F.col("last_top.price"))
    return x.select("symbol", "timestamp", (F.min("low").over(here) <= floor - buffer).alias("sweep_low"), (F.max("high").over(here) >= ceiling + buffer).alias("sweep_high"),
                    F.coalesce(F.col("low") > F.lag("high", 2).over(w), F.lit(False)).alias("gap_up"), F.coalesce(F.col("high") < F.lag("low", 2).over(w), F.lit(False)).alias("gap_down"))
