"""Bar features: the SQL-frame table and the full-window catalogue, each one window pass over (symbol, day)."""

from __future__ import annotations

import bisect

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import UP, day_window, frame, full, steps, symbol_window


def prior_day(bars: DataFrame) -> DataFrame:
    """Adds the levels of the trading day before, from a frame of days: no join, and nothing is done for levels that aren't used."""
    d = bars.withColumn("day_number", F.dense_rank().over(Window.partitionBy("symbol").orderBy("day")))
    before = Window.partitionBy("symbol").orderBy("day_number").rangeBetween(-1, -1)
    return d.withColumns({"prior_day_high": F.max("high").over(before), "prior_day_low": F.min("low").over(before), "prior_day_close": F.max_by("close", "timestamp").over(before)}).drop("day_number")


def frame_features(bars: DataFrame, opening: tuple[int, int] = (0, 179), zone: str | None = None) -> DataFrame:
    """Features whose frames end before the current bar and may be partly filled; days and minutes are those of a zone, as the bars' times are UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("timestamp")) if zone else F.col("timestamp")
    d = bars.withColumn("day", F.to_date(local)).withColumn("minute", F.hour(local) * 60 + F.minute(local)).withColumn("dow", F.dayofweek(local) - 1)
    d = d.withColumn("ret1", F.col("close") - F.lag("close").over(symbol_window())).withColumn("rng", F.col("high") - F.col("low"))
    weight = F.greatest("tick_count", F.lit(1))
    inside = F.col("minute").between(*opening)
    before = day_window().rowsBetween(UP, -1)
    d = d.withColumns({
        **{f"ret{k}": F.col("close") - F.lag("close", k).over(symbol_window()) for k in (3, 5, 15)},
        **{f"prev_{c}": F.lag(c).over(symbol_window()) for c in ("open", "high", "low", "close")},
        **{f"ma{n}": frame(F.avg, "close", n) for n in (9, 20, 50, 200)}, **{f"std{n}": frame(F.stddev_pop, "close", n) for n in (20, 50)},
        **{f"high{n}_prev": frame(F.max, "high", n) for n in (20, 60)}, **{f"low{n}_prev": frame(F.min, "low", n) for n in (20, 60)},
        **{f"range{n}": frame(F.avg, "rng", n) for n in (20, 60)}, **{f"vol{n}": frame(F.avg, "tick_count", n) for n in (20, 50)},
        "gain14": frame(F.avg, F.greatest("ret1", F.lit(0.0)), 14), "loss14": frame(F.avg, F.greatest(-F.col("ret1"), F.lit(0.0)), 14),
        "session_vwap": F.sum(F.expr("(high + low + close) / 3") * weight).over(day_window().rowsBetween(UP, 0)) / F.sum(weight).over(day_window().rowsBetween(UP, 0)),
        "session_high_prev": F.max("high").over(before), "session_low_prev": F.min("low").over(before), "session_open": F.first("open").over(day_window().rowsBetween(UP, 0)),
        "opening_high_prev": F.max(F.when(inside, F.col("high"))).over(before), "opening_low_prev": F.min(F.when(inside, F.col("low"))).over(before)})
    d = prior_day(d)
    ratio = lambda a, b, other: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(other))
    d = d.withColumns({
        "volume_ratio": ratio("tick_count", "vol50", 1.0), "range_ratio": ratio("rng", "range20", 1.0), "vwap_dist": F.col("close") - F.col("session_vwap"),
        "z20": F.when(F.col("std20") > 0, (F.col("close") - F.col("ma20")) / F.col("std20")).otherwise(0.0), "z50": F.when(F.col("std50") > 0, (F.col("close") - F.col("ma50")) / F.col("std50")).otherwise(0.0),
        "body_to_range": F.when(F.col("rng") > 0, (F.col("close") - F.col("open")) / F.col("rng")).otherwise(0.0), "close_location": F.when(F.col("rng") > 0, (F.col("close") - F.col("low")) / F.col("rng")).otherwise(0.5),
        "trend_bin": F.when(F.col("close") > F.col("ma50"), 1).otherwise(-1),
        "rsi14": F.when(F.col("loss14") > 0, 100 - 100 / (1 + F.col("gain14") / F.col("loss14"))).when(F.col("gain14") > 0, 100.0).otherwise(50.0),
        "stoch20": F.when(F.col("high20_prev") > F.col("low20_prev"), (F.col("close") - F.col("low20_prev")) / (F.col("high20_prev") - F.col("low20_prev"))).otherwise(0.5)})
    d = d.withColumns({"volume_bin": steps("volume_ratio"), "range_bin": steps("range_ratio"), "prev_vwap_dist": F.lag("vwap_dist").over(symbol_window())})
    bucket = F.when(F.col("minute") < 480, "night").when(F.col("minute") < 960, "day").otherwise("evening")
    return d.withColumn("session_bucket", bucket)


def session_percentile(bars: DataFrame, value: str, least: int) -> DataFrame:
    """(symbol, timestamp, share): the share of a day's values so far that don't exceed a bar's own; null before so many bars.

    A task holds one day of a symbol, whose bars are put into a sorted list one after the other.
    """
    def run(day: pa.Table) -> pa.Table:
        day = day.sort_by("timestamp")
        seen, share = [], []
        for k, x in enumerate(day["x"].to_pylist(), 1):
            if x is not None:
                bisect.insort(seen, x)
            share.append(bisect.bisect_right(seen, x) / k if k >= least and x is not None else None)
        return pa.Table.from_arrays([day["symbol"], day["timestamp"], pa.array(share, pa.float64())], names=["symbol", "timestamp", "share"])

    d = bars.select("symbol", F.to_date("timestamp").alias("day"), "timestamp", F.col(value).cast("double").alias("x"))
    return d.groupBy("symbol", "day").applyInArrow(run, f"symbol string, timestamp {dict(bars.dtypes)['timestamp']}, share double")


def full_features(bars: DataFrame) -> DataFrame:
    """Features that are null until their window, which holds the current bar, is full."""
    d = bars.withColumn("day", F.to_date("timestamp")).withColumn("v", F.greatest("tick_count", F.lit(0)).cast("double")).withColumn("rng", F.col("high") - F.col("low"))
    prev = F.lag("close").over(symbol_window())
    d = d.withColumns({"tr": F.when(prev.isNull(), F.col("rng")).otherwise(F.greatest("rng", F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))), "diff1": F.coalesce(F.col("close") - prev, F.lit(0.0)), "prev_high": F.lag("high").over(symbol_window()), "prev_low": F.lag("low").over(symbol_window())})
    ranges = F.collect_list("rng").over(symbol_window().rowsBetween(-19, 0))
    share = lambda values, col: F.size(F.filter(values, lambda x: x <= F.col(col))) / F.size(values)
    d = d.withColumns({
        "atr_14": full(F.avg, "tr", 14), "realized_volatility_20": full(F.stddev_pop, "diff1", 20), "range_percentile_20": F.when(F.size(ranges) == 20, share(ranges, "rng")),
        "volume_ma_5": full(F.avg, "v", 5), "volume_ma_20": full(F.avg, "v", 20), "sum5": full(F.sum, "v", 5), "sum15": full(F.sum, "v", 15),
        "return_5m": F.col("close") - F.lag("close", 5).over(symbol_window())})
    ranks = session_percentile(d, "v", 5).withColumnRenamed("share", "volume_percentile_session")
    d = d.join(ranks, ["symbol", "timestamp"], "left")
    d = d.withColumns({"relative_volume_5": F.when(F.col("volume_ma_5") > 0, F.col("v") / F.col("volume_ma_5")), "relative_volume_20": F.when(F.col("volume_ma_20") > 0, F.col("v") / F.col("volume_ma_20")),
                       "atr_mean_20": F.when(F.row_number().over(symbol_window()) > 20, F.avg("atr_14").over(symbol_window().rowsBetween(-20, -1))), "sum5_mean": F.avg("sum5").over(symbol_window().rowsBetween(-20, -1)), "sum15_mean": F.avg("sum15").over(symbol_window().rowsBetween(-20, -1))})
    spike = F.col("relative_volume_20") >= 2
    return d.withColumns({
        "volume_spike_flag": F.when(spike, 1.0).otherwise(0.0), "low_volume_filter": F.when(F.col("relative_volume_20") < 0.5, 1.0).otherwise(0.0),
        "volume_price_confirm": F.when(spike, F.coalesce(F.signum("return_5m"), F.lit(0.0))).otherwise(0.0),
        "volatility_compression": F.when(F.col("atr_mean_20").isNotNull() & F.col("atr_14").isNotNull(), F.when(F.col("atr_14") < F.col("atr_mean_20"), 1.0).otherwise(0.0)),
        "breakout_failure_flag": F.when((F.col("high") > F.col("prev_high")) & (F.col("close") < F.col("prev_high")), -1.0).when((F.col("low") < F.col("prev_low")) & (F.col("close") > F.col("prev_low")), 1.0).otherwise(0.0),
        "inside_bar": F.when((F.col("high") <= F.col("prev_high")) & (F.col("low") >= F.col("prev_low")), 1.0).otherwise(0.0), "outside_bar": F.when((F.col("high") >= F.col("prev_high")) & (F.col("low") <= F.col("prev_low")), 1.0).otherwise(0.0),
        "upper_shadow": F.when(F.col("rng") > 0, (F.col("high") - F.greatest("open", "close")) / F.col("rng")).otherwise(0.0), "lower_shadow": F.when(F.col("rng") > 0, (F.least("open", "close") - F.col("low")) / F.col("rng")).otherwise(0.0),
        "multi_timeframe_volume_confirm": F.when((F.col("relative_volume_5") >= 1.5) & (F.col("sum5") >= 1.2 * F.col("sum5_mean")) & (F.col("sum15") >= 1.1 * F.col("sum15_mean")), 1.0).otherwise(0.0)})


#: Bars of a symbol and day whose EMA is one prefix sum: few enough that powers of the decay stay in range.
EMA_RUN = 512


def ema_features(bars: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    """EMA pair (seeded with the first value, never reset), its slope, age of the trend within the day and depth of a pullback.

    An EMA is a linear recurrence: inside a run of bars it is a prefix sum plus the value before the run, decayed,
    and runs compose to a value and a factor each. So bars stay in windows of a symbol and day, and only one row a
    run goes through the sequential pass.
    """
    gains = {"fast": 2 / (fast + 1), "slow": 2 / (slow + 1)}
    d = bars.select("symbol", "timestamp", "close").withColumn("day", F.to_date("timestamp"))
    k = F.row_number().over(day_window()) - 1
    d = d.withColumns({"run": F.floor(k / EMA_RUN), "j": k % EMA_RUN + 1})
    w = Window.partitionBy("symbol", "day", "run").orderBy("timestamp").rowsBetween(UP, 0)
    d = d.withColumns({f"part_{n}": F.pow(F.lit(1 - a), F.col("j")) * a * F.sum(F.col("close") * F.pow(F.lit(1 - a), -F.col("j"))).over(w) for n, a in gains.items()})
    runs = d.groupBy("symbol", "day", "run").agg(F.count("*").alias("n"), F.min_by("close", "timestamp").alias("first"), *[F.max_by(f"part_{n}", "timestamp").alias(f"end_{n}") for n in gains])

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["day", "run"])
        value, before, out = {n: float(g["first"].iloc[0]) for n in gains}, 0, []
        for r in g.itertuples():
            out.append((r.symbol, r.day, r.run, before, value["fast"], value["slow"]))
            value = {n: getattr(r, f"end_{n}") + (1 - a) ** r.n * value[n] for n, a in gains.items()}
            before += r.n
        return pd.DataFrame(out, columns=["symbol", "day", "run", "before", "from_fast", "from_slow"])

    starts = runs.groupBy("symbol").applyInPandas(carry, "symbol string, day date, run long, before long, from_fast double, from_slow double")
    d = d.join(starts, ["symbol", "day", "run"])
    at = F.col("before") + F.col("j")
    value = lambda n: F.col(f"part_{n}") + F.pow(F.lit(1 - gains[n]), F.col("j")) * F.col(f"from_{n}")
    d = d.withColumns({"ema_fast": F.when(at >= fast, value("fast")), "ema_slow": F.when(at >= slow, value("slow")), "ema_slope": F.when(at > fast, gains["fast"] / (1 - gains["fast"]) * (F.col("close") - value("fast")))})
    d = d.withColumn("ema_spread", F.col("ema_fast") - F.col("ema_slow")).withColumn("sign", F.coalesce(F.signum("ema_spread"), F.lit(0.0)))
    # runs of one sign; bars without a sign have age 0 and don't end a run
    last = F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(day_window().rowsBetween(UP, -1))
    d = d.withColumn("flip", F.when((F.col("sign") != 0) & ~F.col("sign").eqNullSafe(last), 1).otherwise(0))
    d = d.withColumn("trend", F.sum("flip").over(day_window().rowsBetween(UP, 0)))
    age = F.sum(F.when(F.col("sign") != 0, 1).otherwise(0)).over(Window.partitionBy("symbol", "day", "trend").orderBy("timestamp").rowsBetween(UP, 0))
    d = d.withColumns({"trend_age": F.when(F.col("sign") != 0, age).otherwise(0).cast("double"), "pullback_depth": F.when(F.col("ema_fast").isNotNull(), F.greatest((F.col("ema_fast") - F.col("close")) * F.col("sign"), F.lit(0.0)))})
    return d.select("symbol", "timestamp", "ema_fast", "ema_slow", "ema_spread", "ema_slope", "trend_age", "pullback_depth")


def session_features(bars: DataFrame, first: int, last: int, tick: float = 0.25, opening: int = 30) -> DataFrame:
    """Distances to levels of the session, of the day before and of the opening minutes, clock distances, spread in ticks, bodies and wicks, z-score and absorption.

    first and last are the session's first and last minute of the day. Levels of the session and of the opening
    hold the current bar.
    """
    d = full_features(bars).withColumn("minute", F.hour("timestamp") * 60 + F.minute("timestamp"))
    here = day_window().rowsBetween(UP, 0)
    inside = (F.col("minute") - first).between(0, opening - 1)
    levels = {"session_high": F.max("high").over(here), "session_low": F.min("low").over(here), "opening_range_high": F.max(F.when(inside, F.col("high"))).over(here), "opening_range_low": F.min(F.when(inside, F.col("low"))).over(here)}
    d = prior_day(d).withColumns(levels)
    body, rng = F.col("close") - F.col("open"), F.col("high") - F.col("low")
    share = lambda c: F.when(rng > 0, c / rng).otherwise(0.0)
    mean, sd = full(F.avg, "close", 20), full(F.stddev_pop, "close", 20)
    weak = (F.col("relative_volume_20") >= 2) & F.col("atr_14").isNotNull() & (F.abs(body) <= F.greatest(F.col("atr_14") * 0.15, F.lit(tick)))
    return d.withColumns({
        **{f"{n}_dist": F.col("close") - F.col(n) for n in [*levels, "prior_day_high", "prior_day_low"]},
        "minutes_since_open": (F.col("minute") - first).cast("double"), "minutes_to_close": (last - F.col("minute")).cast("double"), "spread_ticks": F.coalesce("avg_spread", F.lit(0.0)) / tick,
        "bar_body_ratio": share(F.abs(body)), "signed_body_ratio": share(body), "close_zscore_20": F.when(sd > 0, (F.col("close") - mean) / sd).when(sd.isNotNull(), 0.0),
        "volume_absorption_flag": F.when(weak, F.when(body >= 0, -1.0).otherwise(1.0)).otherwise(0.0), "bar_volume": F.col("v"), "tick_count_1m": F.col("v"), "return_1m": F.col("close") - F.lag("close").over(symbol_window()), "return_15m": F.col("close") - F.lag("close", 15).over(symbol_window())})
