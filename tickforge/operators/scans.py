"""Signal scans: families of predicates, as data, evaluated in one pass over the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name -> (long condition, short condition): fixed definitions of the scans. None: no such side.
SET_A = {
    "breakout_continuation": ("close > high20_prev AND trend_bin = 1 AND volume_bin >= 1", "close < low20_prev AND trend_bin = -1 AND volume_bin >= 1"),
    "opening_range_breakout": ("minute >= 180 AND close > opening_high_prev AND trend_bin = 1 AND volume_bin >= 1", "minute >= 180 AND close < opening_low_prev AND trend_bin = -1 AND volume_bin >= 1"),
    "failed_breakout_reversion": ("low < low20_prev AND close > low20_prev AND z50 <= -1.0 AND abs(body_to_range) <= 0.45", "high > high20_prev AND close < high20_prev AND z50 >= 1.0 AND abs(body_to_range) <= 0.45"),
    "vwap_reclaim_continuation": ("prev_vwap_dist < 0 AND vwap_dist >= 0 AND trend_bin = 1 AND volume_bin >= 0 AND ret1 > 0", "prev_vwap_dist > 0 AND vwap_dist <= 0 AND trend_bin = -1 AND volume_bin >= 0 AND ret1 < 0"),
    "outside_bar_momentum": ("high >= prev_high AND low <= prev_low AND body_to_range >= 0.55 AND close > open AND volume_bin >= 1", "high >= prev_high AND low <= prev_low AND body_to_range <= -0.55 AND close < open AND volume_bin >= 1"),
    "range_expansion_continuation": ("body_to_range >= 0.6 AND range_bin >= 2 AND volume_bin >= 1", "body_to_range <= -0.6 AND range_bin >= 2 AND volume_bin >= 1"),
    "trend_pullback_reclaim": ("trend_bin = 1 AND ret5 < 0 AND ret1 > 0 AND close > ma20", "trend_bin = -1 AND ret5 > 0 AND ret1 < 0 AND close < ma20"),
    "zscore_mean_reversion": ("z50 <= -2 AND volume_bin <= 1", "z50 >= 2 AND volume_bin <= 1"),
    "volume_climax_reversion": ("z50 <= -1.5 AND volume_bin >= 2 AND abs(body_to_range) <= 0.35", "z50 >= 1.5 AND volume_bin >= 2 AND abs(body_to_range) <= 0.35"),
    "session_extreme_reversion": ("close <= session_low_prev + 0.1 * range20 AND z50 <= -1.25 AND volume_bin <= 1 AND abs(body_to_range) <= 0.45", "close >= session_high_prev - 0.1 * range20 AND z50 >= 1.25 AND volume_bin <= 1 AND abs(body_to_range) <= 0.45"),
    "low_volume_drift": ("trend_bin = 1 AND volume_bin = -1 AND ret1 > 0", "trend_bin = -1 AND volume_bin = -1 AND ret1 < 0"),
}
SET_B = {
    "opening_range_breakout": ("minute BETWEEN 600 AND 959 AND close > opening_high_prev AND trend_bin = 1 AND volume_bin >= 0", "minute BETWEEN 600 AND 959 AND close < opening_low_prev AND trend_bin = -1 AND volume_bin >= 0"),
    "opening_range_retest_reclaim": ("minute BETWEEN 600 AND 959 AND close > opening_high_prev AND low <= opening_high_prev + 0.25 * range20 AND close_location >= 0.6 AND trend_bin = 1", "minute BETWEEN 600 AND 959 AND close < opening_low_prev AND high >= opening_low_prev - 0.25 * range20 AND close_location <= 0.4 AND trend_bin = -1"),
    "vwap_reclaim_continuation": SET_A["vwap_reclaim_continuation"],
    "vwap_pullback_bounce": ("close > session_vwap AND low <= session_vwap + 0.2 * range20 AND close_location >= 0.65 AND trend_bin = 1", "close < session_vwap AND high >= session_vwap - 0.2 * range20 AND close_location <= 0.35 AND trend_bin = -1"),
    "high_volume_impulse_continuation": ("ret3 >= 0.75 * range20 AND close_location >= 0.65 AND volume_ratio >= 1.35 AND trend_bin = 1", "ret3 <= -0.75 * range20 AND close_location <= 0.35 AND volume_ratio >= 1.35 AND trend_bin = -1"),
    "range_expansion_continuation": ("body_to_range >= 0.6 AND range_bin >= 2 AND volume_bin >= 0 AND trend_bin = 1", "body_to_range <= -0.6 AND range_bin >= 2 AND volume_bin >= 0 AND trend_bin = -1"),
    "donchian20_breakout": ("close > high20_prev AND volume_bin >= 0 AND trend_bin = 1", "close < low20_prev AND volume_bin >= 0 AND trend_bin = -1"),
    "prior_day_breakout": ("close > prior_day_high AND volume_bin >= 0 AND trend_bin = 1", "close < prior_day_low AND volume_bin >= 0 AND trend_bin = -1"),
    "prior_day_rejection": ("low < prior_day_low AND close > prior_day_low AND z50 <= -0.75", "high > prior_day_high AND close < prior_day_high AND z50 >= 0.75"),
    "selling_absorption_reversal": ("volume_ratio >= 1.6 AND ret5 < 0 AND close_location >= 0.65 AND body_to_range >= 0 AND z50 <= -0.5", None),
    "buying_absorption_reversal": (None, "volume_ratio >= 1.6 AND ret5 > 0 AND close_location <= 0.35 AND body_to_range <= 0 AND z50 >= 0.5"),
    "trend_pullback_reclaim": SET_A["trend_pullback_reclaim"],
    "low_volume_drift": SET_A["low_volume_drift"],
    "session_extreme_reversion": ("close <= session_low_prev + 0.1 * range20 AND z50 <= -1.0 AND volume_bin <= 1", "close >= session_high_prev - 0.1 * range20 AND z50 >= 1.0 AND volume_bin <= 1"),
    "rsi_extreme_reversal": ("rsi14 <= 28 AND z20 <= -0.75 AND close_location >= 0.55 AND volume_bin <= 2", "rsi14 >= 72 AND z20 >= 0.75 AND close_location <= 0.45 AND volume_bin <= 2"),
    "stoch_extreme_reversal": ("stoch20 <= 0.15 AND close_location >= 0.6 AND z50 <= -0.35", "stoch20 >= 0.85 AND close_location <= 0.4 AND z50 >= 0.35"),
    "ma_reacceleration": ("ma9 > ma20 AND ma20 > ma50 AND prev_close <= ma9 AND close > ma9 AND ret1 > 0 AND volume_bin >= 0", "ma9 < ma20 AND ma20 < ma50 AND prev_close >= ma9 AND close < ma9 AND ret1 < 0 AND volume_bin >= 0"),
    "prior_close_reclaim": ("prev_close < prior_day_close AND close >= prior_day_close AND close > session_vwap AND volume_bin >= 0", "prev_close > prior_day_close AND close <= prior_day_close AND close < session_vwap AND volume_bin >= 0"),
    "midday_zscore_reversion": ("minute BETWEEN 720 AND 899 AND z20 <= -1.25 AND close_location >= 0.6 AND volume_bin <= 1", "minute BETWEEN 720 AND 899 AND z20 >= 1.25 AND close_location <= 0.4 AND volume_bin <= 1"),
    "closing_drive_continuation": ("minute BETWEEN 900 AND 1019 AND close > session_vwap AND ret15 > 0.5 * range60 AND close_location >= 0.6 AND volume_bin >= 0", "minute BETWEEN 900 AND 1019 AND close < session_vwap AND ret15 < -0.5 * range60 AND close_location <= 0.4 AND volume_bin >= 0"),
}
SET_C = {
    "candle_momentum_40": ("body_to_range >= 0.4 AND close > open AND ret1 > 0", "body_to_range <= -0.4 AND close < open AND ret1 < 0"),
    "candle_momentum_60": ("body_to_range >= 0.6 AND close > open AND ret1 > 0", "body_to_range <= -0.6 AND close < open AND ret1 < 0"),
    "impulse_continuation_1": ("ret1 >= 0.35 * range20 AND close_location >= 0.65", "ret1 <= -0.35 * range20 AND close_location <= 0.35"),
    "impulse_continuation_3": ("ret3 >= 0.75 * range20 AND ret1 > 0 AND close_location >= 0.6", "ret3 <= -0.75 * range20 AND ret1 < 0 AND close_location <= 0.4"),
    "impulse_reversal_5": ("ret5 <= -1.25 * range20 AND close_location >= 0.65 AND body_to_range > 0", "ret5 >= 1.25 * range20 AND close_location <= 0.35 AND body_to_range < 0"),
    "trend_pullback_reclaim": SET_A["trend_pullback_reclaim"],
    "ma50_stretch_reversion": ("z50 <= -1.25 AND close_location >= 0.55", "z50 >= 1.25 AND close_location <= 0.45"),
    "bollinger20_reversion": ("z20 <= -1.75 AND close_location >= 0.5", "z20 >= 1.75 AND close_location <= 0.5"),
    "vwap_side_continuation": ("close > session_vwap AND ret1 > 0 AND trend_bin = 1", "close < session_vwap AND ret1 < 0 AND trend_bin = -1"),
    "vwap_reclaim_continuation": ("prev_vwap_dist < 0 AND vwap_dist >= 0 AND ret1 > 0", "prev_vwap_dist > 0 AND vwap_dist <= 0 AND ret1 < 0"),
    "donchian20_breakout": ("close > high20_prev AND volume_bin >= 0", "close < low20_prev AND volume_bin >= 0"),
    "donchian60_breakout": ("close > high60_prev AND volume_bin >= 0", "close < low60_prev AND volume_bin >= 0"),
    "failed_donchian20_reversion": ("low < low20_prev AND close > low20_prev AND z50 <= -0.75", "high > high20_prev AND close < high20_prev AND z50 >= 0.75"),
    "range_expansion_continuation": ("body_to_range >= 0.6 AND range_bin >= 2 AND volume_bin >= 0", "body_to_range <= -0.6 AND range_bin >= 2 AND volume_bin >= 0"),
    "range_expansion_reversion": ("body_to_range <= -0.65 AND range_bin >= 2 AND z50 <= -1.0", "body_to_range >= 0.65 AND range_bin >= 2 AND z50 >= 1.0"),
    "rsi14_reversion": ("rsi14 <= 30 AND close_location >= 0.45", "rsi14 >= 70 AND close_location <= 0.55"),
    "rsi14_momentum": ("rsi14 >= 60 AND ret1 > 0 AND trend_bin = 1", "rsi14 <= 40 AND ret1 < 0 AND trend_bin = -1"),
    "stoch20_reversion": ("stoch20 <= 0.1 AND close_location >= 0.5", "stoch20 >= 0.9 AND close_location <= 0.5"),
    "session_extreme_reversion": SET_B["session_extreme_reversion"],
    "opening_range_breakout": ("minute BETWEEN 600 AND 959 AND close > opening_high_prev AND volume_bin >= 0", "minute BETWEEN 600 AND 959 AND close < opening_low_prev AND volume_bin >= 0"),
    "low_volume_drift": SET_A["low_volume_drift"],
}
SETS = {"a": SET_A, "b": SET_B, "c": SET_C}
#: Columns that thresholds are compared with, rounded first so that both engines decide alike.
ROUNDED = ("ret1 ret3 ret5 ret15 prev_vwap_dist vwap_dist z20 z50 body_to_range close_location volume_ratio range20 range60 rsi14 stoch20 session_vwap ma9 ma20 ma50 session_low_prev session_high_prev "
           "high20_prev low20_prev high60_prev low60_prev opening_high_prev opening_low_prev prior_day_high prior_day_low prior_day_close close open high low prev_close prev_high prev_low").split()
KEYS = ["scan_type", "direction", "session_bucket", "dow", "trend_bin", "volume_bin", "range_bin"]


def scan(features: DataFrame, families: dict, keep: list[str] | None = None) -> DataFrame:
    """A row for each family and side that a bar satisfies; one scan, whatever the number of families."""
    f = features.withColumns({c: F.round(c, 9) for c in ROUNDED})
    hits = F.array(*[F.when(F.expr(cond), F.struct(F.lit(name).alias("scan_type"), F.lit(side).alias("direction"))) for name, sides in families.items() for side, cond in zip((1, -1), sides) if cond])
    keep = keep or ["symbol", "timestamp", "session_bucket", "dow", "trend_bin", "volume_bin", "range_bin", "close"]
    return f.withColumn("hit", F.explode(F.array_compact(hits))).select(*keep, "hit.scan_type", "hit.direction")


def at_horizons(features: DataFrame, horizons: list[int]) -> DataFrame:
    """A row for each horizon (in bars) whose exit there is: horizon and future_close."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(w).alias("future_close")) for h in horizons])
    return features.withColumn("ends", ends).withColumn("end", F.explode("ends")).drop("ends").where("end.future_close IS NOT NULL").select("*", "end.*").drop("end")


def continuous(signals: DataFrame, entry: str, exit_: str, minutes: int, tolerance: int) -> DataFrame:
    """Signals whose exit lies so many minutes after the entry, up to a tolerance more: no break of the market between."""
    gap = (F.unix_micros(F.col(exit_).cast("timestamp")) - F.unix_micros(F.col(entry).cast("timestamp"))) / 60e6
    return signals.where(gap.between(minutes, minutes + tolerance))


def with_forward(features: DataFrame, bars_ahead: int) -> DataFrame:
    """Adds the next bar's open and the close some bars ahead."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return features.withColumns({"entry_open": F.lead("open").over(w), "future_close": F.lead("close", bars_ahead).over(w)})


def edge_stats(signals: DataFrame, keys: list[str], pnl: str | Column = "pnl", least: int = 1) -> DataFrame:
    """Count, sum, mean, win rate and profit factor for each key."""
    # sums of decimals don't depend on the order of rows
    p = F.round(F.col(pnl) if isinstance(pnl, str) else pnl, 9).cast("decimal(18,9)")
    total, gain, loss = F.sum(p).cast("double"), F.sum(F.when(p > 0, p)).cast("double"), F.sum(F.when(p < 0, -p)).cast("double")
    out = signals.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("total"), (total / F.count(p)).alias("mean"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"))
    return out.where(F.col("n") >= least)


def grouping_sets(edges: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Edges, trades and weighted win rate for each of several sets of keys in one pass; keys that a set doesn't have are null."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), *[(F.col(k) if k in s else F.lit(None).cast(edges.schema[k].dataType)).alias(k) for k in keys]) for i, s in enumerate(sets)]))
    x = edges.select(rows.alias("k"), "n", (F.col("win_rate") * F.col("n")).alias("won")).select("k.*", "n", "won")
    return x.groupBy("set", *keys).agg(F.count("*").alias("edges"), F.sum("n").alias("trades"), (F.sum("won") / F.sum("n")).alias("win_probability")).drop("set")


def over_years(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each key by year, then over the years: weighted win rate, years with a profit, worst year."""
    y = ledger.groupBy(*keys, F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("rate"), F.sum("pnl").alias("net"))
    return y.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("win_rate"), F.count_if(F.col("net") > 0).alias("positive_years"), F.count("*").alias("years"), F.min("net").cast("double").alias("worst_year"), F.sum("net").cast("double").alias("net"))


def level_stats(signals: DataFrame, levels: dict[str, list[str]], pnl: str = "pnl") -> DataFrame:
    """The same over several sets of keys at once; level names the set, keys that it doesn't have are null."""
    every = list(dict.fromkeys(k for ks in levels.values() for k in ks))
    rows = F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(k).cast("string") if k in ks else F.lit(None).cast("string")).alias(k) for k in every]) for n, ks in levels.items()])
    x = signals.select(F.explode(rows).alias("k"), pnl).select("k.*", pnl)
    return edge_stats(x, ["level", *every], pnl)


def bracket_scan(features: DataFrame, pairs: list[tuple[float, float]], bars_ahead: int) -> DataFrame:
    """Every bar in both directions with each (target, stop) distance; the stop is looked at first, else the last close counts."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    ahead = w.rowsBetween(1, bars_ahead)
    f = features.withColumns({"fwd_high": F.max("high").over(ahead), "fwd_low": F.min("low").over(ahead), "future_close": F.lead("close", bars_ahead).over(w)}).where("future_close IS NOT NULL")
    f = f.withColumn("x", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(t).alias("target"), F.lit(s).alias("stop")) for d in (1, -1) for t, s in pairs]))).select("*", "x.*")
    up, down = F.round(F.col("fwd_high") - F.col("close"), 9), F.round(F.col("close") - F.col("fwd_low"), 9)
    good, bad = F.when(F.col("direction") == 1, up).otherwise(down), F.when(F.col("direction") == 1, down).otherwise(up)
    pnl = F.when(bad >= F.col("stop"), -F.col("stop")).when(good >= F.col("target"), F.col("target")).otherwise((F.col("future_close") - F.col("close")) * F.col("direction"))
    return f.withColumn("pnl", pnl)
