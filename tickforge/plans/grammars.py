"""Queries of generated grammars: every tree of the base families, and hundreds drawn by a seed, in one scan each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import families as G
from ..functions.windows import symbol_window
from ..operators import bitmaps as M
from ..operators import features as X
from . import sqlbase as D
from .market import ORACLE as MARKET
from .market import hourly, r6
from .signals import frame

QUERIES, ORACLE = {}, {}
SEEDED = G.seeded_trees({"z20": [-1.5, -0.5, 0.5, 1.5], "z50": [-1.0, 0.0, 1.0], "rsi14": [30, 45, 55, 70], "stoch20": [0.1, 0.5, 0.9], "volume_ratio": [0.7, 1.0, 1.5], "range_ratio": [0.7, 1.0, 1.5], "body_to_range": [-0.5, 0.0, 0.5], "close_location": [0.2, 0.5, 0.8]}, 400, 17)


def condition(node: dict) -> str:
    """A tree as SQL in which a missing value makes a leaf false."""
    if "feature" in node:
        return f"coalesce({node['feature']} {'=' if node['op'] == '==' else node['op']} {node['value']}, false)"
    parts = [" AND ".join(map(condition, node["all"]))] if "all" in node else []
    parts += [" OR ".join(map(condition, node["any"]))] if "any" in node else []
    parts += [f"NOT {condition(node['not'])}"] if "not" in node else []
    return "(" + ") AND (".join(parts) + ")"


def _results_sql(base: str, trees: list[dict]) -> str:
    chosen = ", ".join(f"CASE WHEN {condition(t['entry'])} THEN {{'name': '{t['name']}', 'p': p * {t['direction']}}} END" for t in trees)
    return f"""WITH RECURSIVE {base}, h AS (SELECT symbol, p, unnest([{chosen}]) AS x FROM o WHERE p IS NOT NULL)
SELECT x.name AS name, symbol, count(*) AS n, count(*) FILTER (x.p > 0) AS wins, round(sum(x.p::DECIMAL(18, 6))::DOUBLE, 6) + 0.0 AS total, round(coalesce(sum(x.p::DECIMAL(18, 6)) FILTER (x.p > 0), 0)::DOUBLE, 6) AS gain, round(-coalesce(sum(x.p::DECIMAL(18, 6)) FILTER (x.p < 0), 0)::DOUBLE, 6) + 0.0 AS loss
FROM h WHERE x IS NOT NULL GROUP BY ALL"""


_LEVELS = "z20 z50 rsi14 stoch20 volume_ratio range_ratio body_to_range close_location"


def grammar_seeded(spark, sf):
    f = frame(spark, sf)
    f = f.withColumn("p", F.round(F.lead("close", 3).over(symbol_window()) - F.col("close"), 6))
    f = f.select("symbol", "timestamp", "p", *(F.round(F.round(c, 9), 6).alias(c) for c in _LEVELS.split()))
    return r6(M.tree_results(f, SEEDED, "p"))


QUERIES["grammar_seeded"] = grammar_seeded
ORACLE["grammar_seeded"] = _results_sql(f"{D.features()}, o AS (SELECT symbol, timestamp, round(lead(close, 3) OVER (PARTITION BY symbol ORDER BY timestamp) - close, 6) AS p, {D.rounded(_LEVELS)} FROM f)", SEEDED)

_SESSION = "opening_range_high_dist opening_range_low_dist prior_day_high_dist prior_day_low_dist minutes_since_open minutes_to_close spread_ticks close_zscore_20 volume_absorption_flag return_1m return_15m return_5m range_percentile_20 relative_volume_5 relative_volume_20 multi_timeframe_volume_confirm low_volume_filter volume_price_confirm"


def grammar_features(bars, first: int = 480, last: int = 1200):
    """The features that generated grammars name, in one table."""
    s = X.session_features(bars, first, last).select("symbol", "timestamp", "close", *_SESSION.split())
    e = X.ema_features(bars).select("symbol", "timestamp", "ema_spread", "ema_slope", "pullback_depth")
    f = X.frame_features(bars).withColumn("same", F.lag("day").over(symbol_window()) == F.col("day"))
    flag = F.when(F.expr("same AND prev_vwap_dist < 0 AND vwap_dist >= 0"), 1.0).when(F.expr("same AND prev_vwap_dist > 0 AND vwap_dist <= 0"), -1.0).otherwise(0.0)
    return s.join(e, ["symbol", "timestamp"]).join(f.select("symbol", "timestamp", "vwap_dist", flag.alias("vwap_reclaim_flag")), ["symbol", "timestamp"])


def grammar_families(spark, sf):
    f = grammar_features(hourly(spark, sf))
    f = f.withColumn("p", F.round(F.lead("close", 3).over(Window.partitionBy("symbol").orderBy("timestamp")) - F.col("close"), 6))
    return r6(M.tree_results(r6(f), G.base_families(), "p"))


QUERIES["grammar_families"] = grammar_families
_JOINED = " ".join(f"JOIN ({MARKET[n]}) {n} USING (symbol, timestamp)" for n in ("ema_pair", "pullback_depth", "session_vwap", "vwap_reclaim", "range_percentile", "volume_features", "multi_tf_volume"))
ORACLE["grammar_families"] = _results_sql(f"{D.bars(60)}, r5 AS (SELECT symbol, timestamp, round(lead(close, 3) OVER w - close, 6) AS p, round(close - lag(close, 5) OVER w, 6) AS return_5m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)), o AS (SELECT * FROM r5 JOIN ({MARKET['session_features']}) session_features USING (symbol, timestamp) {_JOINED})", G.base_families())
