"""The features that the engine computes, as a table: what each needs and whether it may look ahead."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words in a name that say which family a feature belongs to, the first that fits.
FAMILIES = [("volume", "vol"), ("volume", "tick_count"), ("trend", "ema"), ("trend", "trend"), ("trend", "ma"), ("volatility", "atr"), ("volatility", "std"), ("volatility", "realized"), ("volatility", "range"), ("momentum", "ret"), ("momentum", "rsi"), ("momentum", "stoch"), ("momentum", "z"),
            ("session", "session"), ("session", "opening"), ("session", "prior_day"), ("session", "minute"), ("session", "vwap"), ("structure", "high"), ("structure", "low"), ("structure", "bar"), ("execution", "spread")]
AHEAD = re.compile(r"future|entry_open|fwd_|lead_")


def lookback(name: str) -> int:
    """Bars before the current one that a feature's name says it needs; 1 where it says nothing."""
    numbers = [int(n) * (1 if unit != "h" else 60) for n, unit in re.findall(r"(\d+)([mh]?)", name)]
    return max(numbers, default=1)


def catalog(spark: SparkSession, tables: dict[str, DataFrame], keys: set[str]) -> DataFrame:
    """name, source, family, lookback, warm_up (bars until it is known), leakage_risk and type of every column of the feature tables that isn't a key; names in several tables come from the first."""
    out: dict[str, tuple] = {}
    for source, table in tables.items():
        for name, kind in table.dtypes:
            if name in keys or name in out:
                continue
            family = next((f for f, part in FAMILIES if part in name), "other")
            n = lookback(name)
            out[name] = (name, source, family, n, n if source == "full" else 1, "high" if AHEAD.search(name) else "none", kind)
    return spark.createDataFrame(sorted(out.values()), "name string, source string, family string, lookback int, warm_up int, leakage_risk string, type string")
