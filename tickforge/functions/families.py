"""Generated grammars: base families of predicate trees with their variants, and combinations of leaves drawn by a seed."""

from __future__ import annotations

import random

#: family -> (long entry, short entry): fixed values. Leaves are joined by commas and must all hold.
PLAIN = {
    "opening_range_breakout": ("opening_range_high_dist > 0, return_5m > 0", "opening_range_low_dist < 0, return_5m < 0"),
    "trend_pullback": ("ema_spread > 0, pullback_depth <= 6, return_1m > 0", "ema_spread < 0, pullback_depth <= 6, return_1m < 0"),
    "volatility_expansion": ("range_percentile_20 >= 0.7, return_1m > 0", "range_percentile_20 >= 0.7, return_1m < 0"),
    "intraday_momentum": ("return_5m >= 3, ema_slope > 0", "return_5m <= -3, ema_slope < 0"),
    "regime_filtered_mean_reversion": ("close_zscore_20 <= -1, vwap_dist < 0", "close_zscore_20 >= 1, vwap_dist > 0"),
    "time_of_day_edge": ("minutes_since_open >= 30, return_15m > 0", "minutes_since_open >= 30, return_15m < 0"),
    "gap_fade_or_continuation": ("prior_day_low_dist > 0, vwap_reclaim_flag >= 0", "prior_day_high_dist < 0, vwap_reclaim_flag <= 0"),
}
VOLUME = {
    "vol_breakout_trend": ("opening_range_high_dist > 0, relative_volume_20 >= {volume}, multi_timeframe_volume_confirm == 1, ema_slope > 0", "opening_range_low_dist < 0, relative_volume_20 >= {volume}, multi_timeframe_volume_confirm == 1, ema_slope < 0"),
    "vol_compression_expansion": ("range_percentile_20 <= 0.35, relative_volume_20 >= {volume}, return_5m > 0, ema_slope > 0", "range_percentile_20 <= 0.35, relative_volume_20 >= {volume}, return_5m < 0, ema_slope < 0"),
    "ma_pullback_volume_confirm": ("ema_spread > 0, pullback_depth <= {pullback}, relative_volume_5 >= {volume}, return_1m > 0", "ema_spread < 0, pullback_depth <= {pullback}, relative_volume_5 >= {volume}, return_1m < 0"),
    "volume_absorption_reversion": ("volume_absorption_flag > 0, close_zscore_20 <= -{z}, vwap_dist < 0", "volume_absorption_flag < 0, close_zscore_20 >= {z}, vwap_dist > 0"),
    "macd_ma_volume_confirm": ("ema_spread > 0, ema_slope > 0, volume_price_confirm > 0", "ema_spread < 0, ema_slope < 0, volume_price_confirm < 0"),
    "rsi_reversion_low_volume": ("close_zscore_20 <= -{z}, relative_volume_20 <= {volume}, vwap_dist < 0", "close_zscore_20 >= {z}, relative_volume_20 <= {volume}, vwap_dist > 0"),
}
#: What entries of all families are gated by, and the steps of the variants of the volume families: fixed values.
PLAIN_GATE = "spread_ticks <= 16, minutes_to_close >= 20"
VOLUME_GATE = "spread_ticks <= {spread}, minutes_since_open >= {delay}, minutes_to_close >= 20, low_volume_filter == 0"
STEPS = {"volume": [1.2, 1.5, 1.8, 2.0, 2.4], "pullback": [4, 6, 8, 10, 12], "z": [0.8, 1.0, 1.1, 1.3, 1.5], "delay": [5, 10, 15, 20, 30], "spread": [6, 8, 10, 12, 14]}


def tree(text: str) -> dict:
    """The conjunction of leaves in a text."""
    return {"all": [{"feature": f, "op": op, "value": float(v)} for f, op, v in (leaf.split() for leaf in text.split(","))]}


def base_families() -> list[dict]:
    """name, family, direction and entry (gates included) of every base family, variant and side."""
    out = [(family, family, PLAIN_GATE, sides) for family, sides in PLAIN.items()]
    for k in range(len(STEPS["volume"])):
        at = {n: v[k] for n, v in STEPS.items()}
        out += [(f"{family}_{k + 1}", family, VOLUME_GATE.format(**at), [s.format(**at) for s in sides]) for family, sides in VOLUME.items()]
    return [{"name": f"{name}_{'long' if d == 1 else 'short'}", "family": family, "direction": d, "entry": {"all": [tree(gate), tree(side)]}} for name, family, gate, sides in out for d, side in zip((1, -1), sides)]


def seeded_trees(levels: dict[str, list[float]], count: int, seed: int, sizes: tuple[int, int] = (2, 4)) -> list[dict]:
    """Trees with AND, OR and NOT over leaves that compare a feature with one of its levels; drawn by a seed, equal draws come once."""
    r, out, seen = random.Random(seed), [], set()
    for _ in range(50 * count):
        if len(out) == count:
            break
        leaves = [{"feature": f, "op": r.choice([">=", "<="]), "value": float(r.choice(levels[f]))} for f in sorted(r.sample(sorted(levels), min(len(levels), r.randint(*sizes))))]
        kind = r.choice(["all", "all", "any", "but"])
        node = {kind: leaves} if kind != "but" else {"all": [*leaves[:-1], {"not": leaves[-1]}]}
        if str(node) not in seen:
            seen.add(str(node))
            out.append({"name": f"seeded_{seed}_{len(out):04d}", "family": "seeded", "direction": r.choice([1, -1]), "entry": node})
    return out
