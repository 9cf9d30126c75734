"""The domain tables and bars in the SQL of the comparison engine."""

TICKS = """ticks AS (SELECT symbol, timestamp, mid - spread / 2 AS bid, mid + spread / 2 AS ask, bid_size, ask_size, mid, spread, seq FROM (
  SELECT event_type AS symbol, ts AS timestamp, 100 + value / 10 AS mid, 0.25::DOUBLE * (1 + user_id % 4) AS spread, (1 + user_id % 5)::DOUBLE AS bid_size, (1 + event_id % 7)::DOUBLE AS ask_size, event_id AS seq FROM events))"""


def bars(minutes: int, name: str = "bars") -> str:
    return f"""{TICKS}, {name} AS (SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', timestamp) AS timestamp, first(mid ORDER BY timestamp, seq) AS open, max(mid) AS high, min(mid) AS low,
  last(mid ORDER BY timestamp, seq) AS close, last(bid ORDER BY timestamp, seq) AS bid_close, last(ask ORDER BY timestamp, seq) AS ask_close, count(*)::INT AS tick_count,
  sum(bid_size) AS bid_size_sum, sum(ask_size) AS ask_size_sum, avg(spread) AS avg_spread FROM ticks GROUP BY symbol, time_bucket(INTERVAL '{minutes} minutes', timestamp))"""


def _steps(c: str) -> str:
    return f"CASE WHEN {c} >= 2 THEN 3 WHEN {c} >= 1.5 THEN 2 WHEN {c} >= 1 THEN 1 WHEN {c} < 0.7 THEN -1 ELSE 0 END"


def features(minutes: int = 60, opening: tuple[int, int] = (0, 179), zone: str = "UTC") -> str:
    """CTEs ending in f, the frame features of bars, with days and minutes of a zone."""
    local = f"timezone('{zone}', timezone('UTC', timestamp))" if zone != "UTC" else "timestamp"
    inside = "minute BETWEEN {} AND {}".format(*opening)
    s, d = "PARTITION BY symbol ORDER BY timestamp", "PARTITION BY symbol, day ORDER BY timestamp"
    over = lambda agg, n: f"{agg} OVER ({s} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    up, cr = f"OVER ({d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"OVER ({d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = [f"close - lag(close, {k}) OVER ({s}) AS ret{k}" for k in (3, 5, 15)] + [f"lag({c}) OVER ({s}) AS prev_{c}" for c in ("open", "high", "low", "close")]
    cols += [f"{over('avg(close)', n)} AS ma{n}" for n in (9, 20, 50, 200)] + [f"{over('stddev_pop(close)', n)} AS std{n}" for n in (20, 50)]
    cols += [f"{over('max(high)', n)} AS high{n}_prev" for n in (20, 60)] + [f"{over('min(low)', n)} AS low{n}_prev" for n in (20, 60)]
    cols += [f"{over('avg(rng)', n)} AS range{n}" for n in (20, 60)] + [f"{over('avg(tick_count)', n)} AS vol{n}" for n in (20, 50)]
    cols += [f"{over('avg(greatest(ret1, 0))', 14)} AS gain14", f"{over('avg(greatest(-ret1, 0))', 14)} AS loss14"]
    cols += [f"sum((high + low + close) / 3 * greatest(tick_count, 1)) {cr} / sum(greatest(tick_count, 1)) {cr} AS session_vwap", f"max(high) {up} AS session_high_prev", f"min(low) {up} AS session_low_prev",
             f"first(open) {cr} AS session_open", f"max(CASE WHEN {inside} THEN high END) {up} AS opening_high_prev", f"min(CASE WHEN {inside} THEN low END) {up} AS opening_low_prev"]
    ratio = lambda a, b, o: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE {o} END"
    return f"""{bars(minutes)},
f0 AS (SELECT *, {local}::DATE AS day, (hour({local}) * 60 + minute({local}))::INT AS minute, dayofweek({local})::INT AS dow, high - low AS rng, close - lag(close) OVER ({s}) AS ret1 FROM bars),
f1 AS (SELECT *, {', '.join(cols)} FROM f0),
f2 AS (SELECT symbol, day, lag(h) OVER w AS prior_day_high, lag(l) OVER w AS prior_day_low, lag(c) OVER w AS prior_day_close FROM (
  SELECT symbol, day, max(high) AS h, min(low) AS l, arg_max(close, timestamp) AS c FROM f0 GROUP BY symbol, day) WINDOW w AS (PARTITION BY symbol ORDER BY day)),
f3 AS (SELECT f1.*, prior_day_high, prior_day_low, prior_day_close, {ratio('tick_count', 'vol50', '1.0')} AS volume_ratio, {ratio('rng', 'range20', '1.0')} AS range_ratio, close - session_vwap AS vwap_dist,
  CASE WHEN std20 > 0 THEN (close - ma20) / std20 ELSE 0 END AS z20, CASE WHEN std50 > 0 THEN (close - ma50) / std50 ELSE 0 END AS z50,
  {ratio('(close - open)', 'rng', '0')} AS body_to_range, {ratio('(close - low)', 'rng', '0.5')} AS close_location, CASE WHEN close > ma50 THEN 1 ELSE -1 END AS trend_bin,
  CASE WHEN loss14 > 0 THEN 100 - 100 / (1 + gain14 / loss14) WHEN gain14 > 0 THEN 100 ELSE 50 END AS rsi14,
  CASE WHEN high20_prev > low20_prev THEN (close - low20_prev) / (high20_prev - low20_prev) ELSE 0.5 END AS stoch20 FROM f1 JOIN f2 USING (symbol, day)),
f AS (SELECT *, {_steps('volume_ratio')} AS volume_bin, {_steps('range_ratio')} AS range_bin, lag(vwap_dist) OVER ({s}) AS prev_vwap_dist,
  CASE WHEN minute < 480 THEN 'night' WHEN minute < 960 THEN 'day' ELSE 'evening' END AS session_bucket FROM f3)"""


def full(minutes: int = 60) -> str:
    """CTEs ending in g, the full-window features of bars."""
    s, d = "PARTITION BY symbol ORDER BY timestamp", "PARTITION BY symbol, day ORDER BY timestamp"
    fw = lambda agg, n: f"CASE WHEN count(*) OVER ({s} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {agg} OVER ({s} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    return f"""{bars(minutes)},
g0 AS (SELECT *, timestamp::DATE AS day, greatest(tick_count, 0)::DOUBLE AS v, high - low AS rng, lag(close) OVER ({s}) AS pc, lag(high) OVER ({s}) AS prev_high, lag(low) OVER ({s}) AS prev_low, lag(close, 5) OVER ({s}) AS c5, row_number() OVER ({s}) AS rn FROM bars),
g1 AS (SELECT *, CASE WHEN pc IS NULL THEN rng ELSE greatest(rng, abs(high - pc), abs(low - pc)) END AS tr, coalesce(close - pc, 0) AS diff1, close - c5 AS return_5m FROM g0),
g2 AS (SELECT *, {fw('avg(tr)', 14)} AS atr_14, {fw('stddev_pop(diff1)', 20)} AS realized_volatility_20, list(rng) OVER ({s} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ranges, list(v) OVER ({d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vols,
  {fw('avg(v)', 5)} AS volume_ma_5, {fw('avg(v)', 20)} AS volume_ma_20, {fw('sum(v)', 5)} AS sum5, {fw('sum(v)', 15)} AS sum15 FROM g1),
g3 AS (SELECT *, CASE WHEN len(ranges) = 20 THEN len(list_filter(ranges, lambda x: x <= rng)) / 20.0 END AS range_percentile_20, CASE WHEN len(vols) >= 5 THEN len(list_filter(vols, lambda x: x <= v)) / len(vols) END AS volume_percentile_session,
  CASE WHEN volume_ma_5 > 0 THEN v / volume_ma_5 END AS relative_volume_5, CASE WHEN volume_ma_20 > 0 THEN v / volume_ma_20 END AS relative_volume_20,
  CASE WHEN rn > 20 THEN avg(atr_14) OVER ({s} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS atr_mean_20, avg(sum5) OVER ({s} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sum5_mean, avg(sum15) OVER ({s} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sum15_mean FROM g2),
g AS (SELECT *, CASE WHEN relative_volume_20 >= 2 THEN 1.0 ELSE 0.0 END AS volume_spike_flag, CASE WHEN relative_volume_20 < 0.5 THEN 1.0 ELSE 0.0 END AS low_volume_filter,
  CASE WHEN relative_volume_20 >= 2 THEN coalesce(sign(return_5m), 0) ELSE 0 END AS volume_price_confirm, CASE WHEN atr_mean_20 IS NOT NULL AND atr_14 IS NOT NULL THEN CASE WHEN atr_14 < atr_mean_20 THEN 1.0 ELSE 0.0 END END AS volatility_compression,
  CASE WHEN high > prev_high AND close < prev_high THEN -1.0 WHEN low < prev_low AND close > prev_low THEN 1.0 ELSE 0.0 END AS breakout_failure_flag,
  CASE WHEN high <= prev_high AND low >= prev_low THEN 1.0 ELSE 0.0 END AS inside_bar, CASE WHEN high >= prev_high AND low <= prev_low THEN 1.0 ELSE 0.0 END AS outside_bar,
  CASE WHEN rng > 0 THEN (high - greatest(open, close)) / rng ELSE 0 END AS upper_shadow, CASE WHEN rng > 0 THEN (least(open, close) - low) / rng ELSE 0 END AS lower_shadow,
  CASE WHEN relative_volume_5 >= 1.5 AND sum5 >= 1.2 * sum5_mean AND sum15 >= 1.1 * sum15_mean THEN 1.0 ELSE 0.0 END AS multi_timeframe_volume_confirm FROM g3)"""


def rounded(cols: str) -> str:
    """Doubles rounded to 6 places: names separated by spaces."""
    return ", ".join(f"round(round(({c})::DOUBLE, 9), 6) + 0.0 AS {c}" for c in cols.split())
