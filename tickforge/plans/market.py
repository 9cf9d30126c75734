"""Queries over bars, quality and features, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import features as X
from ..operators import quality as Q
from ..sources import fixtures as S
from . import sqlbase as D

QUERIES, ORACLE = {}, {}
OHLC = "open high low close"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name."""
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places."""
    return df.select(*[(F.round(F.round(c, 9), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hourly(spark, sf):
    return B.tick_bars(S.ticks(spark, sf), 60)


@query(f"WITH {D.bars(1)} SELECT symbol, timestamp, tick_count, {D.rounded(OHLC + ' bid_close ask_close bid_size_sum ask_size_sum avg_spread')} FROM bars")
def tick_to_bar(spark, sf):
    return r6(B.tick_bars(S.ticks(spark, sf), 1))


def _rebucketed(label: str) -> str:
    end = " + INTERVAL '60 minutes'" if label == "right" else ""
    return f"""WITH {D.bars(15)}, c AS (SELECT symbol, time_bucket(INTERVAL '60 minutes', timestamp){end} AS ts, first(open ORDER BY timestamp) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY timestamp) AS close,
  sum(tick_count)::INT AS tick_count, sum(avg_spread * tick_count) / nullif(sum(tick_count), 0) AS avg_spread FROM bars GROUP BY ALL) SELECT symbol, ts AS timestamp, tick_count, {D.rounded(OHLC + ' avg_spread')} FROM c"""


@query(_rebucketed("left"))
def bar_rebucket(spark, sf):
    return r6(B.rebucket(B.tick_bars(S.ticks(spark, sf), 15), 60))


@query(_rebucketed("right"))
def bar_right_label(spark, sf):
    return r6(B.rebucket(B.tick_bars(S.ticks(spark, sf), 15), 60, "right"))


@query(f"""WITH {D.TICKS}, x AS (SELECT *, abs(mid - lag(mid) OVER (PARTITION BY symbol ORDER BY timestamp, seq)) AS move FROM ticks)
SELECT symbol, count(*) AS n_rows, min(timestamp) AS first_time, max(timestamp) AS last_time, count(*) - count(DISTINCT timestamp) AS duplicates, count(*) FILTER (bid <= 0 OR ask <= 0) AS non_positive, count(*) FILTER (ask < bid) AS crossed,
  round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS max_spread, count(*) FILTER (spread > 0.75) AS wide, count(*) FILTER (move > 20) AS jumps FROM x GROUP BY symbol""")
def tick_quality(spark, sf):
    return r6(Q.tick_quality(S.ticks(spark, sf), 0.75, 20.0))


@query(f"""WITH {D.bars(60)}, x AS (SELECT *, lag(timestamp) OVER w AS prev, abs(close - lag(close) OVER w) AS move FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
SELECT symbol, count(*) AS n_rows, count(*) FILTER (prev::DATE = timestamp::DATE AND timestamp > prev + INTERVAL '60 minutes') AS gaps, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid,
  count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive, count(*) FILTER (move > 20) AS jumps, round(avg(avg_spread), 6) AS mean_spread FROM x GROUP BY symbol""")
def bar_quality(spark, sf):
    return r6(Q.bar_quality(hourly(spark, sf), 60, 20.0))


@query("SELECT sum(n - 1)::BIGINT AS excess, count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def duplicate_excess(spark, sf):
    return Q.duplicate_excess(S.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(f"""WITH {D.TICKS} SELECT timestamp::DATE AS day, count(*) AS n_rows, min(timestamp) AS first_time, max(timestamp) AS last_time, round(avg(spread), 6) AS mean_spread, count(*) FILTER (spread < 0) AS negative,
  count(*) - count(DISTINCT timestamp) AS duplicates FROM ticks GROUP BY ALL""")
def quote_coverage(spark, sf):
    return r6(Q.quote_coverage(S.ticks(spark, sf)))


_SIDES = "bid_open bid_high bid_low bid_close ask_open ask_high ask_low ask_close avg_spread min_bid_size min_ask_size avg_imbalance"


@query(f"""WITH {D.TICKS}, q AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', timestamp) AS ts, {', '.join(f"first({s} ORDER BY timestamp, seq) AS {s}_open, max({s}) AS {s}_high, min({s}) AS {s}_low, last({s} ORDER BY timestamp, seq) AS {s}_close" for s in ('bid', 'ask'))},
  avg(spread) AS avg_spread, min(bid_size) AS min_bid_size, min(ask_size) AS min_ask_size, avg((bid_size - ask_size) / (bid_size + ask_size)) AS avg_imbalance, count(*) AS quote_count FROM ticks WHERE bid > 0 AND ask > 0 AND ask >= bid GROUP BY ALL)
SELECT symbol, ts AS timestamp, quote_count, {D.rounded(_SIDES)} FROM q""")
def quote_minute_bars(spark, sf):
    return r6(B.quote_bars(S.ticks(spark, sf), 15))


@query(f"""WITH {D.bars(60)}, s AS (SELECT symbol, timestamp::DATE AS day, first(open ORDER BY timestamp) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY timestamp) AS close, count(*) AS bars FROM bars
  WHERE hour(timestamp) * 60 + minute(timestamp) BETWEEN 480 AND 1200 GROUP BY ALL HAVING count(*) >= 6) SELECT symbol, day, bars, {D.rounded(OHLC)} FROM s""")
def daily_session_bars(spark, sf):
    return r6(B.session_days(hourly(spark, sf), 480, 1200, 6))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n_rows, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY ALL")
def coverage_by_year(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_rows"), F.min("o_orderdate").alias("first_time"), F.max("o_orderdate").alias("last_time"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@query("""SELECT day, contract, n, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, total DESC, contract) AS o FROM (
  SELECT l_shipdate::DATE AS day, l_suppkey AS contract, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)) WHERE o = 1""")
def active_contract(spark, sf):
    return r6(B.active_contract(S.contracts(spark, sf)))


@query(f"""WITH {D.TICKS} SELECT symbol, step, timestamp, seq, {D.rounded('bid ask')} FROM (SELECT *, time_bucket(INTERVAL '60 seconds', timestamp) AS step,
  row_number() OVER (PARTITION BY symbol, time_bucket(INTERVAL '60 seconds', timestamp) ORDER BY timestamp DESC, seq DESC) AS o FROM ticks) WHERE o = 1""")
def second_sample(spark, sf):
    return r6(B.last_per_second(S.ticks(spark, sf), 60))


@query(f"""WITH {D.TICKS}, c AS (SELECT symbol, timestamp, seq, CASE WHEN seq % 3 = 0 THEN ask ELSE bid END AS b, CASE WHEN seq % 3 = 0 THEN bid ELSE ask END AS a, bid_size AS bs, ask_size AS s FROM ticks)
SELECT symbol, timestamp, seq, round(least(a, b), 6) AS bid, round(greatest(a, b), 6) AS ask, CASE WHEN b > a THEN s ELSE bs END AS bid_size, CASE WHEN b > a THEN bs ELSE s END AS ask_size FROM c""")
def crossed_quote_fix(spark, sf):
    t = S.ticks(spark, sf)
    crossed = F.col("seq") % 3 == 0
    t = t.withColumns({"bid": F.when(crossed, F.col("ask")).otherwise(F.col("bid")), "ask": F.when(crossed, F.col("bid")).otherwise(F.col("ask"))})
    return r6(B.uncross(t))


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3][2-5]$') AND p_size > 10")
def contract_regex(spark, sf):
    return S.table(spark, sf, "part").where(F.col("p_brand").rlike("^Brand#[1-3][2-5]$") & (F.col("p_size") > 10)).select("p_partkey", "p_brand")


@query("SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity > 45)")
def skip_existing_partitions(spark, sf):
    expected = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return Q.missing_partitions(expected, S.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.to_date("l_shipdate").alias("day")), "day")


#: Feature queries: name -> columns of the frame table, or of the full-window table.
FRAME = {
    "returns": "ret1 ret3 ret5 ret15 prev_close", "moving_averages": "ma9 ma20 ma50 ma200", "zscore": "std20 std50 z20 z50", "donchian": "high20_prev low20_prev high60_prev low60_prev",
    "session_vwap": "session_vwap vwap_dist prev_vwap_dist", "session_levels": "session_open session_high_prev session_low_prev", "opening_range": "opening_high_prev opening_low_prev",
    "prior_day_levels": "prior_day_high prior_day_low prior_day_close", "rsi_stoch": "rsi14 stoch20 gain14 loss14", "regime_bins": "volume_ratio range_ratio trend_bin volume_bin range_bin"}
FULL = {
    "atr14": "tr atr_14", "realized_vol": "diff1 realized_volatility_20", "range_percentile": "range_percentile_20", "volume_features": "volume_ma_5 volume_ma_20 relative_volume_5 relative_volume_20 volume_spike_flag low_volume_filter volume_price_confirm",
    "volume_percentile_session": "volume_percentile_session", "candle_shape": "upper_shadow lower_shadow inside_bar outside_bar", "breakout_failure": "breakout_failure_flag", "volatility_compression": "atr_mean_20 volatility_compression",
    "multi_tf_volume": "sum5 sum15 sum5_mean sum15_mean multi_timeframe_volume_confirm"}


def _feature_query(name: str, cols: str, make, base: str, last: str) -> None:
    names = cols.split()
    QUERIES[name] = lambda spark, sf: r6(make(hourly(spark, sf)).select("symbol", "timestamp", *[F.col(c).cast("double").alias(c) for c in names]))
    ORACLE[name] = f"WITH {base} SELECT symbol, timestamp, {D.rounded(cols)} FROM {last}"


for _n, _c in FRAME.items():
    _feature_query(_n, _c, X.frame_features, D.features(), "f")
for _n, _c in FULL.items():
    _feature_query(_n, _c, X.full_features, D.full(), "g")


@query(f"""WITH {D.features()} SELECT symbol, timestamp, CASE WHEN prev_vwap_dist < 0 AND vwap_dist >= 0 AND pd = day THEN 1.0 WHEN prev_vwap_dist > 0 AND vwap_dist <= 0 AND pd = day THEN -1.0 ELSE 0.0 END::DOUBLE AS vwap_reclaim_flag
FROM (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY timestamp) AS pd FROM f)""")
def vwap_reclaim(spark, sf):
    from ..functions.windows import symbol_window

    f = X.frame_features(hourly(spark, sf)).withColumn("same", F.lag("day").over(symbol_window()) == F.col("day"))
    flag = F.when(F.expr("same AND prev_vwap_dist < 0 AND vwap_dist >= 0"), 1.0).when(F.expr("same AND prev_vwap_dist > 0 AND vwap_dist <= 0"), -1.0).otherwise(0.0)
    return f.select("symbol", "timestamp", flag.alias("vwap_reclaim_flag"))


_SESSION = "session_high_dist session_low_dist opening_range_high_dist opening_range_low_dist prior_day_high_dist prior_day_low_dist minutes_since_open minutes_to_close spread_ticks bar_body_ratio signed_body_ratio close_zscore_20 volume_absorption_flag bar_volume return_1m return_15m"


@query(f"""WITH {D.full()}, p AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM (SELECT symbol, day, max(high) AS h, min(low) AS l FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY day)),
m AS (SELECT *, hour(timestamp) * 60 + minute(timestamp) AS mi, row_number() OVER s AS rk, avg(close) OVER (s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, stddev_pop(close) OVER (s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd, lag(close, 15) OVER s AS c15 FROM g WINDOW s AS (PARTITION BY symbol ORDER BY timestamp)),
q AS (SELECT m.*, ph, pl, max(high) OVER d AS sh, min(low) OVER d AS sl, max(CASE WHEN mi BETWEEN 480 AND 509 THEN high END) OVER d AS oh, min(CASE WHEN mi BETWEEN 480 AND 509 THEN low END) OVER d AS ol FROM m LEFT JOIN p USING (symbol, day) WINDOW d AS (PARTITION BY symbol, day ORDER BY timestamp)),
z AS (SELECT symbol, timestamp, close - sh AS session_high_dist, close - sl AS session_low_dist, close - oh AS opening_range_high_dist, close - ol AS opening_range_low_dist, close - ph AS prior_day_high_dist, close - pl AS prior_day_low_dist, mi - 480 AS minutes_since_open, 1200 - mi AS minutes_to_close, avg_spread / 0.25 AS spread_ticks,
  CASE WHEN rng > 0 THEN abs(close - open) / rng ELSE 0 END AS bar_body_ratio, CASE WHEN rng > 0 THEN (close - open) / rng ELSE 0 END AS signed_body_ratio, CASE WHEN rk >= 20 THEN CASE WHEN sd > 0 THEN (close - mean) / sd ELSE 0 END END AS close_zscore_20,
  CASE WHEN relative_volume_20 >= 2 AND atr_14 IS NOT NULL AND abs(close - open) <= greatest(atr_14 * 0.15, 0.25) THEN CASE WHEN close >= open THEN -1 ELSE 1 END ELSE 0 END AS volume_absorption_flag, v AS bar_volume, close - pc AS return_1m, close - c15 AS return_15m FROM q)
SELECT symbol, timestamp, {D.rounded(_SESSION)} FROM z""")
def session_features(spark, sf):
    return r6(X.session_features(hourly(spark, sf), 480, 1200).select("symbol", "timestamp", *[F.col(c).cast("double").alias(c) for c in _SESSION.split()]))


EMA_SQL = f"""{D.bars(60)}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS k FROM bars),
e AS (SELECT symbol, timestamp, k, close, close AS a, close AS b FROM n WHERE k = 1 UNION ALL
  SELECT n.symbol, n.timestamp, n.k, n.close, n.close * (2.0 / 10)::DOUBLE + e.a * (1 - (2.0 / 10)::DOUBLE), n.close * (2.0::DOUBLE / 22) + e.b * (1 - 2.0::DOUBLE / 22) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1),
x AS (SELECT symbol, timestamp, k, close, CASE WHEN k >= 9 THEN a END AS ema_fast, CASE WHEN k >= 21 THEN b END AS ema_slow, CASE WHEN k >= 21 THEN a - b END AS ema_spread,
  CASE WHEN k >= 10 THEN a - lag(a) OVER (PARTITION BY symbol ORDER BY k) END AS ema_slope FROM e)"""


@query(f"WITH RECURSIVE {EMA_SQL} SELECT symbol, timestamp, {D.rounded('ema_fast ema_slow ema_spread ema_slope')} FROM x")
def ema_pair(spark, sf):
    return r6(X.ema_features(hourly(spark, sf)).select("symbol", "timestamp", "ema_fast", "ema_slow", "ema_spread", "ema_slope"))


@query(f"""WITH RECURSIVE {EMA_SQL}, s AS (SELECT *, timestamp::DATE AS day, coalesce(sign(ema_spread), 0) AS sg FROM x),
t AS (SELECT *, CASE WHEN lag(sg) OVER w IS DISTINCT FROM sg THEN 1 ELSE 0 END AS flip FROM s WHERE sg <> 0 WINDOW w AS (PARTITION BY symbol, day ORDER BY k)),
u AS (SELECT *, sum(flip) OVER (PARTITION BY symbol, day ORDER BY k) AS run FROM t), v AS (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol, day, run ORDER BY k)::DOUBLE AS trend_age FROM u)
SELECT symbol, timestamp, coalesce(trend_age, 0) AS trend_age FROM s LEFT JOIN v USING (symbol, timestamp)""")
def trend_age(spark, sf):
    return X.ema_features(hourly(spark, sf)).select("symbol", "timestamp", "trend_age")


@query(f"WITH RECURSIVE {EMA_SQL} SELECT symbol, timestamp, round(CASE WHEN ema_fast IS NULL THEN NULL ELSE greatest((ema_fast - close) * coalesce(sign(ema_spread), 0), 0) END, 6) + 0.0 AS pullback_depth FROM x")
def pullback_depth(spark, sf):
    return X.ema_features(hourly(spark, sf)).select("symbol", "timestamp", (F.round("pullback_depth", 6) + 0.0).alias("pullback_depth"))
