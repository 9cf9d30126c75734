"""Queries over strategies and market structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar as G
from ..operators import bars as B
from ..operators import replay as R
from ..operators import scans as C
from ..operators import setups as Z
from ..operators import signals as X
from ..operators import strategies as Y
from ..sources import fixtures as S
from . import sqlbase as D
from .market import EMA_SQL, hourly, r6
from .signals import _MIRRORED, _RF, _SIDED, ENTRY, frame, ready

QUERIES, ORACLE = {}, {}


def grammar_backtest(spark, sf):
    f = ready(frame(spark, sf))
    atr = F.greatest(F.lit(0.25), F.coalesce("range20", F.lit(4.0)))
    return r6(Y.signal_bars(f, F.when(G.compile_node(ENTRY, f.columns), 1).otherwise(0), atr, 1.5 * atr, 6, 2))


def orb_backtest(spark, sf):
    return r6(Y.opening_range(hourly(spark, sf), 3, 3.0, 6.0))


def tick_replay(spark, sf):
    return r6(Y.tick_replay(S.ticks(spark, sf), 180, 2.75, 3.5))


def events(spark, sf):
    """Closes beyond the extremes of 20 bars."""
    up, down = F.expr("close > high20_prev"), F.expr("close < low20_prev")
    return ready(frame(spark, sf)).withColumn("direction", F.when(up, 1).when(down, -1)).where("direction IS NOT NULL").select("symbol", "timestamp", "direction")


def order_block(spark, sf):
    return r6(Y.order_blocks(hourly(spark, sf), events(spark, sf)))


def ob_status(spark, sf):
    return Y.block_status(Y.order_blocks(hourly(spark, sf), events(spark, sf)), hourly(spark, sf)).select("symbol", "event_i", "direction", "mitigated_i", "invalidated_i")


def state_machine(spark, sf):
    """Two-hour structure over quarter-hour bars."""
    p = Z.Setup(minutes=120, swing=(1, 1), coarse_swing=(1, 1), break_buffer=0, least_range=4, block=(1, 400), micro_block=(1, 400), clearance=0, sweep_buffer=0, stop=(1, 400), target_r=1.0, most_spread=9.0)
    return r6(Z.setups(B.tick_bars(S.ticks(spark, sf), 15), p))


SPECS = [{"name": "breakout", "entry": ENTRY, "side": "long", "stop": 3.0, "target": 4.0}, {"name": "same", "entry": ENTRY, "side": "long", "stop": 3.0, "target": 4.0}, {"name": "fade", "entry": {"feature": "z20", "op": ">=", "value": 1.5}, "side": "short", "stop": 3.0, "target": 3.0}]


def grammar_many(spark, sf):
    return r6(Y.grammar_batch(ready(frame(spark, sf)), SPECS, 6))


_OB = f"""{D.features()}, ib AS (SELECT symbol, timestamp, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars),
ev AS (SELECT f.symbol, i AS event_i, CASE WHEN round(f.close, 9) > round(high20_prev, 9) THEN 1 ELSE -1 END AS direction FROM f JOIN ib USING (symbol, timestamp) WHERE round(f.close, 9) > round(high20_prev, 9) OR round(f.close, 9) < round(low20_prev, 9)),
ob AS (SELECT ev.symbol, event_i, direction, max(i) AS origin_i, arg_max(low, i) AS block_low, arg_max(high, i) AS block_high FROM ev JOIN ib ON ib.symbol = ev.symbol AND i BETWEEN event_i - 12 AND event_i - 1 AND CASE WHEN direction = 1 THEN close < open ELSE close > open END GROUP BY ALL)"""
def structure_blocks(spark, sf):
    b = hourly(spark, sf)
    return r6(Y.event_blocks(b, R.structure_events(b), 2, 60).select("symbol", "event_i", "direction", "origin_i", "block_low", "block_high"))


def liquidity_pivot(spark, sf):
    b = R.indexed(hourly(spark, sf))
    marks = R.pivots(b).join(b.select("symbol", "timestamp", "i"), ["symbol", "timestamp"]).select("symbol", "i", "high", "low", "is_high", "is_low")
    out = R.liquidity_pivots(Y.order_blocks(hourly(spark, sf), events(spark, sf)), marks, 1.0)
    return r6(out.select("symbol", "event_i", "direction", "pivot_i", "pivot_price"))


_LP = """mk AS (SELECT symbol, i, high, low, n = 5 AND round(high - hh, 9) > 0 AS is_high, n = 5 AND round(ll - low, 9) > 0 AS is_low FROM (SELECT ib.*, greatest(max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS hh,
  least(min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS ll, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY i))),
hit AS (SELECT ob.symbol, event_i, direction, mk.i, CASE direction WHEN 1 THEN low ELSE high END AS price FROM ob JOIN mk ON mk.symbol = ob.symbol AND mk.i > origin_i AND mk.i < event_i AND ((direction = 1 AND is_low AND low > block_high + 1) OR (direction = -1 AND is_high AND high < block_low - 1)))"""
QUERIES |= {f.__name__: f for f in (grammar_backtest, orb_backtest, tick_replay, order_block, ob_status, state_machine, structure_blocks, liquidity_pivot, grammar_many)}
ORACLE |= {
    "liquidity_pivot": f"WITH {_OB}, {_LP} SELECT ob.symbol, ob.event_i, ob.direction, max(hit.i) AS pivot_i, round(arg_max(price, hit.i), 6) AS pivot_price FROM ob LEFT JOIN hit ON hit.symbol = ob.symbol AND hit.event_i = ob.event_i AND hit.direction = ob.direction GROUP BY ALL",
    "order_block": f"WITH {_OB} SELECT symbol, event_i, direction, origin_i, {D.rounded('block_low block_high')} FROM ob",
    "ob_status": f"""WITH {_OB} SELECT ob.symbol, event_i, direction, min(CASE WHEN direction = 1 AND low <= block_high OR direction = -1 AND high >= block_low THEN i END) AS mitigated_i,
  min(CASE WHEN direction = 1 AND close < block_low OR direction = -1 AND close > block_high THEN i END) AS invalidated_i FROM ob LEFT JOIN ib ON ib.symbol = ob.symbol AND i BETWEEN event_i + 1 AND event_i + 48 GROUP BY ALL""",
}


def _signal_query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: make(hourly(spark, sf)).select("symbol", "timestamp", "signal")
    ORACLE[name] = f"WITH {sql} SELECT symbol, timestamp, signal FROM sg"


_W = "WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)"
_signal_query("signal_trend_pullback", X.trend_pullback, f"""RECURSIVE {EMA_SQL}, sx AS (SELECT symbol, timestamp, close, ema_fast AS f, ema_slow AS s, lag(close) OVER w - lag(ema_fast) OVER w AS was FROM x {_W}),
sg AS (SELECT *, CASE WHEN f > s AND was < 0 AND close >= f THEN 1 WHEN f < s AND was > 0 AND close <= f THEN -1 ELSE 0 END AS signal FROM sx)""")
_signal_query("signal_mean_reversion", X.mean_reversion, f"""{D.bars(60)}, sx AS (SELECT symbol, timestamp, close, avg(close) OVER v AS m, stddev_pop(close) OVER v AS s, count(*) OVER v AS n FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sy AS (SELECT *, CASE WHEN n = 20 THEN CASE WHEN s > 0 THEN round((close - m) / s, 9) ELSE 0 END END AS z FROM sx), sg AS (SELECT *, CASE WHEN z <= -1.5 THEN 1 WHEN z >= 1.5 THEN -1 ELSE 0 END AS signal FROM sy)""")
_signal_query("signal_volatility_expansion", X.volatility_expansion, f"""{D.bars(60)}, sx AS (SELECT *, high - low AS r, CASE WHEN count(*) OVER v = 5 THEN avg(high - low) OVER v END AS mr FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
sy AS (SELECT *, round(r - lag(mr) OVER w * 1.5, 9) >= 0 AS wide, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM sx {_W}), sg AS (SELECT *, CASE WHEN wide AND close > ph THEN 1 WHEN wide AND close < pl THEN -1 ELSE 0 END AS signal FROM sy)""")
_signal_query("signal_intraday_momentum", X.intraday_momentum, f"""{D.bars(60)}, sx AS (SELECT *, round(close - lag(close, 3) OVER (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp), 9) AS m FROM bars), sg AS (SELECT *, CASE WHEN m >= 1 THEN 1 WHEN m <= -1 THEN -1 ELSE 0 END AS signal FROM sx)""")
_signal_query("signal_time_of_day", lambda b: X.time_of_day(b, 600, -1), f"""{D.bars(60)}, sg AS (SELECT *, CASE WHEN hour(timestamp) * 60 + minute(timestamp) >= 600 THEN -1 ELSE 0 END AS signal FROM bars)""")
_signal_query("signal_opening_gap", lambda b: X.opening_gap(b, 480, 0.5), f"""{D.bars(60)}, sx AS (SELECT *, lag(close) OVER w AS pc, hour(timestamp) >= 8 AND row_number() OVER (PARTITION BY symbol, timestamp::DATE, hour(timestamp) >= 8 ORDER BY timestamp) = 1 AS opens FROM bars {_W}),
sg AS (SELECT *, CASE WHEN opens AND round(open - pc, 9) <= -0.5 THEN 1 WHEN opens AND round(open - pc, 9) >= 0.5 THEN -1 ELSE 0 END AS signal FROM sx)""")


def micro_entries(spark, sf):
    q = X.micro_entries(S.ticks(spark, sf), most_spread=0.75, least_depth=1, imbalance=0.2, fast=1, slow=3, move=0.5)
    return q.where("signal <> 0").select("symbol", "seq", "signal")


def live_last_bar(spark, sf):
    """Families of set A that hold at the latest bar of each symbol."""
    return C.scan(X.last_bar(frame(spark, sf), 50), C.SET_A).select("symbol", "timestamp", "scan_type", "direction")


QUERIES |= {"micro_entries": micro_entries, "live_last_bar": live_last_bar}
ORACLE |= {
    "micro_entries": f"""WITH {D.TICKS}, x AS (SELECT symbol, seq, spread, least(bid_size, ask_size) AS depth, (bid_size - ask_size) / (bid_size + ask_size) AS lean, round(mid - lag(mid, 1) OVER w, 9) AS a, round(mid - lag(mid, 3) OVER w, 9) AS b FROM ticks WINDOW w AS (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp, seq)),
y AS (SELECT symbol, seq, CASE WHEN lean >= 0.2 AND a >= 0.5 AND b >= 0.5 THEN 1 WHEN lean <= -0.2 AND a <= -0.5 AND b <= -0.5 THEN -1 ELSE 0 END AS signal FROM x WHERE spread <= 0.75 AND depth >= 1) SELECT * FROM y WHERE signal <> 0""",
    "live_last_bar": f"""WITH {D.features()}, {_RF}, l AS (SELECT symbol, max(timestamp) AS t FROM r GROUP BY symbol HAVING count(*) >= 50), {_SIDED}, s AS ({_MIRRORED['a']}) SELECT s.symbol, timestamp, scan_type, d AS direction FROM s JOIN l ON l.symbol = s.symbol AND l.t = s.timestamp""",
}

_TRADE = """side, entry_time, exit_time, round(p, 6) AS entry_price, round(x, 6) AS exit_price, 1 AS contracts, round(round((x - p) * d * 20, 9), 6) + 0.0 AS gross_pnl, round(round((x - p) * d * 20 - 15, 9), 6) + 0.0 AS net_pnl"""
ORACLE |= {
    "orb_backtest": f"""WITH {D.bars(60)}, b AS (SELECT *, timestamp::DATE AS day, row_number() OVER (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp) AS k FROM bars),
o AS (SELECT symbol, day, max(high) FILTER (k <= 3) AS top, min(low) FILTER (k <= 3) AS bottom, max(k) AS last FROM b GROUP BY ALL), g AS (SELECT b.*, last, CASE WHEN k > 3 AND close > top THEN 1 WHEN k > 3 AND close < bottom THEN -1 END AS d FROM b JOIN o USING (symbol, day)),
e AS (SELECT symbol, day, k, d, last, timestamp AS entry_time, CASE d WHEN 1 THEN ask_close ELSE bid_close END AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY k) AS n FROM g WHERE d IS NOT NULL) WHERE n = 1),
h AS (SELECT e.symbol, e.day, b.k, CASE WHEN (d = 1 AND b.low <= p - 3) OR (d = -1 AND b.high >= p + 3) THEN 'stop_loss' WHEN (d = 1 AND b.high >= p + 6) OR (d = -1 AND b.low <= p - 6) THEN 'take_profit' END AS hit FROM e JOIN b ON b.symbol = e.symbol AND b.day = e.day AND b.k > e.k),
f AS (SELECT symbol, day, min(k) AS k, arg_min(hit, k) AS hit FROM h WHERE hit IS NOT NULL GROUP BY ALL),
z AS (SELECT e.symbol, e.d, CASE e.d WHEN 1 THEN 'long' ELSE 'short' END AS side, entry_time, b.timestamp AS exit_time, p, CASE hit WHEN 'stop_loss' THEN p - 3 * e.d WHEN 'take_profit' THEN p + 6 * e.d ELSE CASE e.d WHEN 1 THEN b.bid_close ELSE b.ask_close END END AS x, 'signal' AS entry_reason, coalesce(hit, 'end_of_data') AS exit_reason
  FROM e LEFT JOIN f ON f.symbol = e.symbol AND f.day = e.day JOIN b ON b.symbol = e.symbol AND b.day = e.day AND b.k = coalesce(f.k, e.last)) SELECT symbol, {_TRADE}, entry_reason, exit_reason FROM z""",
    "tick_replay": f"""WITH {D.TICKS}, b AS (SELECT *, timestamp::DATE AS day, row_number() OVER w AS k, min(timestamp) OVER (PARTITION BY symbol, timestamp::DATE) + INTERVAL 180 MINUTES AS open FROM ticks WINDOW w AS (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp, seq)),
o AS (SELECT symbol, day, max(mid) FILTER (timestamp < open) AS top, min(mid) FILTER (timestamp < open) AS bottom, max(k) AS last FROM b GROUP BY ALL),
s AS (SELECT symbol, day, any_value(last) AS last, min(k) AS k, arg_min(CASE WHEN mid > top THEN 1 ELSE -1 END, k) AS d FROM b JOIN o USING (symbol, day) WHERE timestamp >= open AND (mid > top OR mid < bottom) GROUP BY ALL),
e AS (SELECT b.symbol, b.day, b.k, d, last, timestamp AS entry_time, CASE d WHEN 1 THEN ceil(round(ask / 0.25, 9)) * 0.25 ELSE floor(round(bid / 0.25, 9)) * 0.25 END AS p FROM s JOIN b ON b.symbol = s.symbol AND b.day = s.day AND b.k = s.k + 1),
m AS (SELECT e.symbol, e.day, b.k, (CASE d WHEN 1 THEN b.bid ELSE b.ask END - p) * d AS move FROM e JOIN b ON b.symbol = e.symbol AND b.day = e.day AND b.k > e.k), f AS (SELECT symbol, day, min(k) AS k, arg_min(CASE WHEN move < 0 THEN 'stop_loss' ELSE 'take_profit' END, k) AS hit FROM m WHERE move <= -2.75 OR move >= 3.5 GROUP BY ALL),
z AS (SELECT e.symbol, e.d, CASE e.d WHEN 1 THEN 'long' ELSE 'short' END AS side, entry_time, b.timestamp AS exit_time, p, CASE e.d WHEN 1 THEN floor(round(b.bid / 0.25, 9)) * 0.25 ELSE ceil(round(b.ask / 0.25, 9)) * 0.25 END AS x, 'breakout' AS entry_reason, coalesce(hit, 'flatten') AS exit_reason
  FROM e LEFT JOIN f ON f.symbol = e.symbol AND f.day = e.day JOIN b ON b.symbol = e.symbol AND b.day = e.day AND b.k = coalesce(f.k, e.last)) SELECT symbol, {_TRADE}, entry_reason, exit_reason FROM z""",
}
