"""Queries of first passages: brackets on quotes and bars, fills of gaps, levels taken, retest gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import passage as P
from ..operators import replay as R
from ..sources import fixtures as S
from . import sqlbase as D
from .market import hourly, r6

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _signals(bars, ordered):
    """A signal at each row, with the direction of the move of the row before."""
    w = Window.partitionBy("symbol").orderBy(*ordered)
    return bars.withColumn("direction", F.when(F.lag("move").over(w) > 0, 1).otherwise(-1))


@query(f"""WITH {D.TICKS}, q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS k, lag(mid) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS m1, lag(mid, 2) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS m2 FROM ticks),
e AS (SELECT *, CASE WHEN direction = 1 THEN ask ELSE bid END AS entry, CASE WHEN direction = 1 THEN ask - 1.5 ELSE bid + 1.5 END AS stop, CASE WHEN direction = 1 THEN ask + 3 ELSE bid - 3 END AS target FROM (SELECT *, CASE WHEN m1 - m2 > 0 THEN 1 ELSE -1 END AS direction FROM q)),
late AS (SELECT e.symbol, e.k, min(r.k) AS k2 FROM e JOIN q r ON r.symbol = e.symbol AND r.k > e.k AND r.timestamp > e.timestamp + INTERVAL 2 HOURS GROUP BY ALL),
turn AS (SELECT e.symbol, e.k, min(r.k) AS k2 FROM e JOIN (SELECT symbol, timestamp::DATE AS day, min(k) AS k FROM q GROUP BY ALL) r ON r.symbol = e.symbol AND r.day > e.timestamp::DATE GROUP BY ALL),
ends AS (SELECT e.*, least(late.k2, turn.k2) AS k2 FROM e LEFT JOIN late USING (symbol, k) LEFT JOIN turn USING (symbol, k)),
hit AS (SELECT e.symbol, e.k, min(r.k) AS k3 FROM ends e JOIN q r ON r.symbol = e.symbol AND r.k > e.k AND r.k < coalesce(e.k2, 1000000000) WHERE CASE WHEN e.direction = 1 THEN r.bid <= e.stop OR r.bid >= e.target ELSE r.ask >= e.stop OR r.ask <= e.target END GROUP BY ALL),
x AS (SELECT e.*, k3, r.timestamp AS exit_time, r.bid AS rb, r.ask AS ra FROM ends e LEFT JOIN hit USING (symbol, k) JOIN q r ON r.symbol = e.symbol AND r.k = coalesce(k3, k2)),
y AS (SELECT *, CASE WHEN k3 IS NULL THEN 'time' WHEN CASE WHEN direction = 1 THEN rb <= stop ELSE ra >= stop END THEN 'stop' ELSE 'target' END AS reason FROM x)
SELECT symbol, timestamp, seq, direction, round(entry, 6) AS entry, exit_time, round(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE CASE WHEN direction = 1 THEN rb ELSE ra END END, 6) AS exit_price, reason FROM y""")
def quote_brackets(spark, sf):
    """Each quote as an entry: 1.5 points to the stop, twice that to the target, two hours."""
    t = S.ticks(spark, sf)
    w = Window.partitionBy("symbol").orderBy("timestamp", "seq")
    s = _signals(t.withColumn("move", F.col("mid") - F.lag("mid").over(w)), ["timestamp", "seq"])
    return r6(P.quote_brackets(s, t, 1.5, 2.0, 7200))


_QB = f"""{D.TICKS}, bars AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', timestamp) AS timestamp, first(bid ORDER BY timestamp, seq) AS bid_open, max(bid) AS bid_high, min(bid) AS bid_low, last(bid ORDER BY timestamp, seq) AS bid_close,
  first(ask ORDER BY timestamp, seq) AS ask_open, max(ask) AS ask_high, min(ask) AS ask_low, last(ask ORDER BY timestamp, seq) AS ask_close FROM ticks WHERE bid > 0 AND ask > 0 AND ask >= bid GROUP BY ALL),
ix AS (SELECT *, row_number() OVER w AS k, lag(bid_close - bid_open) OVER w AS move, timestamp::DATE AS day FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
e AS (SELECT *, CASE WHEN direction = 1 THEN ask_open ELSE bid_open END AS entry, CASE WHEN direction = 1 THEN ask_open - 1 ELSE bid_open + 1 END AS stop, CASE WHEN direction = 1 THEN ask_open + 3 ELSE bid_open - 3 END AS target FROM (SELECT *, CASE WHEN move > 0 THEN 1 ELSE -1 END AS direction FROM ix))"""


@query(f"""WITH {_QB}, ends AS (SELECT e.*, l.k AS last_all, d.k AS last_day, least(e.k + 6, d.k) AS k2 FROM e JOIN (SELECT symbol, max(k) AS k FROM ix GROUP BY ALL) l USING (symbol) JOIN (SELECT symbol, day, max(k) AS k FROM ix GROUP BY ALL) d USING (symbol, day)),
hit AS (SELECT e.symbol, e.k, min(r.k) AS k3 FROM ends e JOIN ix r ON r.symbol = e.symbol AND r.k BETWEEN e.k AND e.k2 WHERE CASE WHEN e.direction = 1 THEN r.bid_low <= e.stop OR r.bid_high >= e.target ELSE r.ask_high >= e.stop OR r.ask_low <= e.target END GROUP BY ALL),
x AS (SELECT e.*, k3, r.timestamp AS exit_time, r.bid_close AS rb, r.ask_close AS ra, CASE WHEN k3 IS NULL THEN CASE WHEN e.k + 6 > last_day AND last_day < last_all THEN 'date' ELSE 'time' END WHEN CASE WHEN direction = 1 THEN r.bid_low <= stop ELSE r.ask_high >= stop END THEN 'stop' ELSE 'target' END AS reason
  FROM ends e LEFT JOIN hit USING (symbol, k) JOIN ix r ON r.symbol = e.symbol AND r.k = coalesce(k3, k2))
SELECT symbol, timestamp, direction, round(entry, 6) AS entry, exit_time, round(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE CASE WHEN direction = 1 THEN rb ELSE ra END END, 6) AS exit_price, reason FROM x""")
def minute_brackets(spark, sf):
    """Each quarter-hour bar as an entry at its open; a point to the stop, three to the target, six bars."""
    b = B.quote_bars(S.ticks(spark, sf), 15)
    return r6(P.minute_brackets(_signals(b.withColumn("move", F.col("bid_close") - F.col("bid_open")), ["timestamp"]), b, 1.0, 3.0, 6))


GRID = [{"name": f"stop {a} reward {r} hold {h}", "stop": a, "reward": r, "hold": h} for a in (0.5, 1.0, 2.0) for r in (1.0, 2.0, 3.0) for h in (3, 6)]


@query(f"""WITH {_QB.split("e AS (SELECT *, CASE")[0]} g AS (SELECT a AS stop_points, r AS reward, h AS hold, 'stop ' || a || ' reward ' || r || ' hold ' || h AS name FROM (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS a), (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS r), (SELECT unnest([3, 6])::INT AS h)),
e0 AS (SELECT *, CASE WHEN move > 0 THEN 1 ELSE -1 END AS direction FROM ix), e AS (SELECT *, entry - direction * stop_points AS stop, entry + direction * stop_points * reward AS target FROM (SELECT *, CASE WHEN direction = 1 THEN ask_open ELSE bid_open END AS entry FROM e0, g)),
ends AS (SELECT e.*, least(e.k + hold, d.k) AS k2 FROM e JOIN (SELECT symbol, day, max(k) AS k FROM ix GROUP BY ALL) d USING (symbol, day)),
hit AS (SELECT e.symbol, e.k, name, min(r.k) AS k3 FROM ends e JOIN ix r ON r.symbol = e.symbol AND r.k BETWEEN e.k AND e.k2 WHERE CASE WHEN e.direction = 1 THEN r.bid_low <= e.stop OR r.bid_high >= e.target ELSE r.ask_high >= e.stop OR r.ask_low <= e.target END GROUP BY ALL),
x AS (SELECT e.*, CASE WHEN k3 IS NULL THEN 'time' WHEN CASE WHEN direction = 1 THEN r.bid_low <= stop ELSE r.ask_high >= stop END THEN 'stop' ELSE 'target' END AS reason, r.bid_close AS rb, r.ask_close AS ra FROM ends e LEFT JOIN hit USING (symbol, k, name) JOIN ix r ON r.symbol = e.symbol AND r.k = coalesce(k3, k2)),
y AS (SELECT *, round(((CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE CASE WHEN direction = 1 THEN rb ELSE ra END END - entry) * direction - 0.1) * 1000000)::BIGINT AS p FROM x),
z AS (SELECT name, stop_points AS stop, reward, hold, count(*) AS trades, count(*) FILTER (p > 0) AS wins, round(sum(p)::DOUBLE / 1000000, 6) AS net, round(sum(greatest(p, 0))::DOUBLE / 1000000, 6) AS gross_win, round(sum(greatest(-p, 0))::DOUBLE / 1000000, 6) AS gross_loss, count(*) FILTER (reason = 'stop') AS stops, count(*) FILTER (reason = 'target') AS targets FROM y GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY net DESC, name)::INT AS rank FROM z""")
def bracket_sweep(spark, sf):
    """Eighteen brackets over every quarter-hour bar."""
    b = B.quote_bars(S.ticks(spark, sf), 15)
    return r6(P.bracket_sweep(_signals(b.withColumn("move", F.col("bid_close") - F.col("bid_open")), ["timestamp"]), b, GRID, 0.1))


@query(f"""WITH {D.bars(60)}, p AS (SELECT *, row_number() OVER w AS k, lag(close) OVER w AS pc, lag(close - open) OVER w AS move FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
a AS (SELECT *, coalesce(round(avg(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 9), 0) AS atr, CASE WHEN move > 0 THEN 1 ELSE -1 END AS direction FROM p),
b AS (SELECT *, least(greatest(atr * 1.5 / 0.25, 8), 400) * 0.25 AS pts FROM a), e AS (SELECT b.*, open - direction * pts AS stop, open + direction * pts * 2.0 AS target, least(b.k + 24, l.k) AS k2 FROM b JOIN (SELECT symbol, max(k) AS k FROM b GROUP BY ALL) l USING (symbol)),
hit AS (SELECT e.symbol, e.k, min(r.k) AS k3 FROM e JOIN p r ON r.symbol = e.symbol AND r.k BETWEEN e.k AND e.k2 WHERE CASE WHEN e.direction = 1 THEN r.low <= e.stop OR r.high >= e.target ELSE r.high >= e.stop OR r.low <= e.target END GROUP BY ALL),
x AS (SELECT e.*, r.timestamp AS exit_time, r.close AS rc, CASE WHEN k3 IS NULL THEN 'time' WHEN CASE WHEN direction = 1 THEN r.low <= stop ELSE r.high >= stop END THEN 'stop' ELSE 'target' END AS reason FROM e LEFT JOIN hit USING (symbol, k) JOIN p r ON r.symbol = e.symbol AND r.k = coalesce(k3, k2))
SELECT symbol, timestamp, direction, round(open, 6) AS entry, round(stop, 6) AS stop, exit_time, round(CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE rc END, 6) AS exit_price, reason FROM x""")
def atr_brackets(spark, sf):
    """Each hourly bar as an entry at its open, 1.5 mean true ranges to the stop, a day of bars."""
    b = hourly(spark, sf)
    return r6(P.atr_brackets(_signals(b.withColumn("move", F.col("close") - F.col("open")), ["timestamp"]), b, 1.5, 2.0, 24))


@query(f"""WITH {D.bars(60)}, x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
g AS (SELECT symbol, timestamp, CASE WHEN low > h2 THEN 1 ELSE -1 END AS direction, CASE WHEN low > h2 THEN h2 ELSE high END AS gap_low, CASE WHEN low > h2 THEN low ELSE l2 END AS gap_high FROM x WHERE low > h2 OR high < l2)
SELECT g.symbol, g.timestamp, g.direction, round(any_value(gap_low), 6) AS gap_low, round(any_value(gap_high), 6) AS gap_high, min(b.timestamp) AS filled_at FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.timestamp > g.timestamp AND CASE WHEN g.direction = 1 THEN b.low <= g.gap_low ELSE b.high >= g.gap_high END GROUP BY g.symbol, g.timestamp, g.direction""")
def gap_fills(spark, sf):
    b = hourly(spark, sf)
    return r6(P.gap_fills(R.fair_value_gaps(b), b))


_PIVOTS = f"""{D.bars(60)}, v AS (SELECT *, max(high) OVER c AS hh, min(low) OVER c AS ll, count(*) OVER c AS n, row_number() OVER w AS k, lead(timestamp, 2) OVER w AS confirmed_at FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp), c AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT *, CASE WHEN n = 5 AND high = hh THEN high END AS top, CASE WHEN n = 5 AND low = ll THEN low END AS bottom FROM v)"""


@query(f"""WITH {_PIVOTS}, p AS (SELECT symbol, timestamp, confirmed_at, 1 AS side, top AS level FROM m WHERE top IS NOT NULL UNION ALL SELECT symbol, timestamp, confirmed_at, -1, bottom FROM m WHERE bottom IS NOT NULL)
SELECT p.symbol, p.timestamp, p.confirmed_at, side, round(any_value(level), 6) AS level, min(b.timestamp) AS taken_at FROM p LEFT JOIN bars b ON b.symbol = p.symbol AND b.timestamp >= p.confirmed_at AND CASE WHEN side = 1 THEN b.high > level ELSE b.low < level END GROUP BY p.symbol, p.timestamp, p.confirmed_at, side""")
def level_takes(spark, sf):
    b = hourly(spark, sf)
    return r6(P.level_takes(R.equal_pivots(b), b))


@query(f"""WITH {_PIVOTS}, l AS (SELECT m.symbol, m.k, max(q.k) FILTER (WHERE q.bottom IS NOT NULL) AS lb, max(q.k) FILTER (WHERE q.top IS NOT NULL) AS lt FROM m JOIN m q ON q.symbol = m.symbol AND q.k <= m.k - 2 GROUP BY ALL),
f AS (SELECT m.symbol, m.k, max(q.bottom) FILTER (WHERE q.k < lb) AS ob, min(q.top) FILTER (WHERE q.k < lt) AS ot FROM m JOIN l USING (symbol, k) JOIN m q ON q.symbol = m.symbol AND q.k BETWEEN m.k - 6 AND m.k - 2 GROUP BY ALL),
x AS (SELECT m.*, min(low) OVER h AS mn, max(high) OVER h AS mx, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY k), h AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT x.symbol, x.timestamp, mn <= coalesce(ob, b.bottom) AS sweep_low, mx >= coalesce(ot, t.top) AS sweep_high, coalesce(low > h2, false) AS gap_up, coalesce(high < l2, false) AS gap_down
FROM (SELECT symbol, k, timestamp, high, low, mn, mx, h2, l2 FROM x) x LEFT JOIN l USING (symbol, k) LEFT JOIN f USING (symbol, k) LEFT JOIN (SELECT symbol, k, bottom FROM m) b ON b.symbol = x.symbol AND b.k = lb LEFT JOIN (SELECT symbol, k, top FROM m) t ON t.symbol = x.symbol AND t.k = lt""")
def retest_gates(spark, sf):
    b = hourly(spark, sf)
    return P.retest_gates(b, R.equal_pivots(b), lookback=6)
