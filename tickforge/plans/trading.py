"""Queries over ledgers, selection, replays, structure and validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import replay as R
from ..operators import scans as C
from ..operators import validation as V
from ..sources import fixtures as S
from . import sqlbase as D
from .market import hourly, r6
from .signals import _RF, _SIG, frame, signals

QUERIES, ORACLE = {}, {}
_O = "o AS (SELECT o_orderpriority AS grp, o_orderdate AS ts, o_orderkey AS seq, o_totalprice - 250000 AS pnl, o_orderstatus AS status, o_custkey AS custkey FROM orders)"
_EQ = f"""{_O}, q AS (SELECT *, round(100000 + sum(pnl) OVER w, 6) AS equity, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER w AS run FROM o WINDOW w AS (PARTITION BY grp ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY grp ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM q),
lr AS (SELECT grp, max(n) AS longest FROM (SELECT grp, run, count(*) AS n FROM q WHERE pnl < 0 GROUP BY ALL) GROUP BY grp)"""


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r2(df):
    """Doubles rounded to 2 places, where sums of money are large."""
    return df.select(*[F.round(F.round(c, 6), 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {_EQ}, m AS (SELECT grp, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl) AS net, avg(pnl) AS mean, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl < 0 THEN pnl END) AS avg_loss,
  max(pnl) AS best, min(pnl) AS worst, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS profit_factor, avg(pnl / 100000) / nullif(stddev_pop(pnl / 100000), 0) * sqrt(252) AS sharpe, max(peak - equity) AS max_drawdown FROM k GROUP BY grp)
SELECT m.grp, trades, wins, losses, longest AS max_losing_run, {', '.join(f'round({c}, 2) AS {c}' for c in 'net mean avg_win avg_loss best worst max_drawdown'.split())}, round(profit_factor, 6) AS profit_factor, round(sharpe, 6) AS sharpe, round(avg_win / -avg_loss, 6) AS payoff FROM m JOIN lr USING (grp)""")
def trade_metrics(spark, sf):
    m = M.trade_metrics(S.order_pnl(spark, sf), ["grp"])
    money = "net mean avg_win avg_loss best worst max_drawdown".split()
    return m.select("grp", "trades", "wins", "losses", "max_losing_run", *[F.round(c, 2).alias(c) for c in money], *[F.round(c, 6).alias(c) for c in ("profit_factor", "sharpe", "payoff")])


@query(f"WITH {_EQ} SELECT grp, ts, seq, round(equity, 2) AS equity, round(peak - equity, 2) AS drawdown FROM k")
def equity_drawdown(spark, sf):
    return r2(M.running(S.order_pnl(spark, sf), ["grp"], 100_000.0).select("grp", "ts", "seq", "equity", "drawdown"))


@query(f"WITH {_EQ} SELECT grp, longest FROM lr")
def losing_streak(spark, sf):
    return M.losing_runs(S.order_pnl(spark, sf), ["grp"])


def _periods(part: str) -> str:
    return f"WITH {_O} SELECT grp, date_trunc('{part}', ts)::DATE AS period, count(*) AS trades, round(sum(pnl), 2) AS net, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM o GROUP BY ALL"


def _period_query(spark, sf, part):
    o = S.order_pnl(spark, sf).groupBy("grp", F.trunc(F.to_date("ts"), part).alias("period"))
    return o.agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 2).alias("net"), F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


@query(_periods("year"))
def yearly_results(spark, sf):
    return _period_query(spark, sf, "year")


@query(_periods("month"))
def monthly_results(spark, sf):
    return _period_query(spark, sf, "month")


#: Buckets of the minutes held, by the limit below which they lie: fixed values.
HOLDING = {"00-05m": 5, "05-15m": 15, "15-60m": 60}
_TR = "t AS (SELECT ts, event_id AS seq, value - 50 AS pnl, user_id % 300 AS held FROM events)"
_DIMS = {"year": "year(ts)::VARCHAR", "month": "strftime(ts, '%Y-%m')", "hour": "hour(ts)::VARCHAR", "side": "CASE WHEN seq % 2 = 0 THEN 'long' ELSE 'short' END",
         "holding": "CASE WHEN held < 5 THEN '00-05m' WHEN held < 15 THEN '05-15m' WHEN held < 60 THEN '15-60m' ELSE '60m+' END"}


@query(f"WITH {_TR}, x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {c} AS bucket, pnl FROM t" for n, c in _DIMS.items()) + ") SELECT dimension, bucket, count(*) AS n, round(sum(pnl), 2) AS net, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM x GROUP BY ALL")
def trade_distributions(spark, sf):
    t = S.table(spark, sf, "events").select("ts", F.col("event_id").alias("seq"), (F.col("value") - 50).alias("pnl"), (F.col("user_id") % 300).alias("held"))
    dims = {"year": F.year("ts"), "month": F.date_format("ts", "yyyy-MM"), "hour": F.hour("ts"), "side": F.when(F.col("seq") % 2 == 0, "long").otherwise("short"), "holding": M.bucketed("held", HOLDING, "60m+")}
    d = M.by_dimension(t, dims)
    return d.select("dimension", "bucket", "n", F.round("net", 2).alias("net"), F.round("win_rate", 6).alias("win_rate"))


SCENARIOS = [("base", 0.0, 1.0), ("fees", 500.0, 1.0), ("slippage", 2500.0, 1.0), ("half", 1000.0, 0.5)]


@query(f"WITH {_O}, c(scenario, cost, scale) AS (VALUES {', '.join(f'({n!r}, {a}::DOUBLE, {b}::DOUBLE)' for n, a, b in SCENARIOS)}), x AS (SELECT grp, scenario, pnl * scale - cost AS p FROM o, c) SELECT grp, scenario, count(*) AS n, round(sum(p), 2) AS net, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM x GROUP BY ALL")
def cost_stress(spark, sf):
    c = F.broadcast(spark.createDataFrame(SCENARIOS, "scenario string, cost double, scale double"))  # four rows
    x = S.order_pnl(spark, sf).crossJoin(c).withColumn("p", F.col("pnl") * F.col("scale") - F.col("cost"))
    return x.groupBy("grp", "scenario").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("net"), F.round(F.avg(F.when(F.col("p") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


@query("SELECT l_returnflag, l_extendedprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE i = round_even(0.95::DOUBLE * (n - 1), 0)")
def nearest_rank_pct(spark, sf):
    return M.nearest_rank(S.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.95)


@query("SELECT l_linestatus, count(*) AS n, min(l_quantity) AS low, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS p75, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def distribution_summary(spark, sf):
    x = S.table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.max("l_quantity").alias("high"), F.avg("l_quantity").alias("mean"))
    return r6(x.select("l_linestatus", "n", "low", F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), "high", "mean"))


@query("SELECT o_orderpriority AS decision, coalesce(l.l_returnflag, 'pending') AS outcome, count(*) AS n FROM orders LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY ALL")
def confusion_matrix(spark, sf):
    l = S.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return S.table(spark, sf, "orders").join(l, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("decision"), F.coalesce("l_returnflag", F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_O}, a AS (SELECT grp, status, sum(pnl) AS net, count(*) AS n FROM o GROUP BY ALL) SELECT grp, status, n, round(net, 2) AS net, round(abs(net) / nullif(sum(abs(net)) OVER (PARTITION BY grp), 0), 6) AS share FROM a")
def attribution(spark, sf):
    from pyspark.sql import Window

    a = S.order_pnl(spark, sf).groupBy("grp", "status").agg(F.count("*").alias("n"), F.sum("pnl").alias("net"))
    share = F.abs("net") / F.nullif(F.sum(F.abs("net")).over(Window.partitionBy("grp")), F.lit(0.0))
    return a.select("grp", "status", "n", F.round("net", 2).alias("net"), F.round(share, 6).alias("share"))


@query(f"WITH {_O} SELECT ts, seq, round(pnl, 2) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY pnl DESC, seq) AS o FROM o) WHERE o = 1")
def one_trade_per_ts(spark, sf):
    return r2(M.one_per_key(S.order_pnl(spark, sf), ["ts"], [F.desc("pnl"), F.col("seq")]).select("ts", "seq", "pnl"))


_SPANS = "sp AS (SELECT event_type AS symbol, ts AS a, ts + to_minutes(5 + user_id % 40) AS b FROM events)"


@query(f"""WITH {_SPANS}, x AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM sp), y AS (SELECT *, sum(CASE WHEN e IS NULL OR a > e THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM x)
SELECT symbol, min(a) AS start, max(b) AS "end", count(*) AS parts FROM y GROUP BY symbol, g""")
def interval_merge(spark, sf):
    e = S.table(spark, sf, "events").selectExpr("event_type AS symbol", "ts AS a", "ts + make_dt_interval(0, 0, cast(5 + user_id % 40 AS int), 0) AS b")
    return M.merge_intervals(e, ["symbol"], "a", "b")


@query(f"WITH {_O} SELECT grp, seq, round(pnl, 2) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pnl DESC, seq) AS o FROM o) WHERE o <= 5 ORDER BY pnl DESC, seq LIMIT 20")
def capped_topk(spark, sf):
    return r2(M.capped_top(S.order_pnl(spark, sf), "grp", [F.desc("pnl"), F.col("seq")], 5, 20).select("grp", "seq", "pnl"))


@query(f"WITH {_O} SELECT grp, first(seq ORDER BY pnl DESC, seq) AS best, first(seq ORDER BY pnl, seq DESC) AS worst, last(seq ORDER BY ts, seq) AS latest FROM o GROUP BY grp")
def best_worst_latest(spark, sf):
    return S.order_pnl(spark, sf).groupBy("grp").agg(F.max_by("seq", F.struct("pnl", (-F.col("seq")).alias("s"))).alias("best"), F.min_by("seq", F.struct("pnl", (-F.col("seq")).alias("s"))).alias("worst"), F.max_by("seq", F.struct("ts", "seq")).alias("latest"))


@query(f"WITH {_EQ}, n AS (SELECT grp, ts, seq, equity, row_number() OVER (PARTITION BY grp ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY grp) AS c FROM k) SELECT grp, ts, seq, round(equity, 2) AS equity FROM n WHERE (i - 1) % 50 = 0 OR i = c")
def sampled_curve(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("grp")
    x = M.running(S.order_pnl(spark, sf), ["grp"], 100_000.0).withColumns({"i": F.row_number().over(w.orderBy("ts", "seq")), "c": F.count("*").over(w)})
    return r2(x.where("(i - 1) % 50 = 0 OR i = c").select("grp", "ts", "seq", "equity"))


RULES = {"few_trades": "n < 20", "low_win_rate": "win_rate < 0.5", "negative": "total <= 0", "low_profit_factor": "profit_factor IS NULL OR profit_factor < 1.1"}
_RS = f"{_SIG}, st AS (SELECT scan_type, direction, count(*) AS n, sum(p) AS total, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(CASE WHEN p > 0 THEN p ELSE 0 END) / nullif(sum(CASE WHEN p < 0 THEN -p ELSE 0 END), 0) AS profit_factor FROM e GROUP BY ALL)"
_REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in RULES.items()) + ")"


def rules_frame(spark, sf):
    return M.gates(C.edge_stats(signals(spark, sf), ["scan_type", "direction"]), RULES)


@query(f"WITH {_RS} SELECT scan_type, direction, n, {_REASONS} AS reasons, {_REASONS} = '' AS passed FROM st")
def hard_gates(spark, sf):
    return rules_frame(spark, sf).select("scan_type", "direction", "n", F.concat_ws(",", "reasons").alias("reasons"), "passed")


@query(f"""WITH {_RS}, g AS (SELECT *, {_REASONS} = '' AS passed, round(0.4 * win_rate + 0.4 * least(coalesce(profit_factor, 0), 3) / 3 + 0.2 * least(n, 100) / 100, 9) AS score FROM st)
SELECT scan_type, direction, passed, round(score, 6) AS score, row_number() OVER (ORDER BY passed DESC, score DESC, scan_type, direction)::INT AS rank FROM g""")
def leaderboard(spark, sf):
    from pyspark.sql import Window

    x = rules_frame(spark, sf).withColumn("score", F.round(0.4 * F.col("win_rate") + 0.4 * F.least(F.coalesce("profit_factor", F.lit(0.0)), F.lit(3.0)) / 3 + 0.2 * F.least("n", F.lit(100)) / 100, 9))
    w = Window.orderBy(F.desc("passed"), F.desc("score"), "scan_type", "direction")  # one row a rule
    return x.select("scan_type", "direction", "passed", F.round("score", 6).alias("score"), F.row_number().over(w).alias("rank"))


@query(f"""WITH {_O}, d AS (SELECT grp, ts::DATE AS day, sum(pnl) AS p, count(*) AS n FROM o GROUP BY ALL) SELECT grp, sum(n)::BIGINT AS trades, count(*) AS days, round(sum(n) / count(*), 6) AS trades_per_day, round(max(abs(p)) / sum(abs(p)), 6) AS concentration FROM d GROUP BY grp""")
def prescreen(spark, sf):
    d = S.order_pnl(spark, sf).groupBy("grp", F.to_date("ts").alias("day")).agg(F.sum("pnl").alias("p"), F.count("*").alias("n"))
    return r6(d.groupBy("grp").agg(F.sum("n").alias("trades"), F.count("*").alias("days"), (F.sum("n") / F.count("*")).alias("trades_per_day"), (F.max(F.abs("p")) / F.sum(F.abs("p"))).alias("concentration")))


# Replays: signals of two families, entered at the close, stop 4 and target 6 points away, held 12 bars.
_RP = f"""{D.features()}, {_RF}, ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM r), sg AS (
  SELECT symbol, i, 1 AS direction, close AS entry, 'pullback' AS regime FROM ix WHERE trend_bin = 1 AND ret5 < 0 AND ret1 > 0 AND close > ma20 UNION ALL
  SELECT symbol, i, -1 AS direction, close AS entry, 'pullback' AS regime FROM ix WHERE trend_bin = -1 AND ret5 > 0 AND ret1 < 0 AND close < ma20 UNION ALL
  SELECT symbol, i, 1, close, 'drift' FROM ix WHERE trend_bin = 1 AND volume_bin = -1 AND ret1 > 0 UNION ALL SELECT symbol, i, -1, close, 'drift' FROM ix WHERE trend_bin = -1 AND volume_bin = -1 AND ret1 < 0),
s0 AS (SELECT *, i * 10 + CASE regime WHEN 'pullback' THEN 0 ELSE 4 END + (direction + 1) AS signal_id, entry - 4 * direction AS stop, entry + 6 * direction AS target FROM sg),
hb AS (SELECT s0.symbol, signal_id, b.i AS bi, b.close AS bc, CASE WHEN direction = 1 AND b.low <= stop OR direction = -1 AND b.high >= stop THEN 'stop' WHEN direction = 1 AND b.high >= target OR direction = -1 AND b.low <= target THEN 'target' END AS hit, stop, target
  FROM s0 JOIN ix b ON b.symbol = s0.symbol AND b.i > s0.i AND b.i <= s0.i + 12),
ex AS (SELECT symbol, signal_id, coalesce(min(CASE WHEN hit IS NOT NULL THEN bi END), max(bi)) AS exit_i, coalesce(arg_min(hit, bi) FILTER (hit IS NOT NULL), 'time') AS reason,
  coalesce(arg_min(CASE hit WHEN 'stop' THEN stop ELSE target END, bi) FILTER (hit IS NOT NULL), arg_max(bc, bi)) AS exit_price FROM hb GROUP BY ALL),
xs AS (SELECT s0.*, exit_i, reason, exit_price FROM s0 JOIN ex USING (symbol, signal_id))"""


def replay_inputs(spark, sf):
    f = R.indexed(frame(spark, sf).withColumns({c: F.round(c, 9) for c in C.ROUNDED}))
    fam = {"pullback": C.SET_A["trend_pullback_reclaim"], "drift": C.SET_A["low_volume_drift"]}
    hits = F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("regime"), F.lit(d).alias("direction"))) for n, sides in fam.items() for d, c in zip((1, -1), sides)])
    s = f.withColumn("x", F.explode(F.array_compact(hits))).selectExpr("symbol", "i", "x.direction", "close AS entry", "x.regime")
    s = s.withColumns({"signal_id": F.col("i") * 10 + F.when(F.col("regime") == "pullback", 0).otherwise(4) + F.col("direction") + 1, "stop": F.col("entry") - 4 * F.col("direction"), "target": F.col("entry") + 6 * F.col("direction")})
    s = s.withColumn("signal_id", F.concat_ws(":", "symbol", "signal_id"))
    return s, f.select("symbol", "i", "timestamp", "high", "low", "close")


def exits(spark, sf):
    s, b = replay_inputs(spark, sf)
    return R.exit_sim(s, b, 12)


@query(f"WITH {_RP} SELECT symbol || ':' || signal_id AS signal_id, exit_i::INT AS exit_i, reason, round(exit_price, 6) AS exit_price FROM xs")
def exit_sim(spark, sf):
    return r6(exits(spark, sf).where("exit_i IS NOT NULL").select("signal_id", "exit_i", "reason", "exit_price"))


@query(f"""WITH {D.bars(60)}, x AS (SELECT symbol, timestamp, close, max(high) OVER w AS fh, min(low) OVER w AS fl, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT symbol, timestamp, CASE WHEN round(close - fl, 9) >= 3 THEN 'stop' WHEN round(fh - close, 9) >= 5 THEN 'target' ELSE 'open' END AS outcome FROM x WHERE n = 6""")
def fwd_bracket(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(0, 5)
    x = hourly(spark, sf).withColumns({"fh": F.max("high").over(w), "fl": F.min("low").over(w), "n": F.count("*").over(w)}).where("n = 6")
    return x.select("symbol", "timestamp", F.when(F.round(F.col("close") - F.col("fl"), 9) >= 3, "stop").when(F.round(F.col("fh") - F.col("close"), 9) >= 5, "target").otherwise("open").alias("outcome"))


_CHOOSE = f"""{_RP}, od AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, symbol || ':' || signal_id) AS k FROM xs),
pick AS (SELECT symbol, k, signal_id, exit_i, true AS taken, exit_i AS busy FROM od WHERE k = 1 UNION ALL
  SELECT od.symbol, od.k, od.signal_id, od.exit_i, od.i > pick.busy, CASE WHEN od.i > pick.busy THEN od.exit_i ELSE pick.busy END FROM pick JOIN od ON od.symbol = pick.symbol AND od.k = pick.k + 1)"""


@query(f"WITH RECURSIVE {_CHOOSE} SELECT symbol, symbol || ':' || signal_id AS signal_id, exit_i::INT AS exit_i FROM pick WHERE taken")
def single_slot_replay(spark, sf):
    return R.select_signals(exits(spark, sf), 1).select("symbol", "signal_id", "exit_i")


_STILL = "list_filter(p.open, lambda x: x > od.i)"
_SLOTS = f"""{_RP}, od AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, symbol || ':' || signal_id) AS k FROM xs)"""


@query(f"""WITH RECURSIVE {_SLOTS}, pick AS (SELECT symbol, k, signal_id, i, exit_i, true AS taken, [exit_i] AS open FROM od WHERE k = 1 UNION ALL
  SELECT od.symbol, od.k, od.signal_id, od.i, od.exit_i, len({_STILL}) < 4, CASE WHEN len({_STILL}) < 4 THEN list_append({_STILL}, od.exit_i) ELSE {_STILL} END FROM pick p JOIN od ON od.symbol = p.symbol AND od.k = p.k + 1)
SELECT symbol, symbol || ':' || signal_id AS signal_id, i::INT AS i, exit_i::INT AS exit_i FROM pick WHERE taken""")
def multi_slot_replay(spark, sf):
    return R.select_signals(exits(spark, sf), 4).select("symbol", "signal_id", "i", "exit_i")


_FLAT = _RP.replace("AND b.i > s0.i AND b.i <= s0.i + 12)", "AND b.i > s0.i AND b.i <= s0.i + 12 JOIN ix a ON a.symbol = s0.symbol AND a.i = s0.i AND a.day = b.day)").replace("'time') AS reason", "CASE WHEN max(bi) < any_value(si) + 12 THEN 'date_change' ELSE 'time' END) AS reason").replace("SELECT s0.symbol, signal_id, b.i AS bi", "SELECT s0.symbol, signal_id, s0.i AS si, b.i AS bi")


@query(f"""WITH RECURSIVE {_FLAT}, od AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, symbol || ':' || signal_id) AS k FROM xs), pick AS (SELECT symbol, k, signal_id, i, exit_i, reason, true AS taken, [exit_i] AS open FROM od WHERE k = 1 UNION ALL
  SELECT od.symbol, od.k, od.signal_id, od.i, od.exit_i, od.reason, len({_STILL}) < 3, CASE WHEN len({_STILL}) < 3 THEN list_append({_STILL}, od.exit_i) ELSE {_STILL} END FROM pick p JOIN od ON od.symbol = p.symbol AND od.k = p.k + 1)
SELECT symbol, symbol || ':' || signal_id AS signal_id, i::INT AS i, exit_i::INT AS exit_i, reason FROM pick WHERE taken""")
def basket_replay(spark, sf):
    """Three slots; positions are closed at the last bar of their day."""
    s, b = replay_inputs(spark, sf)
    return R.select_signals(R.exit_sim(s, b, 12, flatten=True), 3).select("symbol", "signal_id", "i", "exit_i", "reason")


_REST = "od.i - coalesce(CASE od.regime WHEN 'pullback' THEN p.last_p ELSE p.last_d END, -1000) >= 5"


@query(f"""WITH RECURSIVE {_SLOTS}, pick AS (SELECT symbol, k, signal_id, regime, i, exit_i, true AS taken, [exit_i] AS open, CASE WHEN regime = 'pullback' THEN i END AS last_p, CASE WHEN regime <> 'pullback' THEN i END AS last_d FROM od WHERE k = 1 UNION ALL
  SELECT od.symbol, od.k, od.signal_id, od.regime, od.i, od.exit_i, len({_STILL}) < 4 AND {_REST}, CASE WHEN len({_STILL}) < 4 AND {_REST} THEN list_append({_STILL}, od.exit_i) ELSE {_STILL} END,
    CASE WHEN od.regime = 'pullback' AND len({_STILL}) < 4 AND {_REST} THEN od.i ELSE p.last_p END, CASE WHEN od.regime <> 'pullback' AND len({_STILL}) < 4 AND {_REST} THEN od.i ELSE p.last_d END FROM pick p JOIN od ON od.symbol = p.symbol AND od.k = p.k + 1)
SELECT symbol, symbol || ':' || signal_id AS signal_id, regime, i::INT AS i, exit_i::INT AS exit_i FROM pick WHERE taken""")
def cooldown_replay(spark, sf):
    return R.select_signals(exits(spark, sf), 4, 5, "regime").select("symbol", "signal_id", "regime", "i", "exit_i")


@query(f"WITH RECURSIVE {_CHOOSE} SELECT reason, count(*) AS n, round(sum((exit_price - entry) * direction), 6) AS points FROM pick JOIN xs USING (symbol, signal_id) WHERE taken GROUP BY reason")
def nonoverlap(spark, sf):
    x = R.select_signals(exits(spark, sf), 1)
    return r6(x.groupBy("reason").agg(F.count("*").alias("n"), F.sum((F.col("exit_price") - F.col("entry")) * F.col("direction")).alias("points")))


@query(f"""WITH {D.bars(60)}, x AS (SELECT *, greatest(max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS hh, least(min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS ll,
  count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, lead(timestamp, 2) OVER (w) AS confirmed_at FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
SELECT symbol, timestamp, round(high, 6) AS high, round(low, 6) AS low, n = 5 AND round(high - hh, 9) > 0 AS is_high, n = 5 AND round(ll - low, 9) > 0 AS is_low, confirmed_at FROM x WHERE n = 5 AND (round(high - hh, 9) > 0 OR round(ll - low, 9) > 0)""")
def pivots(spark, sf):
    return r6(R.pivots(hourly(spark, sf)))


@query(f"""WITH {D.bars(60)}, x AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
SELECT symbol, timestamp, CASE WHEN low > h2 THEN 1 ELSE -1 END AS direction, round(CASE WHEN low > h2 THEN h2 ELSE high END, 6) AS gap_low, round(CASE WHEN low > h2 THEN low ELSE l2 END, 6) AS gap_high FROM x WHERE low > h2 OR high < l2""")
def fvg(spark, sf):
    return r6(R.fair_value_gaps(hourly(spark, sf)))


def _sweep_sql(side: str, sign: int) -> str:
    worst, far, op = ("min", "least", ">") if sign == 1 else ("max", "greatest", "<")
    leads = ", ".join(f"lead({c}, {k}) OVER (w) AS {n}{k}" for n, c in (("c", "close"), ("x", side)) for k in range(4))
    steps = " ".join(f"WHEN c{k} {op} level THEN {{{k}}}" for k in range(4))
    pick = lambda f: "CASE " + steps.format(*map(f, range(4))) + " END"
    return f"""SELECT symbol, timestamp, {sign} AS direction, level, {pick(lambda k: f"{far}({', '.join(f'x{j}' for j in range(k + 1))})")} AS extreme, {pick(str)} AS k, {pick(lambda k: f'c{k}')} AS rc
  FROM (SELECT *, {worst}({side}) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS level, {leads} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) WHERE round((level - {side}) * {sign}, 9) > 0.25"""


@query(f"""WITH {D.bars(60)}, y AS ({_sweep_sql('low', 1)} UNION ALL {_sweep_sql('high', -1)})
SELECT symbol, timestamp, direction, round(level, 6) AS level, round(extreme, 6) AS extreme, k AS bars_to_reclaim, round(rc, 6) AS reclaim_close FROM y WHERE k IS NOT NULL""")
def sweep(spark, sf):
    b = hourly(spark, sf)
    return r6(R.sweeps(b).unionByName(R.sweeps(b, direction=-1)))


@query(f"""WITH {D.bars(60)}, x AS (SELECT *, max(high) OVER v AS hh, min(low) OVER v AS ll, count(*) OVER v AS n, lead(timestamp, 2) OVER (PARTITION BY symbol ORDER BY timestamp) AS confirmed_at FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT symbol, timestamp, round(high, 6) AS high, round(low, 6) AS low, high = hh AS is_high, low = ll AS is_low, confirmed_at FROM x WHERE n = 5 AND (high = hh OR low = ll)""")
def pivots_equal(spark, sf):
    return r6(R.equal_pivots(hourly(spark, sf)))


_PV = f"""{D.bars(60)}, px AS (SELECT *, greatest(max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS hh, least(min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS ll,
  count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, row_number() OVER (w) - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
bz AS (SELECT a.symbol, a.timestamp, a.i, a.close, CASE WHEN p.n = 5 AND round(p.high - p.hh, 9) > 0 THEN p.high END AS top, CASE WHEN p.n = 5 AND round(p.ll - p.low, 9) > 0 THEN p.low END AS bottom FROM px a LEFT JOIN px p ON p.symbol = a.symbol AND p.i = a.i - 2)"""
#: A bar's work on the state of the bar before: stacks of unbroken pivots, and the trend after each side.
_UP, _DOWN = "b.close > list_last(t1) + 0.25", "b.close < list_last(b1) - 0.25"


@query(f"""WITH RECURSIVE {_PV}, st AS (SELECT symbol, -1::BIGINT AS i, []::DOUBLE[] AS tops, []::DOUBLE[] AS bottoms, 0 AS trend, NULL::DOUBLE AS up_level, NULL::DOUBLE AS down_level, 0 AS before, NULL::TIMESTAMP AS timestamp FROM (SELECT DISTINCT symbol FROM bz) UNION ALL
  SELECT symbol, i, CASE WHEN up THEN t1[:-2] ELSE t1 END, CASE WHEN down THEN b1[:-2] ELSE b1 END, CASE WHEN down THEN -1 WHEN up THEN 1 ELSE trend END, CASE WHEN up THEN list_last(t1) END, CASE WHEN down THEN list_last(b1) END, trend, timestamp FROM (
    SELECT *, coalesce({_UP.replace('b.', '')}, false) AS up, coalesce({_DOWN.replace('b.', '')}, false) AS down FROM (
      SELECT b.symbol, b.i, b.close, b.timestamp, s.trend, CASE WHEN b.top IS NULL THEN s.tops ELSE list_append(s.tops, b.top) END AS t1, CASE WHEN b.bottom IS NULL THEN s.bottoms ELSE list_append(s.bottoms, b.bottom) END AS b1 FROM st s JOIN bz b ON b.symbol = s.symbol AND b.i = s.i + 1)))
SELECT symbol, timestamp, 1 AS direction, CASE WHEN before = 1 THEN 'BOS' ELSE 'CHOCH' END AS event, round(up_level, 6) AS level FROM st WHERE up_level IS NOT NULL
UNION ALL SELECT symbol, timestamp, -1, CASE WHEN up_level IS NULL AND before = -1 THEN 'BOS' ELSE 'CHOCH' END, round(down_level, 6) FROM st WHERE down_level IS NOT NULL""")
def structure_events(spark, sf):
    return r6(R.structure_events(hourly(spark, sf)).drop("pivot_time"))


FOLDS = (date(1995, 1, 1), date(2001, 12, 31), 365, 90, 180, 180, 5, 60)


def _folds_sql(folds: tuple = FOLDS) -> str:
    first, last, train, val, test, step, emb, hold = folds
    return f"""fo AS (SELECT k::INT AS fold, DATE '{first}' + (k * {step})::INT AS a FROM range(100) t(k)), fd AS (
  SELECT fold, 'train' AS split, a AS from_day, a + {train - 1} AS to_day FROM fo UNION ALL SELECT fold, 'validation', a + {train + emb}, a + {train + emb + val - 1} FROM fo
  UNION ALL SELECT fold, 'test', a + {train + 2 * emb + val}, a + {train + 2 * emb + val + test - 1} FROM fo),
folds AS (SELECT * FROM fd WHERE fold IN (SELECT fold FROM fd WHERE split = 'test' AND to_day <= DATE '{last}' - {hold}))"""


@query(f"WITH {_folds_sql()} SELECT fold, split, from_day, to_day FROM folds")
def rolling_folds(spark, sf):
    return V.rolling_folds(spark, *FOLDS)


@query(f"WITH {_O}, {_folds_sql()} SELECT fold, split, grp, count(*) AS n, round(sum(pnl), 2) AS net FROM o JOIN folds ON ts::DATE BETWEEN from_day AND to_day GROUP BY ALL")
def fold_metrics(spark, sf):
    x = V.in_folds(S.order_pnl(spark, sf), V.rolling_folds(spark, *FOLDS))
    return x.groupBy("fold", "split", "grp").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("net"))


@query(f"""WITH {_O}, {_folds_sql()}, st AS (SELECT fold, split, grp, status, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS wr, sum(pnl) AS total FROM o JOIN folds ON ts::DATE BETWEEN from_day AND to_day GROUP BY ALL)
SELECT a.fold, a.grp, a.status, a.n AS train_n, round(a.wr, 6) AS train_win_rate, b.n AS test_n, round(b.wr, 6) AS test_win_rate, round(b.total, 2) AS test_total FROM st a JOIN st b ON a.fold = b.fold AND a.grp = b.grp AND a.status = b.status AND a.split = 'train' AND b.split = 'test' WHERE a.n >= 10 AND a.wr >= 0.5""")
def walk_forward_match(spark, sf):
    x = V.walk_forward(S.order_pnl(spark, sf), V.rolling_folds(spark, *FOLDS), ["grp", "status"], 10, 0.5)
    return x.select("fold", "grp", "status", "train_n", F.round("train_win_rate", 6).alias("train_win_rate"), "test_n", F.round("test_win_rate", 6).alias("test_win_rate"), F.round("test_total", 2).alias("test_total"))


@query(f"""WITH {_O}, g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT grp FROM o)),
u AS (SELECT mask, string_agg(grp, '+' ORDER BY grp) AS subset, count(*) AS size, list(grp) AS members FROM range(1, 64) t(mask) JOIN g ON (mask >> k) & 1 = 1 WHERE mask < (1 << m) GROUP BY mask HAVING count(*) <= 3)
SELECT subset, size, count(*) AS n, round(sum(pnl), 2) AS net FROM u, (SELECT grp, pnl FROM o) x WHERE list_contains(members, x.grp) GROUP BY ALL""")
def subset_metrics(spark, sf):
    return M.subset_totals(S.order_pnl(spark, sf), "grp", 3).select("subset", "size", "n", F.round("net", 2).alias("net"))


@query("WITH g AS (SELECT a, b, c FROM (SELECT unnest([2, 3, 4]) AS a), (SELECT unnest([5, 10]) AS b), (SELECT unnest([1, 2, 3]) AS c) WHERE a * c <= 8) SELECT a, b, c, sha256('a=' || a || ';b=' || b || ';c=' || c) AS variant FROM g")
def param_grid(spark, sf):
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("a")).withColumn("b", F.explode(F.array(F.lit(5), F.lit(10)))).withColumn("c", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("a * c <= 8")
    return g.select("a", "b", "c", F.sha2(F.format_string("a=%d;b=%d;c=%d", "a", "b", "c"), 256).alias("variant"))


@query(f"WITH {_O}, y AS (SELECT unnest([1996, 1998, 2000]) AS year) SELECT y.year, grp, count(*) FILTER (year(ts) < y.year) AS train_n, count(*) FILTER (year(ts) >= y.year) AS test_n, round(sum(CASE WHEN year(ts) < y.year THEN pnl END), 2) AS train_net, round(sum(CASE WHEN year(ts) >= y.year THEN pnl END), 2) AS test_net FROM o, y GROUP BY ALL")
def activation_years(spark, sf):
    o = S.order_pnl(spark, sf).withColumn("year", F.explode(F.array(*map(F.lit, (1996, 1998, 2000)))))
    before = F.year("ts") < F.col("year")
    return o.groupBy("year", "grp").agg(F.count_if(before).alias("train_n"), F.count_if(~before).alias("test_n"), F.round(F.sum(F.when(before, F.col("pnl"))), 2).alias("train_net"), F.round(F.sum(F.when(~before, F.col("pnl"))), 2).alias("test_net"))
