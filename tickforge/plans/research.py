"""Queries over reports of a research run, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import replay as R
from ..operators import research as Y
from ..operators import validation as V
from ..sources import fixtures as S
from . import sqlbase as D
from .market import hourly, r6
from .trading import _O, FOLDS, _folds_sql, r2

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT o_orderpriority AS grp, o_orderdate AS ts, o_orderkey AS seq, o_totalprice - 250000 AS pnl FROM orders), q AS (SELECT *, round(sum(pnl) OVER w, 6) AS equity, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER w AS run FROM o WINDOW w AS (PARTITION BY grp ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY grp ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) - equity AS dd FROM q), l AS (SELECT grp, max(n) AS longest FROM (SELECT grp, run, count(*) AS n FROM q WHERE pnl < 0 GROUP BY ALL) GROUP BY grp),
m AS (SELECT grp, count(*) AS trades, count(*) / 2557.0::DOUBLE * 365 AS annual_trades, sum(pnl) AS net, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, max(dd) AS max_drawdown, max(pnl) FILTER (pnl > 0) AS best, min(pnl) FILTER (pnl < 0) AS worst FROM k GROUP BY grp)
SELECT grp, trades, round(annual_trades, 6) AS annual_trades, round(net, 2) AS net, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor, round(max_drawdown, 2) AS max_drawdown, round(best, 2) AS best, round(worst, 2) AS worst, round(net / nullif(max_drawdown, 0), 6) AS return_to_drawdown, coalesce(longest, 0) AS max_losing_run,
  round(net / 100000, 6) AS net_return, round(net / 500000, 6) AS net_return_on_notional FROM m LEFT JOIN l USING (grp)""")
def signal_metrics(spark, sf):
    m = Y.with_returns(Y.signal_metrics(S.order_pnl(spark, sf), ["grp"], 2557), ["net"], 100_000, 500_000)
    money = ("net", "max_drawdown", "best", "worst")
    return m.select("grp", "trades", "max_losing_run", *[F.round(c, 2).alias(c) for c in money], *[F.round(c, 6).alias(c) for c in ("annual_trades", "win_rate", "profit_factor", "return_to_drawdown", "net_return", "net_return_on_notional")])


@query("SELECT l_returnflag AS grp, round(sum(round(l_extendedprice * (1 - l_discount) - 30000, 6)::DECIMAL(18, 6))::DOUBLE / sum(l_quantity), 6) AS extra_cost FROM lineitem GROUP BY 1")
def break_even(spark, sf):
    t = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000, 6).cast("decimal(18,6)").alias("pnl"), F.col("l_quantity").alias("contracts"))
    t = t.groupBy("grp").agg(F.sum("pnl").cast("double").alias("pnl"), F.sum("contracts").alias("contracts"))
    return r6(Y.break_even_cost(t, ["grp"]))


#: Candidates made of each clerk's orders: the test part is 1998 and 1999, validation before and holdout after it.
_SCALE = 20
_PARTS = """o AS (SELECT o_custkey % 40 AS cand, year(o_orderdate)::INT AS y, o_orderdate AS ts, o_orderkey AS seq, round((o_totalprice - 120000) / 20, 4) AS pnl FROM orders),
q AS (SELECT *, round(sum(pnl) OVER w, 4) AS eq FROM o WHERE y IN (1998, 1999) WINDOW w AS (PARTITION BY cand ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)), dd AS (SELECT cand, max(greatest(0, pk) - eq) AS dd FROM (SELECT *, max(eq) OVER (PARTITION BY cand ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS pk FROM q) GROUP BY cand),
yr AS (SELECT cand, y, sum(pnl::DECIMAL(18, 4))::DOUBLE AS net, CASE WHEN count(*) > 1 AND round(stddev_pop(pnl), 6) > 0 THEN round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 6) END AS sh FROM o GROUP BY ALL),
pt AS (SELECT cand, CASE WHEN y < 1998 THEN 'validation' WHEN y > 1999 THEN 'holdout' ELSE 'test' END AS part, count(*) AS n, sum(pnl::DECIMAL(18, 4))::DOUBLE AS net, CASE WHEN count(*) > 1 AND round(stddev_pop(pnl), 6) > 0 THEN round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 6) END AS sh,
  round(sum(CASE WHEN pnl > 0 THEN pnl::DECIMAL(18, 4) END)::DOUBLE / nullif(sum(CASE WHEN pnl < 0 THEN -pnl::DECIMAL(18, 4) END)::DOUBLE, 0), 6) AS pf FROM o GROUP BY ALL),
fo AS (SELECT cand, count(*) AS folds, count(*) FILTER (net > 0) AS positive_folds, round(quantile_cont(sh, 0.5), 6) AS median_fold_sharpe, round(count(*) FILTER (net > 0) / count(*), 9) AS pyr FROM yr GROUP BY cand)"""
_CAND = f"""{_PARTS},
c AS (SELECT t.cand, t.n / 730.0::DOUBLE * 365 * 40 AS aty, t.sh AS ts, t.net AS tn, t.pf, t.net / t.n AS mean, dd.dd, h.sh AS hs, h.net AS hn, v.sh AS vs, folds, positive_folds, median_fold_sharpe AS mfs, pyr, 100 + 20 * (t.cand % 40) AS combos
  FROM pt t JOIN dd USING (cand) JOIN fo USING (cand) LEFT JOIN pt h ON h.cand = t.cand AND h.part = 'holdout' LEFT JOIN pt v ON v.cand = t.cand AND v.part = 'validation' WHERE t.part = 'test')"""
#: All candidates, with the metrics of no trades for a part without orders.
_ALL = f"""{_PARTS},
c AS (SELECT fo.cand, coalesce(t.n, 0) / 730.0::DOUBLE * 365 * 40 AS aty, t.sh AS ts, coalesce(t.net, 0) AS tn, t.pf, t.net / t.n AS mean, coalesce(dd.dd, 0) AS dd, h.sh AS hs, coalesce(h.net, 0) AS hn, v.sh AS vs, folds, positive_folds, median_fold_sharpe AS mfs, pyr, 100 + 20 * (fo.cand % 40) AS combos
  FROM fo LEFT JOIN pt t ON t.cand = fo.cand AND t.part = 'test' LEFT JOIN dd ON dd.cand = fo.cand LEFT JOIN pt h ON h.cand = fo.cand AND h.part = 'holdout' LEFT JOIN pt v ON v.cand = fo.cand AND v.part = 'validation' WHERE fo.cand IS NOT NULL)"""


def candidates(spark, sf):
    """A row for each candidate, with nulls for a part without orders."""
    o = S.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("cand"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.round((F.col("o_totalprice") - 120_000) / _SCALE, 4).alias("pnl"))
    money = F.col("pnl").cast("decimal(18,4)")
    total = F.sum(money).cast("double")
    sharpe = F.when((F.count("*") > 1) & (F.round(F.stddev_pop("pnl"), 6) > 0), F.round(F.avg("pnl") / F.stddev_pop("pnl") * F.sqrt(F.lit(252.0)), 6))
    years = o.groupBy("cand", "y").agg(total.alias("net"), sharpe.alias("sh"))
    folds = years.groupBy("cand").agg(F.count("*").alias("folds"), F.count_if(F.col("net") > 0).alias("positive_folds"), F.round(F.percentile("sh", 0.5), 6).alias("median_fold_sharpe"), F.round(F.count_if(F.col("net") > 0) / F.count("*"), 9).alias("positive_year_ratio"))
    part = F.when(F.col("y") < 1998, "validation").when(F.col("y") > 1999, "holdout").otherwise("test")
    gain, loss = F.sum(F.when(money > 0, money)).cast("double"), F.sum(F.when(money < 0, -money)).cast("double")
    parts = o.groupBy("cand", part.alias("part")).agg(F.count("*").alias("n"), total.alias("net"), sharpe.alias("sharpe"), F.round(gain / F.nullif(loss, F.lit(0.0)), 6).alias("profit_factor"))
    draw = M.running(o.where("y IN (1998, 1999)"), ["cand"]).groupBy("cand").agg(F.max("drawdown").alias("test_max_drawdown"))
    test = parts.where("part = 'test'").select("cand", (F.col("n") / F.lit(730.0) * 365 * 40).alias("test_annual_trades"), F.col("sharpe").alias("test_sharpe"), F.col("net").alias("test_net"), F.col("profit_factor").alias("test_profit_factor"), (F.col("net") / F.col("n")).alias("test_mean"))
    side = lambda p: parts.where(F.col("part") == p).select("cand", F.col("sharpe").alias(f"{p}_sharpe"), F.col("net").alias(f"{p}_net"))
    c = folds.where("cand IS NOT NULL").join(test, "cand", "left").join(draw, "cand", "left").join(side("holdout"), "cand", "left").join(side("validation"), "cand", "left")
    return c.withColumns({"combinations": (100 + 20 * F.col("cand")).cast("long"), "round_trip_cost": F.lit(10.0)})


_DECAY = "CASE WHEN {a} > 0 THEN ({a} - {b}) / {a} END"


@query(f"""WITH {_ALL}, g AS (SELECT *, list_filter([CASE WHEN aty <= 1000 THEN 'annual_trades_test' END, CASE WHEN ts IS NULL OR ts <= 2 THEN 'sharpe_test_aggregate' END, CASE WHEN mfs IS NULL OR mfs <= 1.5 THEN 'median_sharpe_test_fold' END, CASE WHEN tn <= 0 THEN 'net_pnl_test' END,
  CASE WHEN hn <= 0 THEN 'net_pnl_final_holdout' END, CASE WHEN dd > 10000 THEN 'max_drawdown_test' END, CASE WHEN pf IS NULL OR pf <= 1.1 THEN 'profit_factor_test' END, CASE WHEN mean IS NULL OR mean <= 15 THEN 'avg_trade_net_pnl' END, CASE WHEN positive_folds / folds < 0.6 THEN 'positive_test_fold_ratio' END,
  CASE WHEN pyr < 0.6 THEN 'positive_year_ratio' END, CASE WHEN vs IS NULL OR vs <= 0 THEN 'validation_sharpe' END, CASE WHEN vs > 0 AND coalesce({_DECAY.format(a='vs', b='ts')}, 9) > 0.5 THEN 'validation_to_test_sharpe_decay' END, CASE WHEN hs < 0.7::DOUBLE * ts THEN 'final_holdout_sharpe_decay' END,
  CASE WHEN {_DECAY.format(a='ts', b='hs')} > 0.5 THEN 'test_to_holdout_sharpe_decay' END], lambda x: x IS NOT NULL) AS rs FROM c)
SELECT cand, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS passed, CASE WHEN len(rs) = 0 THEN round((0.35::DOUBLE * least(least(coalesce(ts, 0), coalesce(hs, 0)) / 4, 1) + 0.2::DOUBLE * least(greatest(tn, 0) / 100000, 1) + 0.2::DOUBLE * (positive_folds / folds + pyr) / 2 + 0.15::DOUBLE / (1 + dd / 10000) + 0.1::DOUBLE * least(aty / 3000, 1))
  * CASE WHEN combos > 500 THEN sqrt(500.0 / combos) ELSE 1 END, 6) END AS score FROM g""")
def candidate_gates(spark, sf):
    none = {c: F.coalesce(c, F.lit(0.0)) for c in ("test_annual_trades", "test_net", "test_max_drawdown", "holdout_net")}
    g = Y.hard_gates(candidates(spark, sf).withColumns(none))
    return r6(g.select("cand", F.array_join("reasons", ",").alias("reasons"), "passed", "score"))


@query(f"""WITH {_CAND}, p AS (SELECT cand, ts, sqrt(2 * ln(combos)) / sqrt(folds) AS pen FROM c) SELECT cand, round(pen, 6) AS penalty, round(ts - pen, 6) AS adjusted_sharpe, round(CASE WHEN ts <> 0 THEN least(1, greatest(0, pen / abs(ts))) END, 6) AS proxy FROM p""")
def overfitting_report(spark, sf):
    return r6(Y.overfitting(candidates(spark, sf).where("test_max_drawdown IS NOT NULL")).select("cand", "penalty", "adjusted_sharpe", "proxy"))


# Trades enter at every tick; the context of a tick is that of the calendar, with importance 2 as high.
_GATED = f"""{D.TICKS}, c AS (SELECT s_suppkey AS event_id, TIMESTAMP '2024-01-01' + to_minutes(s_suppkey * 43 % 43200) AS event_time, s_nationkey % 3 AS importance, ['click', 'error', 'purchase', 'signup', 'view', '*'][s_suppkey % 6 + 1] AS es FROM supplier),
h AS (SELECT seq, importance, event_id, CASE WHEN timestamp < event_time THEN 'pre_event' WHEN timestamp <= event_time + INTERVAL 10 MINUTES THEN 'release_window' ELSE 'post_event' END AS state FROM ticks JOIN c ON timestamp BETWEEN event_time - INTERVAL 30 MINUTES AND event_time + INTERVAL 55 MINUTES AND (es = symbol OR es = '*')),
g AS (SELECT seq, first(state ORDER BY importance DESC, event_id) AS state, max(importance) AS imp FROM h GROUP BY seq), t AS (SELECT seq, symbol, mid - 105 AS pnl, coalesce(state, 'normal') AS state, imp FROM ticks LEFT JOIN g USING (seq)),
a AS (SELECT *, CASE WHEN state = 'normal' THEN 'allow' WHEN imp = 2 AND state = 'release_window' THEN 'block' WHEN state = 'pre_event' THEN 'block' ELSE 'delay' END AS action, CASE WHEN state = 'normal' THEN NULL WHEN imp = 2 AND state = 'release_window' THEN 'high_impact_release_window' WHEN state = 'pre_event' THEN 'pre_event_blackout' ELSE 'event_policy_requires_extra_confirmation' END AS reason FROM t)"""


def gated(spark, sf):
    ticks = S.ticks(spark, sf)
    context = J.event_context(ticks.select("symbol", "timestamp", F.col("seq").alias("point_id")), S.macro_events(spark, sf))
    context = context.select("symbol", "timestamp", "event_state", F.when(F.col("max_importance") == 2, "high").otherwise("low").alias("importance")).dropDuplicates(["symbol", "timestamp"])
    trades = ticks.select(F.col("seq"), "symbol", F.col("timestamp").alias("entry_time"), (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("exit_time"), (F.col("mid") - 105).alias("pnl"))
    t = Y.with_context(trades, context)
    return t.withColumn("p", Y.event_policy("entry_state", "entry_importance", "require_extra_confirmation", pre_minutes=30)).select("*", "p.*")


@query(f"WITH {_GATED} SELECT seq, state AS entry_state, action, reason FROM a")
def event_policy(spark, sf):
    return gated(spark, sf).select("seq", "entry_state", "action", "reason")


@query(f"""WITH {_GATED} SELECT symbol, count(*) FILTER (state <> 'normal') AS event_trades, count(*) FILTER (state = 'normal') AS other_trades, count(*) FILTER (action = 'block') AS blocked, round(sum(round(pnl, 6)::DECIMAL(18, 6)) FILTER (action <> 'block' AND state <> 'normal')::DOUBLE, 6) AS event_net,
  round(sum(round(pnl, 6)::DECIMAL(18, 6)) FILTER (action <> 'block' AND state = 'normal')::DOUBLE, 6) AS other_net, round(count(*) FILTER (state <> 'normal' OR action = 'block') / count(*), 6) AS dependency FROM a GROUP BY symbol""")
def event_attribution(spark, sf):
    x = Y.event_attribution(gated(spark, sf).withColumn("pnl", F.round("pnl", 6).cast("decimal(18,6)")), ["symbol"])
    return r6(x.withColumns({"event_net": F.col("event_net").cast("double"), "other_net": F.col("other_net").cast("double")}))


@query(f"""WITH {D.TICKS}, s AS (SELECT symbol, spread / 0.25 AS sp, abs(value_) AS sl FROM (SELECT symbol, spread, (bid_size - ask_size) / 4 AS value_ FROM ticks)) SELECT symbol, count(*) AS samples, min(sp) AS spread_min, round(quantile_cont(sp, 0.5), 6) AS spread_p50, round(quantile_cont(sp, 0.95), 6) AS spread_p95, max(sp) AS spread_max,
  round(quantile_cont(sl, 0.5), 6) AS slippage_p50, round(quantile_cont(sl, 0.95), 6) AS slippage_p95, round(greatest(1.0, quantile_cont(sl, 0.95)), 6) AS recommended_slippage FROM s GROUP BY symbol""")
def cost_calibration(spark, sf):
    t = S.ticks(spark, sf).select("symbol", (F.col("spread") / 0.25).alias("spread_ticks"), F.abs((F.col("bid_size") - F.col("ask_size")) / 4).alias("slippage_ticks"))
    return r6(Y.calibration(t, ["symbol"], 1.0))


@query(f"""WITH {_O}, a AS (SELECT year(ts)::INT AS year, count(*) AS n, round(sum(pnl), 2) AS net FROM o GROUP BY 1), g AS (SELECT year(ts)::INT + 1 AS year, count(*) AS n, round(sum(pnl), 2) AS net FROM o GROUP BY 1)
SELECT year, a.n AS n_actual, g.n AS n_golden, a.net AS net_actual, g.net AS net_golden, coalesce(abs(a.n - g.n) <= 5, false) AS n_ok, coalesce(abs(a.net - g.net) <= 100000, false) AS net_ok, coalesce(abs(a.n - g.n) <= 5, false) AND coalesce(abs(a.net - g.net) <= 100000, false) AS passed FROM a FULL JOIN g USING (year)""")
def golden_replay_check(spark, sf):
    a = S.order_pnl(spark, sf).groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("net"))
    return Y.golden_check(a, a.withColumn("year", F.col("year") + 1), ["year"], {"n": 5, "net": 100_000})


_DEC = "dc AS (SELECT o_orderkey AS decision_id, CASE WHEN o_orderstatus = 'F' THEN 'block' ELSE 'allow' END AS decision, o_orderpriority AS strategy FROM orders), oc AS (SELECT l_orderkey AS decision_id, l_returnflag AS outcome, CASE WHEN l_returnflag <> 'N' THEN round(l_extendedprice - 35000, 2) END AS pnl FROM lineitem WHERE l_linenumber = 1)"


def decisions(spark, sf):
    d = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("decision_id"), F.when(F.col("o_orderstatus") == "F", "block").otherwise("allow").alias("decision"), F.col("o_orderpriority").alias("strategy"))
    o = S.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("decision_id"), F.col("l_returnflag").alias("outcome"), F.when(F.col("l_returnflag") != "N", F.round(F.col("l_extendedprice") - 35_000, 2)).alias("pnl"))
    return d, o


@query(f"""WITH {_DEC} SELECT strategy, count(*) AS outcomes, count(*) FILTER (pnl > 0) AS missed_winners, count(*) FILTER (pnl <= 0) AS avoided_losers, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END), 2) AS opportunity_cost, round(sum(CASE WHEN pnl <= 0 THEN -pnl ELSE 0 END), 2) AS avoided_loss, round(sum(pnl), 2) AS net_blocked
FROM dc JOIN oc USING (decision_id) WHERE decision = 'block' AND pnl IS NOT NULL GROUP BY strategy""")
def opportunity_cost(spark, sf):
    return r2(Y.opportunity_cost(*decisions(spark, sf), "strategy"))


@query(f"""WITH {_DEC}, p AS (SELECT DISTINCT o_orderpriority AS strategy, CASE WHEN o_orderpriority < '3' THEN 0.4 WHEN o_orderpriority < '5' THEN 0.6 END::DOUBLE AS proxy_win_rate FROM orders), a AS (SELECT strategy, count(*) AS outcomes, avg(CASE WHEN pnl IS NOT NULL THEN (pnl > 0)::INT END) AS w FROM dc JOIN oc USING (decision_id) GROUP BY 1)
SELECT strategy, proxy_win_rate, coalesce(outcomes, 0) AS outcomes, round(w, 6) AS actual_win_rate, round(w - proxy_win_rate, 6) AS drift, CASE WHEN coalesce(outcomes, 0) = 0 THEN 'no_outcomes' WHEN w - proxy_win_rate IS NULL THEN 'missing_proxy' WHEN round(w - proxy_win_rate, 9) < -0.05 THEN 'proxy_overstates_outcomes' WHEN round(w - proxy_win_rate, 9) > 0.05 THEN 'proxy_understates_outcomes' ELSE 'within_tolerance' END AS status
FROM p LEFT JOIN a USING (strategy)""")
def outcome_drift(spark, sf):
    d, o = decisions(spark, sf)
    pool = d.select("strategy").distinct().withColumn("proxy_win_rate", F.when(F.col("strategy") < "3", 0.4).when(F.col("strategy") < "5", 0.6))
    return r6(Y.outcome_drift(pool, d, o, "strategy"))


@query(f"WITH {_DEC}, ev AS (SELECT l_orderkey + 3 AS decision_id, l_linestatus AS evidence FROM lineitem WHERE l_linenumber = 1) SELECT dc.decision_id, decision, evidence, outcome FROM dc LEFT JOIN ev USING (decision_id) LEFT JOIN oc USING (decision_id) UNION ALL SELECT decision_id, NULL, evidence, NULL FROM ev WHERE decision_id NOT IN (SELECT decision_id FROM dc)")
def decision_timeline(spark, sf):
    d, o = decisions(spark, sf)
    e = S.table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") + 3).alias("decision_id"), F.col("l_linestatus").alias("evidence"))
    return Y.timeline(d, e, o)


_SNAP = f"""{D.bars(60)}, b AS (SELECT *, timestamp::DATE AS day, row_number() OVER (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp) AS k FROM bars),
sn AS (SELECT symbol, day, max(timestamp) AS snapshot_time, arg_max(close, timestamp) AS last_price, max(high) AS session_high, min(low) AS session_low, max(high) FILTER (k <= 3) AS opening_range_high, min(low) FILTER (k <= 3) AS opening_range_low, sum(close * greatest(tick_count, 1)) / sum(greatest(tick_count, 1)) AS vwap, arg_max(avg_spread, timestamp) AS spread, count(*) AS bar_count FROM b GROUP BY ALL)"""
_LV = "lv AS (SELECT * FROM (SELECT symbol, day, last_price, unnest(['session_high', 'session_low', 'opening_range_high', 'opening_range_low', 'vwap']) AS level, unnest([session_high, session_low, opening_range_high, opening_range_low, vwap]) AS price FROM sn) WHERE round(abs(last_price - price), 9) <= 1.5)"


def snapshots(spark, sf):
    return Y.market_snapshot(hourly(spark, sf).withColumn("day", F.to_date("timestamp")), ["symbol", "day"])


@query(f"WITH {_SNAP} SELECT symbol, day, snapshot_time, bar_count, {D.rounded('last_price session_high session_low opening_range_high opening_range_low vwap spread')} FROM sn")
def market_snapshot(spark, sf):
    return r6(snapshots(spark, sf))


@query(f"WITH {_SNAP}, {_LV} SELECT symbol, day, level, round(price, 6) AS level_price, round(last_price - price, 6) + 0.0 AS distance, round(greatest(0, 1 - abs(last_price - price) / 1.5), 6) + 0.0 AS proximity_score FROM lv")
def key_levels(spark, sf):
    return r6(Y.key_levels(snapshots(spark, sf), ["symbol", "day"], 1.5))


@query(f"WITH {_SNAP}, {_LV}, s AS (SELECT symbol, day, least(1, max(greatest(0, 1 - abs(last_price - price) / 1.5)) + 0.15::DOUBLE) AS s FROM lv GROUP BY ALL) SELECT symbol, day, round(s, 6) AS strength, CASE WHEN round(s, 9) >= 0.78 THEN 'strong_review' WHEN round(s, 9) >= 0.6 THEN 'medium_watch' WHEN round(s, 9) >= 0.35 THEN 'weak_notice' ELSE 'none' END AS bucket FROM s")
def monitor_score(spark, sf):
    return r6(Y.monitor_score(Y.key_levels(snapshots(spark, sf), ["symbol", "day"], 1.5), ["symbol", "day"], "pre_event"))


@query("WITH d AS (SELECT DISTINCT o_custkey % 20 AS grp, o_orderdate::DATE AS day FROM orders), r AS (SELECT grp, day, day - row_number() OVER (PARTITION BY grp ORDER BY day)::INT AS run FROM d) SELECT grp, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r GROUP BY grp, run")
def day_runs(spark, sf):
    return Y.day_runs(S.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("grp"), F.to_date("o_orderdate").alias("day")), "day", ["grp"])


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.05) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'retained' END AS change FROM a FULL JOIN b ON a.k = b.k")
def pool_change(spark, sf):
    l = S.table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey"))
    return Y.pool_change(l.where("l_quantity > 25"), l.where("l_discount > 0.05"), "k")


#: Quantiles are those of the train part, the years before 1998; every row is judged by the rules, in its part (null without a date).
_QT = "q AS (SELECT quantile_cont(l_quantity, [0.2, 0.8]) AS a, quantile_cont(l_tax, [0.2, 0.8]) AS b FROM lineitem WHERE year(l_shipdate) < 1998), rl AS (SELECT unnest(['l_quantity<=0.2', 'l_quantity>=0.2', 'l_quantity<=0.8', 'l_quantity>=0.8', 'l_tax<=0.2', 'l_tax>=0.2', 'l_tax<=0.8', 'l_tax>=0.8']) AS rule, unnest([a[1], a[1], a[2], a[2], b[1], b[1], b[2], b[2]]) AS t FROM q), x AS (SELECT l_quantity, l_tax, CASE WHEN year(l_shipdate) < 1998 THEN 'train' WHEN year(l_shipdate) >= 1998 THEN 'test' END AS part, round(l_extendedprice - 35000, 2)::DECIMAL(18, 2) AS pnl FROM lineitem)"
_PASS = "CASE WHEN {r}.rule LIKE 'l_quantity<%' THEN l_quantity <= {r}.t WHEN {r}.rule LIKE 'l_quantity>%' THEN l_quantity >= {r}.t WHEN {r}.rule LIKE 'l_tax<%' THEN l_tax <= {r}.t ELSE l_tax >= {r}.t END"


def _rules(spark, sf):
    year = F.year("l_shipdate")
    part = F.when(year < 1998, "train").when(year >= 1998, "test")
    l = S.table(spark, sf, "lineitem").select("l_quantity", "l_tax", part.alias("part"), F.round(F.col("l_extendedprice") - 35_000, 2).cast("decimal(18,2)").alias("pnl"))
    return l, Y.quantile_rules(l.where("part = 'train'"), ["l_quantity", "l_tax"], [0.2, 0.8])


@query(f"WITH {_QT} SELECT part, rule, count(*) AS n, round(sum(pnl)::DOUBLE, 2) AS net FROM x, rl WHERE {_PASS.format(r='rl')} GROUP BY part, rule")
def quantile_rules(spark, sf):
    rows, rules = _rules(spark, sf)
    return Y.rule_results(rows, rules, ["l_quantity", "l_tax"], by=["part"]).withColumn("net", F.round(F.col("net").cast("double"), 2))


@query(f"WITH {_QT} SELECT part, a.rule || '&' || b.rule AS rule, count(*) AS n, round(sum(pnl)::DOUBLE, 2) AS net FROM x, rl a, rl b WHERE a.rule LIKE 'l_quantity%' AND b.rule LIKE 'l_tax%' AND {_PASS.format(r='a')} AND {_PASS.format(r='b')} GROUP BY ALL")
def quantile_rule_pairs(spark, sf):
    rows, rules = _rules(spark, sf)
    return Y.rule_results(rows, rules, ["l_quantity", "l_tax"], True, ["part"]).withColumn("net", F.round(F.col("net").cast("double"), 2))


@query(f"""WITH {_O}, y AS (SELECT year(ts)::INT AS y, grp, status, count(*) AS n, count(*) FILTER (pnl > 0) AS w, sum(pnl) AS net FROM o GROUP BY ALL), f AS (SELECT unnest([1997, 1998, 1999, 2000]) AS test_year),
g AS (SELECT test_year, grp, status, coalesce(sum(n) FILTER (y < test_year), 0)::BIGINT AS train_n, coalesce(sum(w) FILTER (y < test_year), 0)::BIGINT AS train_wins, coalesce(sum(n) FILTER (y = test_year), 0)::BIGINT AS test_n, coalesce(sum(w) FILTER (y = test_year), 0)::BIGINT AS test_wins, sum(net) FILTER (y = test_year) AS test_net FROM y, f GROUP BY ALL)
SELECT test_year, grp, status, train_n, train_wins, test_n, test_wins, round(test_net, 2) AS test_net FROM g WHERE train_n >= 10 AND train_wins / train_n >= 0.2""")
def expanding_walk_forward(spark, sf):
    return r2(Y.expanding_folds(S.order_pnl(spark, sf), ["grp", "status"], [1997, 1998, 1999, 2000], 10, 0.2))


@query("""WITH y AS (SELECT p_brand AS rule, p_size % 5 AS year, round(sum(p_retailprice - 1400), 6) AS net FROM part GROUP BY ALL), r AS (SELECT rule, list(net ORDER BY year) AS v FROM (SELECT b.rule, d.year, coalesce(net, 0) AS net FROM (SELECT DISTINCT rule FROM y) b, (SELECT DISTINCT year FROM y) d LEFT JOIN y ON y.rule = b.rule AND y.year = d.year) GROUP BY rule),
s1 AS (SELECT [rule] AS rules, v, round(list_min(v), 6) AS worst, round(list_sum(v), 6) AS total FROM r ORDER BY 3 DESC, 4 DESC, array_to_string(rules, '+') LIMIT 8),
s2 AS (SELECT *, round(list_min(v), 6) AS worst, round(list_sum(v), 6) AS total FROM (SELECT DISTINCT list_sort(list_append(s1.rules, r.rule)) AS rules, list_transform(list_zip(s1.v, r.v), lambda x: round(x[1] + x[2], 6)) AS v FROM s1, r WHERE NOT list_contains(s1.rules, r.rule)) ORDER BY 3 DESC, 4 DESC, array_to_string(rules, '+') LIMIT 8)
SELECT array_to_string(rules, '+') AS rules, worst, total FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) ORDER BY worst DESC, total DESC, rules LIMIT 8""")
def beam_search(spark, sf):
    y = S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("rule"), (F.col("p_size") % 5).alias("year")).agg(F.round(F.sum(F.col("p_retailprice") - 1400), 6).alias("net"))
    return Y.beam_search(y, "rule", 8, 2).select(F.array_join("rules", "+").alias("rules"), "worst", "total")


@query("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity END) AS position, round(sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END * l_quantity * l_tax), 4) AS cash, sum(l_quantity) AS volume, round(sum(l_quantity * l_tax) / sum(l_quantity), 6) AS avg_price FROM lineitem GROUP BY 1")
def ledger_sums(spark, sf):
    f = S.table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell").alias("side"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("price"))
    x = Y.ledger_sums(f, ["l_suppkey"])
    return x.withColumns({"cash": F.round("cash", 4), "avg_price": F.round("avg_price", 6)})


@query("""WITH m AS (SELECT p_type AS family, count(*) AS trials, arg_max(p_partkey, (p_retailprice, p_partkey)) AS best, max(p_retailprice) AS best_sharpe, quantile_cont(p_retailprice, 0.5) AS med FROM part GROUP BY 1)
SELECT family, trials, best, round(best_sharpe, 6) AS best_sharpe, round(med, 6) AS median_sharpe, round(greatest(med, 0.05) / sum(greatest(med, 0.05)) OVER (), 6) AS next_weight FROM m""")
def family_weights(spark, sf):
    return r6(Y.family_weights(S.table(spark, sf, "part").select(F.col("p_type").alias("family"), F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("sharpe"))))


@query("""WITH t AS (SELECT p_brand AS module, p_partkey AS name, p_size > 25 AS passed, p_retailprice AS score, p_type AS kind, CASE WHEN p_size > 25 THEN [] WHEN p_size > 10 THEN ['small'] ELSE ['small', 'tiny'] END AS reasons FROM part),
w AS (SELECT module, string_agg(r || '=' || n, ',' ORDER BY r || '=' || n) AS reasons FROM (SELECT module, r, count(*) AS n FROM (SELECT module, unnest(reasons) AS r FROM t) GROUP BY ALL) GROUP BY module)
SELECT module, count(*) AS trials, round(avg(passed::INT), 6) AS pass_rate, arg_max(name, (score, name)) AS best, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, any_value(w.reasons) AS reasons FROM t LEFT JOIN w USING (module) GROUP BY module""")
def module_summary(spark, sf):
    size = F.col("p_size")
    none = F.array().cast("array<string>")
    t = S.table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("name"), (size > 25).alias("passed"), F.col("p_retailprice").alias("score"), F.col("p_type").alias("kind"),
                                          F.when(size > 25, none).when(size > 10, F.array(F.lit("small"))).otherwise(F.array(F.lit("small"), F.lit("tiny"))).alias("reasons"))
    return r6(Y.module_summary(t, "module"))


_RISK = "t AS (SELECT ts, event_id, round(value - 50, 6) AS pnl, (1 + user_id % 4) * 10 AS risk FROM events)"


@query(f"""WITH {_RISK}, x AS (SELECT 'session' AS dimension, CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS bucket, pnl / risk AS r FROM t UNION ALL SELECT 'stop', risk::VARCHAR, pnl / risk FROM t UNION ALL SELECT 'r', floor(pnl / risk)::INT::VARCHAR, pnl / risk FROM t)
SELECT dimension, bucket, count(*) AS n, round(avg(r), 6) AS mean_r, count(*) FILTER (r > 0) AS wins FROM x GROUP BY ALL""")
def r_attribution(spark, sf):
    t = S.table(spark, sf, "events").select("ts", F.round(F.col("value") - 50, 6).alias("pnl"), ((1 + F.col("user_id") % 4) * 10).alias("risk"))
    h = F.hour("ts")
    return r6(Y.r_attribution(t, {"session": F.when(h < 8, "night").when(h < 16, "day").otherwise("evening"), "stop": F.col("risk"), "r": F.floor(F.col("pnl") / F.col("risk")).cast("int")}))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def tail_retention(spark, sf):
    return Y.last_n(S.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def half_open_range(spark, sf):
    return Y.half_open(S.table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-09").select("event_id")


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) <= 90 AS night FROM events")
def warmup_wrap(spark, sf):
    return S.table(spark, sf, "events").select("event_id", Y.in_warmup("ts", 1320, 90).alias("night"))


@query(f"""WITH {D.features()}, x AS (SELECT symbol, timestamp, round(close, 9) AS c, round(ma20, 9) AS m FROM f), y AS (SELECT *, lag(c) OVER w AS pc, lag(m) OVER w AS pm FROM x WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))
SELECT symbol, timestamp, coalesce(pc <= pm AND c > m, false) AS above, coalesce(pc >= pm AND c < m, false) AS below FROM y""")
def crossings(spark, sf):
    from .signals import frame

    f = frame(spark, sf).select("symbol", "timestamp", F.round("close", 9).alias("c"), F.round("ma20", 9).alias("m"))
    return f.select("symbol", "timestamp", Y.crosses("c", "m").alias("above"), Y.crosses("c", "m", up=False).alias("below"))


@query(f"""WITH {D.TICKS} SELECT seq, round_even(bid / 0.25, 0) * 0.25 AS nearest, ceil(ask / 0.25) * 0.25 AS up, floor(bid / 0.25) * 0.25 AS down, round_even(abs(ask - bid) / 0.25, 0)::INT AS ticks, greatest(round_even(greatest(0.5::DOUBLE, least(spread * 3, 2.0)) / 0.25, 0) * 0.25, 0.25)::DOUBLE AS stop FROM ticks""")
def tick_maths(spark, sf):
    return S.ticks(spark, sf).select("seq", Y.to_tick("bid", 0.25).alias("nearest"), Y.to_tick("ask", 0.25, "up").alias("up"), Y.to_tick("bid", 0.25, "down").alias("down"), Y.ticks_between("ask", "bid", 0.25).alias("ticks"), Y.bounded_stop(F.col("spread") * 3, 0.5, 2.0, 0.25).alias("stop"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), m AS (SELECT day, make_date(year(day), (ceil(month(day) / 3.0) * 3)::INT, 1) AS first FROM d),
n AS (SELECT day, first, (first + INTERVAL 3 MONTH)::DATE AS second FROM m), x AS (SELECT day, first + ((5 - dayofweek(first) + 7) % 7)::INT + 14 AS a, second + ((5 - dayofweek(second) + 7) % 7)::INT + 14 AS b FROM n) SELECT day, CASE WHEN day <= a THEN a ELSE b END AS expiry FROM x""")
def futures_calendar(spark, sf):
    return S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", Y.quarterly_expiry("day").alias("expiry"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS hash FROM part""")
def canonical_hash(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).select("p_partkey", F.sha2(Y.canonical_json(["size", "brand"]), 256).alias("hash"))


_PROFILES = [(1.0, 3.0), (2.0, 4.0), (4.0, 4.0)]


@query(f"""WITH {D.features()}, ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM f), v(target, stop) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _PROFILES)}),
s AS (SELECT symbol, i, timestamp::DATE AS day, close AS entry, target AS tp, stop AS sl, round(close, 9) + target AS target, round(close, 9) - stop AS stop FROM ix, v WHERE close > high20_prev),
h AS (SELECT s.symbol, s.i, tp, sl, entry, b.i AS bi, CASE WHEN round(b.low, 9) <= stop THEN stop WHEN round(b.high, 9) >= target THEN target END AS hit, round(b.close, 9) AS bc FROM s JOIN ix b ON b.symbol = s.symbol AND b.i > s.i AND b.i <= s.i + 8 AND b.day = s.day),
e AS (SELECT symbol, i, tp, sl, coalesce(arg_min(hit, bi) FILTER (hit IS NOT NULL), arg_max(bc, bi)) - any_value(round(entry, 9)) AS p FROM h GROUP BY ALL) SELECT tp, sl, count(*) AS n, round(sum(round(p, 6)::DECIMAL(18, 6))::DOUBLE, 6) AS points FROM e GROUP BY ALL""")
def take_profit_search(spark, sf):
    from .signals import frame

    f = R.indexed(frame(spark, sf)).withColumns({c: F.round(c, 9) for c in ("high", "low", "close")})
    profiles = F.explode(F.array(*[F.struct(F.lit(a).alias("tp"), F.lit(b).alias("sl")) for a, b in _PROFILES]))
    s = f.where("close > high20_prev").select("symbol", "i", F.col("close").alias("entry"), profiles.alias("p")).select("symbol", "i", "entry", "p.*")
    s = s.withColumns({"signal_id": F.concat_ws(":", "symbol", "i", "tp"), "direction": F.lit(1), "target": F.col("entry") + F.col("tp"), "stop": F.col("entry") - F.col("sl")})
    x = R.exit_sim(s, f.select("symbol", "i", "timestamp", "high", "low", "close"), 8, flatten=True).where("exit_i IS NOT NULL")
    points = F.sum(F.round(F.col("exit_price") - F.col("entry"), 6).cast("decimal(18,6)")).cast("double")
    return r6(x.groupBy("tp", "sl").agg(F.count("*").alias("n"), points.alias("points")))


_EX = f"""{D.TICKS}, tr AS (SELECT event_id AS trade_id, event_type AS symbol, ts AS entry_time, ts + INTERVAL 60 MINUTES AS exit_time, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d, (1 + user_id % 3)::INT AS contracts, 10.0::DOUBLE * (1 + user_id % 3) AS gross, round(100 + value / 10, 3) AS lim FROM events),
pr AS (SELECT trade_id, symbol, d, k, s, CASE k WHEN 'entry' THEN entry_time ELSE exit_time END + to_seconds(s) AS at FROM tr, (SELECT unnest(['entry', 'exit']) AS k), (SELECT unnest([0, 1, 5]) AS s)),
fo AS (SELECT pr.*, t.timestamp AS found, t.bid, t.ask, t.bid_size, t.ask_size, t.spread FROM pr ASOF LEFT JOIN ticks t ON pr.symbol = t.symbol AND pr.at <= t.timestamp),
pp AS (SELECT *, CASE WHEN (d = 1) = (k = 'entry') THEN ask ELSE bid END AS price FROM fo),
gr AS (SELECT a.trade_id, a.s, a.found, a.price AS paid, CASE WHEN a.d = 1 THEN a.ask_size ELSE a.bid_size END AS size, a.spread + b.spread AS sp, (b.price - a.price) * a.d * 20 AS move, b.found IS NOT NULL AND a.found IS NOT NULL AS ok FROM pp a JOIN pp b ON b.trade_id = a.trade_id AND b.s = a.s AND a.k = 'entry' AND b.k = 'exit'),
ex AS (SELECT tr.*, z.ok, z.found AS fill_time, z.paid, z.size, z.sp, z.move * contracts - gross AS delta0, CASE WHEN o.ok THEN o.move * contracts - gross END AS delta1, CASE WHEN f.ok THEN f.move * contracts - gross END AS delta5 FROM tr JOIN gr z ON z.trade_id = tr.trade_id AND z.s = 0 JOIN gr o ON o.trade_id = tr.trade_id AND o.s = 1 JOIN gr f ON f.trade_id = tr.trade_id AND f.s = 5),
la AS (SELECT trade_id, symbol, d, paid, s, fill_time + to_seconds(s) AS at FROM ex, (SELECT unnest([60, 900]) AS s) WHERE ok), ad AS (SELECT trade_id, la.s, (paid - t.mid) * d / 0.25 AS v FROM la ASOF LEFT JOIN ticks t ON la.symbol = t.symbol AND la.at <= t.timestamp),
li AS (SELECT DISTINCT tr.trade_id FROM tr JOIN ticks t ON t.symbol = tr.symbol AND t.timestamp BETWEEN entry_time AND entry_time + INTERVAL 30 MINUTES WHERE (d = 1 AND t.ask <= lim AND t.ask_size >= contracts) OR (d = -1 AND t.bid >= lim AND t.bid_size >= contracts)),
ro AS (SELECT trade_id, CASE WHEN ok THEN 'validated' ELSE 'missing_quote' END AS status, CASE WHEN ok THEN delta0 END AS gross_delta, CASE WHEN ok THEN delta0 - 10 * contracts END AS conservative_delta, CASE WHEN ok THEN sp * 20 * contracts END AS spread_cost, CASE WHEN ok THEN least(size / contracts, 1.0) END AS fill_ratio,
  CASE WHEN ok THEN delta0 END AS delay_0_delta, CASE WHEN ok THEN delta1 END AS delay_1_delta, CASE WHEN ok THEN delta5 END AS delay_5_delta, (SELECT max(v) FROM ad WHERE ad.trade_id = ex.trade_id AND s = 60) AS adverse_60, (SELECT max(v) FROM ad WHERE ad.trade_id = ex.trade_id AND s = 900) AS adverse_900,
  CASE WHEN ok THEN trade_id IN (SELECT trade_id FROM li) END AS limit_filled, CASE WHEN ok AND trade_id NOT IN (SELECT trade_id FROM li) THEN gross END AS missed_cost FROM ex)"""
_MEASURES = "gross_delta conservative_delta spread_cost fill_ratio delay_0_delta delay_1_delta delay_5_delta adverse_60 adverse_900 missed_cost"


def _executed(spark, sf):
    t = S.trades(spark, sf).join(S.ticks(spark, sf).select(F.col("seq").alias("trade_id"), F.round("mid", 3).alias("entry_price")), "trade_id").withColumn("gross_pnl", 10.0 * F.col("contracts"))
    return E.executions(t, S.ticks(spark, sf), after=(60, 900), timeout=1800)


@query(f"WITH {_EX} SELECT trade_id, status, limit_filled, {D.rounded(_MEASURES)} FROM ro")
def execution_report(spark, sf):
    return r6(_executed(spark, sf).select("trade_id", "status", "limit_filled", *_MEASURES.split()))


@query(f"""WITH {_EX}, lo AS (SELECT unnest({_MEASURES.split()}) AS measure, unnest([{', '.join(_MEASURES.split())}]) AS v FROM ro), nn AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM lo WHERE v IS NOT NULL),
tl AS (SELECT measure, min(v) AS tail FROM nn WHERE i = round_even((CASE WHEN measure LIKE 'adverse%' THEN 0.95 ELSE 0.05 END)::DOUBLE * (n - 1), 0) AND (measure LIKE 'adverse%' OR measure LIKE 'delay%') GROUP BY 1)
SELECT measure, count(*) AS samples, round(sum(round(v, 6)::DECIMAL(18, 6))::DOUBLE / count(*), 4) AS mean, round(any_value(tail), 6) AS tail FROM nn LEFT JOIN tl USING (measure) GROUP BY measure""")
def execution_summary(spark, sf):
    x = E.execution_summary(_executed(spark, sf), after=(60, 900))
    return x.withColumns({"mean": F.round("mean", 4), "tail": F.round("tail", 6)})


@query(f"""WITH {D.TICKS}, t AS (SELECT seq AS trade_id, symbol, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS d, timestamp AS a, timestamp + INTERVAL 2 HOURS AS b, round(mid, 6) AS p, round(mid + 0.5, 6) AS x, bid_size::INT AS q FROM ticks),
f AS (SELECT trade_id, symbol, 'entry' AS leg, 1 AS r, a AS time, p AS price, d * q AS quantity, 0::DECIMAL(18, 6) AS realized FROM t UNION ALL SELECT trade_id, symbol, 'exit', 0, b, x, -d * q, round(0.5::DOUBLE * d * q, 6)::DECIMAL(18, 6) FROM t)
SELECT trade_id, symbol, leg, time, price, quantity, (sum(quantity) OVER w)::BIGINT AS position, round(100000 + (sum(realized) OVER w)::DOUBLE, 6) AS equity FROM f WINDOW w AS (PARTITION BY symbol ORDER BY time, r, trade_id ROWS UNBOUNDED PRECEDING)""")
def paper_replay(spark, sf):
    long = F.col("seq") % 2 == 0
    t = S.ticks(spark, sf).select(F.col("seq").alias("trade_id"), "symbol", F.when(long, "long").otherwise("short").alias("side"), F.col("timestamp").alias("entry_time"), (F.col("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("exit_time"), F.round("mid", 6).alias("entry_price"), F.round(F.col("mid") + 0.5, 6).alias("exit_price"),
                                  F.col("bid_size").cast("int").alias("contracts"), F.round(F.lit(0.5) * F.when(long, 1).otherwise(-1) * F.col("bid_size").cast("int"), 6).cast("decimal(18,6)").alias("pnl"))
    return E.paper_replay(t).withColumn("equity", F.round(F.col("equity").cast("double"), 6))


@query(f"""WITH {_O}, d AS (SELECT grp, ts::DATE AS day, count(*) AS n, sum(round(pnl, 2)::DECIMAL(18, 2))::DOUBLE AS net FROM o GROUP BY ALL) SELECT grp, count(*) AS days, max(n) AS most, round(max(n) / sum(n), 6) AS trade_share, round(max(net) / sum(net) FILTER (net > 0), 6) AS gain_share FROM d GROUP BY grp""")
def trade_concentration(spark, sf):
    o = S.order_pnl(spark, sf).withColumn("pnl", F.round("pnl", 2).cast("decimal(18,2)"))
    x = V.concentration(o, ["grp"])
    return r6(x.withColumns({"gain_share": F.col("gain_share").cast("double")}))


_CLOSE = (*FOLDS[:5], 90, *FOLDS[6:])


@query(f"WITH {_folds_sql(_CLOSE)}, t AS (SELECT *, max(to_day) OVER (ORDER BY from_day, fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM folds WHERE split = 'test') SELECT fold, from_day, before FROM t WHERE before >= from_day")
def overlapping_tests(spark, sf):
    return V.overlapping_tests(V.rolling_folds(spark, *_CLOSE))
