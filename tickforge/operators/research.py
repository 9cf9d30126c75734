"""Reports of a research run: metrics of signals, gates and scores, event gating and attribution, calibration, drift, selection under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import UP, losing_runs, running


def signal_metrics(ledger: DataFrame, by: list[str], days: float) -> DataFrame:
    """Metrics of signals from an equity of 0; the win rate of a group is 0 without wins, a factor without losses is null."""
    pnl = F.col("pnl")
    gain, loss = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, -pnl))
    out = running(ledger, by).groupBy(*by).agg(
        F.count("*").alias("trades"), (F.count("*") / F.lit(float(days)) * 365).alias("annual_trades"), F.sum("pnl").alias("net"), F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"), F.max("drawdown").alias("max_drawdown"), F.max(F.when(pnl > 0, pnl)).alias("best"), F.min(F.when(pnl < 0, pnl)).alias("worst"))
    out = out.withColumn("return_to_drawdown", F.when(F.col("max_drawdown") > 0, F.col("net") / F.col("max_drawdown")))
    return out.join(losing_runs(ledger, by).withColumnRenamed("longest", "max_losing_run"), by)


def with_returns(metrics: DataFrame, columns: list[str], capital: float, notional: float | None = None) -> DataFrame:
    """Adds each amount as a share of the capital and of the notional, both 1 at least."""
    capital, notional = max(1.0, capital), max(1.0, capital if notional is None else notional)
    return metrics.withColumns({**{f"{c}_return": F.col(c) / capital for c in columns}, **{f"{c}_return_on_notional": F.col(c) / notional for c in columns}})


def break_even_cost(trades: DataFrame, by: list[str]) -> DataFrame:
    """Extra cost of a contract at which the profit is gone; null without contracts."""
    return trades.groupBy(*by).agg(F.when(F.sum("contracts") > 0, F.sum("pnl") / F.sum("contracts")).alias("extra_cost"))


def decay(before: str | Column, after: str | Column) -> Column:
    """Share of a positive ratio that is lost; null where there is nothing to lose."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    return F.when(a > 0, (a - b) / a)


#: Reasons against a candidate; limits are fixed values. Columns: see hard_gates.
GATES = {
    "annual_trades_test": "test_annual_trades <= 1000",
    "sharpe_test_aggregate": "test_sharpe IS NULL OR test_sharpe <= 2",
    "median_sharpe_test_fold": "median_fold_sharpe IS NULL OR median_fold_sharpe <= 1.5",
    "net_pnl_test": "test_net <= 0",
    "net_pnl_final_holdout": "holdout_net <= 0",
    "max_drawdown_test": "test_max_drawdown > 10000",
    "profit_factor_test": "test_profit_factor IS NULL OR test_profit_factor <= 1.1",
    "avg_trade_net_pnl": "test_mean IS NULL OR test_mean <= 1.5 * round_trip_cost",
    "positive_test_fold_ratio": "folds > 0 AND positive_folds / folds < 0.6",
    "positive_year_ratio": "positive_year_ratio < 0.6",
    "validation_sharpe": "validation_sharpe IS NULL OR validation_sharpe <= 0",
    "validation_to_test_sharpe_decay": "validation_sharpe > 0 AND (validation_decay IS NULL OR validation_decay > 0.5)",
    "final_holdout_sharpe_decay": "holdout_sharpe < 0.7 * test_sharpe",
    "test_to_holdout_sharpe_decay": "holdout_decay > 0.5",
}


def hard_gates(candidates: DataFrame, budget: int = 500) -> DataFrame:
    """Adds reasons, passed and score (null unless passed).

    candidates: test_, holdout_ and validation_ sharpe, net and so on, median_fold_sharpe, folds, positive_folds,
    positive_year_ratio, round_trip_cost and combinations, the number of parameter sets tried.
    """
    x = candidates.withColumns({"validation_decay": decay("validation_sharpe", "test_sharpe"), "holdout_decay": decay("test_sharpe", "holdout_sharpe")})
    x = x.withColumn("reasons", F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in GATES.items()])))
    stable = (F.coalesce(F.expr("positive_folds / nullif(folds, 0)"), F.lit(0.0)) + F.coalesce("positive_year_ratio", F.expr("positive_folds / nullif(folds, 0)"), F.lit(0.0))) / 2
    score = 0.35 * F.least(F.least(F.coalesce("test_sharpe", F.lit(0.0)), F.coalesce("holdout_sharpe", F.lit(0.0))) / 4, F.lit(1.0)) + 0.2 * F.least(F.greatest("test_net", F.lit(0.0)) / 100_000, F.lit(1.0))
    score = score + 0.2 * stable + 0.15 / (1 + F.col("test_max_drawdown") / 10_000) + 0.1 * F.least(F.col("test_annual_trades") / 3000, F.lit(1.0))
    over = F.when(F.col("combinations") > budget, F.sqrt(F.lit(float(budget)) / F.col("combinations"))).otherwise(F.lit(1.0))
    passed = F.size("reasons") == 0
    return x.drop("validation_decay", "holdout_decay").withColumns({"passed": passed, "score": F.when(passed, score * over)})


def overfitting(candidates: DataFrame) -> DataFrame:
    """Penalty for the number of trials, the Sharpe ratio less it, and a proxy of the chance of overfitting."""
    trials = F.greatest("combinations", F.lit(1))
    penalty = F.when(trials > 1, F.sqrt(2 * F.log(trials.cast("double"))) / F.sqrt(F.greatest("folds", F.lit(1)).cast("double"))).otherwise(0.0)
    x = candidates.withColumn("penalty", penalty)
    return x.withColumns({"adjusted_sharpe": F.col("test_sharpe") - F.col("penalty"), "proxy": F.when(F.col("test_sharpe") != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("penalty") / F.abs("test_sharpe"))))})


def event_policy(state: str | Column, importance: str | Column, new_entries: str = "", pre_minutes: int = 0, post_minutes: int = 0) -> Column:
    """(action, reason) for an entry: block, delay or allow, by the state and importance of the event around it."""
    s, i = (F.col(c) if isinstance(c, str) else c for c in (state, importance))
    make = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"))
    rest = make("delay", "event_policy_requires_extra_confirmation") if new_entries == "require_extra_confirmation" else make("allow", None)
    if post_minutes > 0:
        rest = F.when(s == "post_event", make("block", "post_event_blackout")).otherwise(rest)
    if pre_minutes > 0:
        rest = F.when(s == "pre_event", make("block", "pre_event_blackout")).otherwise(rest)
    if new_entries == "block":
        rest = make("block", "event_policy_new_entries_block")
    return F.when(s == "normal", make("allow", None)).when((i == "high") & (s == "release_window"), make("block", "high_impact_release_window")).otherwise(rest)


def with_context(trades: DataFrame, context: DataFrame) -> DataFrame:
    """Trades with the event state at their very entry and exit times; normal where there is none. context: symbol, timestamp, event_state, importance."""
    side = lambda c: context.select("symbol", F.col("timestamp").alias(f"{c}_time"), F.col("event_state").alias(f"{c}_state"), F.col("importance").alias(f"{c}_importance"))
    out = trades.join(side("entry"), ["symbol", "entry_time"], "left").join(side("exit"), ["symbol", "exit_time"], "left")
    return out.withColumns({f"{c}_state": F.coalesce(f"{c}_state", F.lit("normal")) for c in ("entry", "exit")})


def event_attribution(trades: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and dependency on events of trades with entry_state and action; blocked ones count as candidates only."""
    taken = F.col("action") != "block"
    inside = F.col("entry_state") != "normal"
    out = trades.groupBy(*by).agg(
        F.count_if(inside).alias("event_trades"), F.count_if(~inside).alias("other_trades"), F.count_if(~taken).alias("blocked"), F.sum(F.when(taken & inside, F.col("pnl"))).alias("event_net"), F.sum(F.when(taken & ~inside, F.col("pnl"))).alias("other_net"),
        (F.count_if(inside | ~taken) / F.count("*")).alias("dependency"))
    return out


def calibration(samples: DataFrame, by: list[str], slippage: float) -> DataFrame:
    """Linear percentiles of observed spread and slippage, and the slippage to reckon with."""
    p = lambda c, q: F.percentile(c, q)
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.min("spread_ticks").alias("spread_min"), p("spread_ticks", 0.5).alias("spread_p50"), p("spread_ticks", 0.95).alias("spread_p95"), F.max("spread_ticks").alias("spread_max"),
        p("slippage_ticks", 0.5).alias("slippage_p50"), p("slippage_ticks", 0.95).alias("slippage_p95"), F.greatest(F.lit(slippage), p("slippage_ticks", 0.95)).alias("recommended_slippage"))


def golden_check(actual: DataFrame, golden: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Rows of both tables by key, and whether each value lies within its tolerance; a key of one table only fails."""
    a = actual.select(*keys, *[F.col(c).alias(f"{c}_actual") for c in tolerance])
    b = golden.select(*keys, *[F.col(c).alias(f"{c}_golden") for c in tolerance])
    x = a.join(b, keys, "full")
    ok = {f"{c}_ok": F.coalesce(F.abs(F.col(f"{c}_actual") - F.col(f"{c}_golden")) <= t, F.lit(False)) for c, t in tolerance.items()}
    x = x.withColumns(ok)
    passed = F.lit(True)
    for c in ok:
        passed = passed & F.col(c)
    return x.withColumn("passed", passed)


def opportunity_cost(decisions: DataFrame, outcomes: DataFrame, by: str) -> DataFrame:
    """What blocked decisions missed and avoided, for each strategy. decisions: decision_id, decision and by; outcomes: decision_id, pnl."""
    x = decisions.where("decision = 'block'").join(outcomes.where("pnl IS NOT NULL"), "decision_id")
    win = F.col("pnl") > 0
    return x.groupBy(by).agg(F.count("*").alias("outcomes"), F.count_if(win).alias("missed_winners"), F.count_if(~win).alias("avoided_losers"), F.sum(F.when(win, F.col("pnl")).otherwise(0.0)).alias("opportunity_cost"),
                             F.sum(F.when(~win, -F.col("pnl")).otherwise(0.0)).alias("avoided_loss"), F.sum("pnl").alias("net_blocked"))


def outcome_drift(pool: DataFrame, decisions: DataFrame, outcomes: DataFrame, by: str, tolerance: float = 0.05) -> DataFrame:
    """Actual win rate less the expected one (proxy_win_rate) of each strategy of a pool, and what that means."""
    actual = decisions.join(outcomes, "decision_id").groupBy(by).agg(F.count("*").alias("outcomes"), F.avg(F.when(F.col("pnl").isNotNull(), (F.col("pnl") > 0).cast("double"))).alias("actual_win_rate"))
    x = pool.select(by, "proxy_win_rate").join(actual, by, "left").withColumn("outcomes", F.coalesce("outcomes", F.lit(0)))
    x = x.withColumn("drift", F.col("actual_win_rate") - F.col("proxy_win_rate"))
    status = F.when(F.col("outcomes") == 0, "no_outcomes").when(F.col("drift").isNull(), "missing_proxy").when(F.round("drift", 9) < -tolerance, "proxy_overstates_outcomes").when(F.round("drift", 9) > tolerance, "proxy_understates_outcomes")
    return x.withColumn("status", status.otherwise("within_tolerance"))


def market_snapshot(bars: DataFrame, by: list[str], opening_bars: int = 3) -> DataFrame:
    """Last price, extremes, opening range of the first bars, and mean close weighted by ticks, for each group."""
    x = bars.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("timestamp")))
    weight, first = F.greatest("tick_count", F.lit(1)), F.col("k") <= max(opening_bars, 1)
    return x.groupBy(*by).agg(
        F.max("timestamp").alias("snapshot_time"), F.max_by("close", "timestamp").alias("last_price"), F.max("high").alias("session_high"), F.min("low").alias("session_low"), F.max(F.when(first, F.col("high"))).alias("opening_range_high"),
        F.min(F.when(first, F.col("low"))).alias("opening_range_low"), (F.sum(F.col("close") * weight) / F.sum(weight)).alias("vwap"), F.coalesce(F.max_by("avg_spread", "timestamp"), F.lit(0.0)).alias("spread"), F.count("*").alias("bar_count"))


LEVELS = ["session_high", "session_low", "opening_range_high", "opening_range_low", "vwap"]


def key_levels(snapshots: DataFrame, by: list[str], proximity: float = 2.0) -> DataFrame:
    """Levels of a snapshot that the last price is near to, with a score of 1 at the level and 0 at the proximity."""
    level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("level_price")) for n in LEVELS]))
    x = snapshots.select(*by, "last_price", level.alias("l")).select(*by, "last_price", "l.*").withColumn("distance", F.col("last_price") - F.col("level_price"))
    x = x.where(F.round(F.abs("distance"), 9) <= proximity)
    return x.withColumn("proximity_score", F.greatest(F.lit(0.0), 1 - F.abs("distance") / max(proximity, 1e-9))).drop("last_price")


def monitor_score(levels: DataFrame, by: list[str], state: str = "normal", importance: str | None = None) -> DataFrame:
    """Strength of a snapshot's nearest level, with a bonus in an event, and its bucket."""
    event = state in ("pre_event", "release_window", "event_release", "post_event")
    x = levels.groupBy(*by).agg(F.least(F.lit(1.0), F.max("proximity_score") + (0.15 if event else 0.0)).alias("strength"))
    if state in ("release_window", "event_release") and importance == "high":
        return x.withColumn("bucket", F.lit("blocked"))
    s = F.round("strength", 9)
    return x.withColumn("bucket", F.when(s >= 0.78, "strong_review").when(s >= 0.6, "medium_watch").when(s >= 0.35, "weak_notice").otherwise("none"))


def day_runs(days: DataFrame, day: str, by: list[str] | None = None) -> DataFrame:
    """Runs of consecutive days: first, last and number."""
    w = Window.partitionBy(*(by or [])).orderBy(day)
    x = days.select(*(by or []), day).distinct()
    x = x.withColumn("run", F.date_sub(F.col(day), F.row_number().over(w)))
    return x.groupBy(*(by or []), "run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("run")


def pool_change(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each key of either table as added, removed or retained."""
    both = before.select(key).distinct().withColumn("a", F.lit(1)).join(after.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("retained").alias("change"))


def timeline(decisions: DataFrame, evidence: DataFrame, outcomes: DataFrame, key: str = "decision_id") -> DataFrame:
    """Every decision with its evidence and outcome, then evidence that belongs to no decision."""
    e, o = evidence.select(key, "evidence"), outcomes.select(key, "outcome")
    rows = decisions.select(key, "decision").join(e, key, "left").join(o, key, "left")
    left = e.join(decisions, key, "left_anti").select(key, F.lit(None).cast("string").alias("decision"), "evidence", F.lit(None).cast(o.schema["outcome"].dataType).alias("outcome"))
    return rows.unionByName(left)


def quantile_rules(train: DataFrame, features: list[str], quantiles: list[float]) -> DataFrame:
    """Rules feature <= q and feature >= q at the train quantiles: feature, op, quantile, threshold."""
    t = train.agg(*[F.percentile(f, F.array(*map(F.lit, quantiles))).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), F.lit(q).alias("quantile"), F.col(f)[i].alias("threshold")) for f in features for i, q in enumerate(quantiles) for op in ("<=", ">=")])
    return t.select(F.explode(rows).alias("r")).select("r.*")


def rule_results(rows: DataFrame, rules: DataFrame, features: list[str], pairs: bool = False, by: list[str] | None = None) -> DataFrame:
    """Count and sum of pnl of the rows that pass each rule (or each pair of rules of two features), for each group. There is a handful of rules, so they go to the rows."""
    by = by or []
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in features])
    ok = F.when(F.col("op") == "<=", value <= F.col("threshold")).otherwise(value >= F.col("threshold"))
    rule = F.concat("feature", "op", F.col("quantile").cast("string"))
    if not pairs:
        passed = rows.crossJoin(F.broadcast(rules)).where(ok)  # 2 x features x quantiles rules
        return passed.groupBy(*by, rule.alias("rule")).agg(F.count("*").alias("n"), F.sum("pnl").alias("net"))
    r = rules.select("*", rule.alias("rule"))
    other = r.select(*[F.col(c).alias(f"{c}_2") for c in r.columns])
    two = r.join(other, F.col("feature") < F.col("feature_2"))
    value2 = F.coalesce(*[F.when(F.col("feature_2") == f, F.col(f)) for f in features])
    ok2 = F.when(F.col("op_2") == "<=", value2 <= F.col("threshold_2")).otherwise(value2 >= F.col("threshold_2"))
    return rows.crossJoin(F.broadcast(two)).where(ok & ok2).groupBy(*by, F.concat_ws("&", "rule", "rule_2").alias("rule")).agg(F.count("*").alias("n"), F.sum("pnl").alias("net"))


def inverse(spec: dict) -> dict:
    """A copy of a strategy that takes the other side of each signal, named so; that of an inverse is the strategy again."""
    out = dict(spec)
    out["side"] = {"long": "short", "short": "long"}.get(spec.get("side"), spec.get("side"))
    out["inverse_signal"] = not spec.get("inverse_signal", False)
    name = spec.get("name", "")
    out["name"] = name.removesuffix("_inverse") if name.endswith("_inverse") else f"{name}_inverse"
    return out


def expanding_folds(ledger: DataFrame, keys: list[str], years: list[int], least: int, win_rate: float) -> DataFrame:
    """For each test year the rules that qualify on all years before it, with their results in it; all folds in one job."""
    x = ledger.withColumn("year", F.year("ts"))
    yearly = x.groupBy("year", *keys).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net"))
    fold = yearly.withColumn("test_year", F.explode(F.array(*map(F.lit, years))))
    before, here = F.col("year") < F.col("test_year"), F.col("year") == F.col("test_year")
    pick = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = fold.groupBy("test_year", *keys).agg(pick("n", before).alias("train_n"), pick("wins", before).alias("train_wins"), pick("n", here).alias("test_n"), pick("wins", here).alias("test_wins"), F.sum(F.when(here, F.col("net"))).alias("test_net"))
    return out.where((F.col("train_n") >= least) & (F.col("train_wins") / F.col("train_n") >= win_rate))


def beam_search(yearly: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """Sets of up to `depth` rules with the largest worst year, then the largest sum, of their added yearly profits; `width` sets are kept a round.

    yearly: key, year, net. Profits of a rule become one array over years, so a round is a join of at most width
    rows with the rules.
    """
    years = [r[0] for r in yearly.select("year").distinct().orderBy("year").collect()]  # a handful
    rules = yearly.groupBy(key).pivot("year", years).agg(F.sum("net"))
    rules = rules.select(F.col(key).alias("rule"), F.array(*[F.coalesce(F.col(f"`{y}`"), F.lit(0.0)) for y in years]).alias("own"))
    order = lambda d: d.withColumns({"worst": F.round(F.array_min("nets"), 6), "total": F.round(F.aggregate("nets", F.lit(0.0), lambda a, v: a + v), 6)})
    beam = order(rules.select(F.array("rule").alias("rules"), F.col("own").alias("nets")))
    best = [F.desc("worst"), F.desc("total"), F.array_join("rules", "+")]
    beam = out = beam.orderBy(*best).limit(width)
    for _ in range(depth - 1):
        step = F.broadcast(beam).join(rules, ~F.array_contains("rules", F.col("rule")))  # width rows
        step = order(step.select(F.array_sort(F.array_append("rules", F.col("rule"))).alias("rules"), F.zip_with("nets", "own", lambda a, b: a + b).alias("nets"))).dropDuplicates(["rules"])
        beam = step.orderBy(*best).limit(width)
        out = out.unionByName(beam)
    return out.orderBy(*best).limit(width)


def ledger_sums(fills: DataFrame, by: list[str]) -> DataFrame:
    """Net position, cash and average price of fills (side buy or sell, quantity, price)."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return fills.groupBy(*by).agg(F.sum(sign * F.col("quantity")).alias("position"), F.sum(-sign * F.col("quantity") * F.col("price")).alias("cash"), F.sum("quantity").alias("volume"), (F.sum(F.col("quantity") * F.col("price")) / F.sum("quantity")).alias("avg_price"))


def family_weights(trials: DataFrame, floor: float = 0.05) -> DataFrame:
    """Best and median result of each family, and its share of the next samples: by the positive part of the median, with a floor."""
    x = trials.groupBy("family").agg(F.count("*").alias("trials"), F.max_by("name", F.struct("sharpe", "name")).alias("best"), F.max("sharpe").alias("best_sharpe"), F.percentile("sharpe", 0.5).alias("median_sharpe"))
    weight = F.greatest("median_sharpe", F.lit(floor))
    return x.withColumn("next_weight", weight / F.sum(weight).over(Window.partitionBy()))  # a row a family


def module_summary(trials: DataFrame, by: str) -> DataFrame:
    """Pass rate, best trial, kinds seen and a histogram of reasons for each module. trials: by, name, passed, score, kind, reasons."""
    base = trials.groupBy(by).agg(F.count("*").alias("trials"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.max_by("name", F.struct("score", "name")).alias("best"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    why = trials.select(by, F.explode("reasons").alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n"))
    why = why.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat("reason", F.lit("="), F.col("n").cast("string")))), ",").alias("reasons"))
    return base.join(why, by, "left")


def r_attribution(trades: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Count, mean R (profit over risk) and wins for each bucket of each dimension, in one pass."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("bucket")) for n, c in by.items()]))
    x = trades.select(rows.alias("d"), (F.col("pnl") / F.nullif(F.col("risk"), F.lit(0.0))).alias("r")).select("d.*", "r")
    return x.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.count_if(F.col("r") > 0).alias("wins"))


def last_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order, such as the latest."""
    return rows.withColumn("__o", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__o") <= n).drop("__o")


def trimmed(trades: DataFrame, start: str, end: str) -> DataFrame:
    """Trades that are entered on or after the first day and left by the end of the last."""
    return trades.where((F.col("entry_time") >= F.lit(start).cast("date").cast("timestamp_ntz")) & (F.col("exit_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def half_open(rows: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Rows from the start of the first day to the end of the last; the bounds reach the scan."""
    return rows.where((F.col(time) >= F.lit(first).cast("date").cast("timestamp_ntz")) & (F.col(time) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))


def in_warmup(time: str, start: int, flatten: int) -> Column:
    """Whether a time of day (minutes) lies from start to flatten, which may be past midnight."""
    m = F.hour(time) * 60 + F.minute(time)
    return m.between(start, flatten) if start <= flatten else (m >= start) | (m <= flatten)


def crosses(value: str, level: str, by: str = "symbol", order: str = "timestamp", up: bool = True) -> Column:
    """Whether a value goes over (under) a level with this row."""
    w = Window.partitionBy(by).orderBy(order)
    a, b = F.lag(value).over(w), F.lag(level).over(w)
    return F.coalesce((a <= b) & (F.col(value) > F.col(level)) if up else (a >= b) & (F.col(value) < F.col(level)), F.lit(False))


def to_tick(price: str | Column, tick: float, mode: str = "nearest") -> Column:
    """A price on the grid of ticks; halves go to the even tick."""
    x = (F.col(price) if isinstance(price, str) else price) / tick
    return F.round({"nearest": F.bround, "up": F.ceil, "down": F.floor}[mode](x) * tick, 10)


def ticks_between(a: str, b: str, tick: float) -> Column:
    return F.bround(F.abs(F.col(a) - F.col(b)) / tick).cast("int")


def bounded_stop(distance: Column, least: float, most: float, tick: float) -> Column:
    """A stop distance within bounds, in whole ticks, one at least."""
    return F.greatest(F.bround(F.greatest(F.lit(least), F.least(distance, F.lit(most))) / tick) * tick, F.lit(tick))


def third_friday(year: Column, month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "FRI"), 14)


def quarterly_expiry(day: str) -> Column:
    """The third Friday of the next month of March, June, September or December that isn't over."""
    d = F.col(day)
    month = (F.ceil(F.month(d) / 3) * 3).cast("int")
    here = third_friday(F.year(d), month)
    later = F.add_months(F.make_date(F.year(d), month, F.lit(1)), 3)
    return F.when(d <= here, here).otherwise(third_friday(F.year(later), F.month(later)))


def canonical_json(columns: list[str]) -> Column:
    """JSON of some columns with sorted names, nulls kept; equal values give equal text."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def snapshot_hash(bars: DataFrame, features: list[str]) -> DataFrame:
    """SHA-256 for each symbol over its bars in order: times and features rounded to 10 places, NaN and infinities as null. One short text a bar is gathered for a symbol's window of bars."""
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, 10)).alias(c)
    row = F.sha2(F.concat_ws("|", F.col("timestamp").cast("string"), F.to_json(F.struct(*[clean(c) for c in sorted(features)]), {"ignoreNullFields": "false"})), 256)
    x = bars.select("symbol", F.to_date("timestamp").alias("day"), "timestamp", row.alias("h"))
    chain = lambda part, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, "h"))), lambda s: s["h"]), ""), 256)
    days = x.groupBy("symbol", "day").agg(chain("timestamp", "day").alias("h"))
    return days.groupBy("symbol").agg(chain("day", "symbol").alias("hash"))
