"""Metrics of ledgers (grp, ts, seq, pnl), ranking and gates. Running sums go by (ts, seq) inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

UP = Window.unboundedPreceding


def running(df: DataFrame, by: list[str], start: float = 0.0) -> DataFrame:
    """Adds equity, its running peak (start included) and drawdown."""
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(UP, 0)
    df = df.withColumn("equity", F.round(F.lit(start) + F.sum("pnl").over(w), 6))
    df = df.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(w)))
    return df.withColumn("drawdown", F.col("peak") - F.col("equity"))


def losing_runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Longest run of losses for each group; a zero ends a run."""
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(UP, 0)
    runs = df.withColumn("run", F.sum(F.when(F.col("pnl") >= 0, 1).otherwise(0)).over(w)).where("pnl < 0").groupBy(*by, "run").agg(F.count("*").alias("n"))
    return df.select(*by).distinct().join(runs.groupBy(*by).agg(F.max("n").alias("longest")), by, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def trade_metrics(df: DataFrame, by: list[str], start: float = 100_000.0, year_trades: float = 252.0) -> DataFrame:
    """Counts, means, extremes, payoff, profit factor, Sharpe per trade, drawdown and longest losing run."""
    x = running(df, by, start).withColumn("r", F.col("pnl") / F.lit(start))
    loss = F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    gain = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0))
    out = x.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.sum("pnl").alias("net"), F.avg("pnl").alias("mean"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("avg_win"), F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("avg_loss"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
        F.when(loss > 0, gain / loss).alias("profit_factor"), F.when((F.count("*") > 1) & (F.stddev_pop("r") > 0), F.avg("r") / F.stddev_pop("r") * F.sqrt(F.lit(year_trades))).alias("sharpe"), F.max("drawdown").alias("max_drawdown"))
    out = out.withColumn("payoff", F.when(F.col("avg_loss") < 0, F.col("avg_win") / -F.col("avg_loss")))
    return out.join(losing_runs(df, by).withColumnRenamed("longest", "max_losing_run"), by)


def by_dimension(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Count, sum and win rate for each value of each dimension, in one pass."""
    x = df.select("pnl", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("bucket")) for n, c in dimensions.items()])).alias("d")).select("pnl", "d.*")
    return x.groupBy("dimension", "bucket").agg(F.count("*").alias("n"), F.sum("pnl").alias("net"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def bucketed(col: str, limits: dict[str, float], beyond: str) -> Column:
    """The name of the first limit that a value lies below."""
    out = F.lit(beyond)
    for name, most in sorted(limits.items(), key=lambda x: -x[1]):
        out = F.when(F.col(col) < most, name).otherwise(out)
    return out


def subset_totals(ledger: DataFrame, group: str, most: int) -> DataFrame:
    """Count and sum of every subset of up to `most` groups: totals by group first, so what is enumerated are groups, not rows."""
    total = ledger.groupBy(group).agg(F.count("*").alias("n"), F.sum("pnl").alias("net"))
    one = total.select(F.array(group).alias("members"), "n", "net")
    out = step = one
    for _ in range(most - 1):  # each step adds a group that stands behind all members
        step = step.join(total.select(F.col(group).alias("g"), F.col("n").alias("m"), F.col("net").alias("x")), F.col("g") > F.element_at("members", -1))
        step = step.select(F.array_append("members", F.col("g")).alias("members"), (F.col("n") + F.col("m")).alias("n"), (F.col("net") + F.col("x")).alias("net"))
        out = out.unionByName(step)
    return out.select(F.array_join("members", "+").alias("subset"), F.size("members").cast("long").alias("size"), "n", "net")


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at index round-half-even(q * (n - 1)) of a group's sorted values; nulls don't count."""
    return exact_quantiles(df, by, value, {"value": (q, "nearest")}).select(*by, "value")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__o", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__o = 1").drop("__o")


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    w = Window.partitionBy(*by).orderBy(start, end)
    x = df.withColumn("__e", F.max(end).over(w.rowsBetween(UP, -1)))
    x = x.withColumn("__g", F.sum(F.when(F.col("__e").isNull() | (F.col(start) > F.col("__e")), 1).otherwise(0)).over(w.rowsBetween(UP, 0)))
    return x.groupBy(*by, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("parts")).drop("__g")


def capped_top(df: DataFrame, kind: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """At most cap rows of a kind, then the best rows."""
    return df.withColumn("__o", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__o") <= cap).drop("__o").orderBy(*order).limit(limit)


def gates(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds the names of the rules that a row fails, and whether it passes."""
    x = metrics.withColumn("reasons", F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in rules.items()])))
    return x.withColumn("passed", F.size("reasons") == 0)
