"""What quotes say of trades: fills at bid and ask, with delays, a tick worse on each side, by limit orders, and how the market moved after a fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import asof, limit_fills
from .quantiles import exact_quantiles

QUOTE = ["bid", "ask", "bid_size", "ask_size", "spread", "mid"]


def executions(trades: DataFrame, quotes: DataFrame, *, delays: tuple = (0, 1, 5), after: tuple = (60, 180, 300, 900), timeout: int = 60, tick: float = 0.25, point_value: float = 20.0) -> DataFrame:
    """A row for each trade. trades: trade_id, symbol, side, entry_time, exit_time, contracts, gross_pnl, entry_price; quotes: symbol, timestamp, seq and QUOTE.

    A market order fills at the first quote at or after its time. All times of all trades are probes of one as-of
    join, the times after the fills of a second one. Without an entry or exit quote the status is missing_quote
    and nothing else is known.
    """
    long = F.col("side") == "long"
    sign = F.when(long, 1).otherwise(-1)
    delays = tuple(sorted({0, *delays}))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("delay")) for k in ("entry", "exit") for s in delays]))
    p = trades.select("trade_id", "symbol", "entry_time", "exit_time", kinds.alias("x")).select("*", "x.*")
    p = p.select("trade_id", "symbol", "kind", "delay", (F.when(F.col("kind") == "entry", F.col("entry_time")).otherwise(F.col("exit_time")) + F.expr("make_dt_interval(0, 0, 0, delay)")).alias("at"))
    q = asof(p, quotes, QUOTE)
    pick = lambda k, s: F.max(F.when((F.col("kind") == k) & (F.col("delay") == s) & F.col("found").isNotNull(), F.struct("found", *QUOTE))).alias(f"{k}_{s}")
    wide = q.groupBy("trade_id").agg(*[pick(k, s) for k in ("entry", "exit") for s in delays])
    x = trades.join(wide, "trade_id")
    price = lambda k, s: F.when(long == F.lit(k == "entry"), F.col(f"{k}_{s}.ask")).otherwise(F.col(f"{k}_{s}.bid"))
    gross = lambda s: (price("exit", s) - price("entry", s)) * sign * point_value * F.col("contracts")
    known = F.col("entry_0").isNotNull() & F.col("exit_0").isNotNull()
    size = F.when(long, F.col("entry_0.ask_size")).otherwise(F.col("entry_0.bid_size"))
    when = lambda c: F.when(known, c)
    x = x.withColumns({
        "status": F.when(known, "validated").otherwise("missing_quote"), "fill_time": when(F.col("entry_0.found")), "fill_price": when(price("entry", 0)), "quote_gross": when(gross(0)), "gross_delta": when(gross(0) - F.col("gross_pnl")),
        "conservative_delta": when(gross(0) - 2 * tick * point_value * F.col("contracts") - F.col("gross_pnl")), "spread_cost": when((F.col("entry_0.spread") + F.col("exit_0.spread")) * point_value * F.col("contracts")),
        "fill_ratio": when(F.when(F.col("contracts") > 0, F.least(F.greatest(F.coalesce(size, F.lit(0.0)), F.lit(0.0)) / F.col("contracts"), F.lit(1.0))).otherwise(0.0)), **{f"delay_{s}_delta": when(gross(s) - F.col("gross_pnl")) for s in delays}})
    x = x.drop(*[f"{k}_{s}" for k in ("entry", "exit") for s in delays])
    late = x.where("status = 'validated'").select("trade_id", "symbol", "side", F.col("fill_price").alias("paid"), "fill_time", F.explode(F.array(*map(F.lit, after))).alias("s"))
    late = asof(late.withColumn("at", F.col("fill_time") + F.expr("make_dt_interval(0, 0, 0, s)")), quotes, ["mid"])
    ticks = (F.col("paid") - F.col("mid")) * sign / tick
    late = late.groupBy("trade_id").agg(*[F.max(F.when(F.col("s") == s, ticks)).alias(f"adverse_{s}") for s in after])
    orders = trades.select("trade_id", "symbol", F.col("entry_time").alias("at"), "side", F.col("entry_price").alias("limit"), "contracts")
    limits = limit_fills(orders, quotes, timeout).select("trade_id", F.col("fill_time").alias("limit_time"))
    x = x.join(late, "trade_id", "left").join(limits, "trade_id", "left")
    known = F.col("status") == "validated"
    return x.withColumns({"limit_filled": F.when(known, F.col("limit_time").isNotNull()), "missed_cost": F.when(known & F.col("limit_time").isNull(), F.greatest("gross_pnl", F.lit(0.0)))})


def execution_summary(rows: DataFrame, delays: tuple = (0, 1, 5), after: tuple = (60, 180, 300, 900)) -> DataFrame:
    """One row a measure: name, samples, mean and a nearest-rank percentile (the 5th of delays, the 95th of moves after a fill)."""
    plain = ["gross_delta", "conservative_delta", "spread_cost", "fill_ratio", "missed_cost"]
    ranked = {**{f"delay_{s}_delta": 0.05 for s in delays}, **{f"adverse_{s}": 0.95 for s in after}}
    rows = cut(rows.select(*plain, *ranked))  # read again by each round of the quantiles
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in [*plain, *ranked]])).alias("m")).select("m.*").where("v IS NOT NULL")
    out = long.groupBy("measure").agg(F.count("*").alias("samples"), (F.sum(F.round("v", 6).cast("decimal(18,6)")).cast("double") / F.count("*")).alias("mean"))
    tails = exact_quantiles(long.where(F.col("measure").isin(list(ranked))), ["measure"], "v", {"low": (0.05, "nearest"), "high": (0.95, "nearest")})
    tails = tails.select("measure", F.when(F.col("measure").isin([n for n, p in ranked.items() if p == 0.95]), F.col("high")).otherwise(F.col("low")).alias("tail"))
    return out.join(tails, "measure", "left")


def paper_replay(trades: DataFrame, start: float = 100_000.0) -> DataFrame:
    """Fills of trades in order of time, with the position and the equity of each symbol after them. trades: trade_id, symbol, side, entry_time, exit_time, entry_price, exit_price, contracts, pnl.

    A trade's profit counts at its exit. At one time exits come before entries, then in order of trade_id.
    """
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    leg = lambda k, rank: F.struct(F.lit(k).alias("leg"), F.lit(rank).alias("rank"), F.col(f"{k}_time").alias("time"), F.col(f"{k}_price").alias("price"), (sign * F.col("contracts") * (1 if k == "entry" else -1)).alias("quantity"), (F.col("pnl") if k == "exit" else F.lit(0).cast(trades.schema["pnl"].dataType)).alias("realized"))
    x = trades.select("trade_id", "symbol", F.explode(F.array(leg("entry", 1), leg("exit", 0))).alias("f")).select("trade_id", "symbol", "f.*")
    w = Window.partitionBy("symbol").orderBy("time", "rank", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({"position": F.sum("quantity").over(w), "equity": F.lit(start) + F.sum("realized").over(w)}).drop("rank", "realized")
