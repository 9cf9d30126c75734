"""Queries of pools: candidates chosen down a ranking under a budget of trades, caps and exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pools as P

QUERIES, ORACLE = {}, {}
#: Least and most that is spent, size of the pool, and the caps of nation, segment and class of balance.
POOLS = {"frequency_pool": (60.0, 64.0, 40, 3, 12, 2), "frequency_pool_overflow": (60.1, 60.1, 80, 4, 40, 3)}


def candidates(spark, sf):
    """Customers as candidates: orders a year times 0.15 * 7 are the cost, orders above 200,000 are wins."""
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("cand")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200_000).alias("wins"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("cand"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    c = c.withColumn("balance", F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 50)))  # none for debtors: not capped
    return o.join(c, "cand").select("cand", "nation", "segment", "balance", (F.col("n") * 0.15).alias("cost"), F.round(F.col("wins") / F.col("n"), 6).alias("rate"))


def twins(c):
    """Neighbours by number of one segment."""
    a, b = c.select(F.col("cand").alias("a"), "segment"), c.select(F.col("cand").alias("b"), "segment", (F.col("cand") - 1).alias("a"))
    return a.join(b, ["a", "segment"]).select("a", "b")


def _pool(name):
    least, most, size, nations, segments, balances = POOLS[name]

    def run(spark, sf):
        c = candidates(spark, sf)
        out = P.select_pool(c, "cand", [F.desc("rate"), F.desc("cost")], "cost", least, most, size, {"nation": nations, "segment": segments, "balance": balances}, twins(c), "rate")
        return out.select("cand", "nation", "segment", "rate", "decision", F.col("spent_before").cast("double").alias("spent_before"))

    QUERIES[name] = run
    ORACLE[name] = f"""WITH RECURSIVE o AS (SELECT o_custkey AS cand, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS wins FROM orders GROUP BY o_custkey),
c AS (SELECT cand, c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 50)::BIGINT END AS balance, (n * 0.15)::DECIMAL(28, 6) AS cost, round(wins / n, 6) AS rate FROM o JOIN customer ON c_custkey = cand),
r AS (SELECT *, row_number() OVER (ORDER BY rate DESC, cost DESC, cand) AS k FROM c),
w AS (SELECT 0::BIGINT AS k, 0::DECIMAL(28, 6) AS spent, 0::DECIMAL(28, 6) AS before, [] ::STRUCT(cand BIGINT, nation INT, segment VARCHAR, balance BIGINT)[] AS pool, NULL::VARCHAR AS decision
  UNION ALL SELECT k, CASE WHEN d = 'taken' THEN spent + cost ELSE spent END, spent, CASE WHEN d = 'taken' THEN list_append(pool, me) ELSE pool END, d FROM (
    SELECT r.k, spent, cost, pool, struct_pack(cand := r.cand, nation := r.nation, segment := r.segment, balance := r.balance) AS me,
      CASE WHEN spent >= {least} OR len(pool) >= {size} THEN 'stopped'
        WHEN len(list_filter(pool, lambda p: p.nation = r.nation)) >= {nations} OR len(list_filter(pool, lambda p: p.segment = r.segment)) >= {segments} OR len(list_filter(pool, lambda p: p.balance = r.balance)) >= {balances} THEN 'capped'
        WHEN len(list_filter(pool, lambda p: p.segment = r.segment AND abs(p.cand - r.cand) = 1)) > 0 THEN 'twin' WHEN spent + cost > {most} THEN 'costly' ELSE 'taken' END AS d
    FROM w JOIN r ON r.k = w.k + 1)),
e AS (SELECT spent, pool FROM w ORDER BY k DESC LIMIT 1),
one AS (SELECT r.cand FROM r JOIN w USING (k), e WHERE w.decision <> 'taken' AND e.spent < {least} AND len(e.pool) < {size} AND len(list_filter(e.pool, lambda p: p.nation = r.nation)) < {nations} AND len(list_filter(e.pool, lambda p: p.segment = r.segment)) < {segments}
  AND len(list_filter(e.pool, lambda p: p.balance = r.balance)) < {balances} AND len(list_filter(e.pool, lambda p: p.segment = r.segment AND abs(p.cand - r.cand) = 1)) = 0 ORDER BY abs(e.spent + cost - {least}), rate DESC, r.k LIMIT 1)
SELECT r.cand, nation, segment, rate, CASE WHEN r.cand IN (SELECT cand FROM one) THEN 'nearest' ELSE w.decision END AS decision, w.before::DOUBLE AS spent_before FROM r JOIN w USING (k)"""


for _name in POOLS:
    _pool(_name)
