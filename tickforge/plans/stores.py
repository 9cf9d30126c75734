"""Queries over stored tables and exact selections: windows pushed into the scan, the memory of decisions, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantiles as Q
from ..sources import fixtures as S
from ..sources import statistics as Z
from ..sources import versions as V
from . import sqlbase as D
from .market import r6
from .streams import _folder

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_WANTED = {"p05": (0.05, "linear"), "p50": (0.5, "linear"), "p95": (0.95, "linear"), "n95": (0.95, "nearest"), "d95": (0.95, "discrete")}


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice))
SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0)) AS n95, quantile_disc(v, 0.95) AS d95 FROM x GROUP BY ALL""")
def exact_quantiles(spark, sf):
    """Three definitions of a quantile of prices."""
    return r6(Q.exact_quantiles(S.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _WANTED))


def _windows(spark, sf):
    e = S.macro_events(spark, sf).where("importance >= 1")
    every = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return e.select(F.explode(F.when(F.col("symbol") == "*", every).otherwise(F.array("symbol"))).alias("symbol"), F.col("pre_from").alias("start"), F.col("post_to").alias("end"))


@query(f"""WITH {D.TICKS}, w AS (SELECT ['click', 'error', 'purchase', 'signup', 'view', '*'][s_suppkey % 6 + 1] AS symbol, TIMESTAMP '2024-01-01' + to_minutes(s_suppkey * 43 % 43200) AS t FROM supplier WHERE s_nationkey % 3 >= 1)
SELECT symbol, timestamp, seq, round(bid, 6) AS bid FROM ticks WHERE EXISTS (SELECT 1 FROM w WHERE (w.symbol = ticks.symbol OR w.symbol = '*') AND ticks.timestamp BETWEEN t - INTERVAL 30 MINUTES AND t + INTERVAL 55 MINUTES)""")
def quotes_pruned(spark, sf):
    """Quotes around events of some importance, from a table stored by day of which only the files with such times are opened."""
    at = _folder(spark)
    t = S.ticks(spark, sf).withColumn("day", F.to_date("timestamp"))
    t.repartition("day").sortWithinPartitions("day", "symbol", "timestamp").write.partitionBy("day").parquet(f"{at}/quotes")
    stats = Z.file_statistics(spark, f"{at}/quotes", tasks=8)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.drop("day").schema)
    return r6(Z.scan_windows(spark, stats, _windows(spark, sf), schema).select("symbol", "timestamp", "seq", "bid"))


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events), d AS (SELECT *, CASE WHEN value > 20 THEN 'allow' WHEN value < 5 THEN 'block' END AS decision, CASE WHEN value > 40 THEN 'win' WHEN value > 20 THEN 'loss' END AS label FROM e)
SELECT event_id AS evidence_id, CASE WHEN decision IS NOT NULL THEN 'd' || event_id END AS decision_id, CASE WHEN decision IS NULL THEN ts ELSE ts + INTERVAL 5 MINUTES END AS "at", decision, label, CASE WHEN label IS NULL THEN k ELSE label || ':' || k END AS k, user_id::VARCHAR AS "user" FROM d WHERE event_type = 'purchase'""")
def trigger_memory(spark, sf):
    """Evidence, decisions and outcomes that were appended in versions, some of them twice, and compacted in between."""
    at = _folder(spark)
    e = S.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    first = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    facts = lambda k: F.create_map(F.lit("k"), k, F.lit("user"), F.col("user_id").cast("string"))
    evidence = e.select(F.col("event_id").alias("evidence_id"), F.col("ts").alias("at"), F.col("event_type").alias("module"), facts(F.col("k")).alias("facts"), first.alias("early"))
    decision = F.when(F.col("value") > 20, "allow").when(F.col("value") < 5, "block")
    decisions = e.withColumn("decision", decision).where("decision IS NOT NULL").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("decision_id"), F.col("event_id").alias("evidence_id"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("at"), "decision")
    label = F.when(F.col("value") > 40, "win").otherwise("loss")
    outcomes = e.where("value > 20").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("decision_id"), label.alias("label"), F.create_map(F.lit("k"), F.concat_ws(":", label, "k")).alias("facts"))
    V.append_version(evidence.where("early").withColumn("facts", F.create_map(F.lit("k"), F.lit("to be replaced"))).drop("early"), f"{at}/evidence", 0)
    V.append_version(evidence.where("early").drop("early"), f"{at}/evidence", 1)
    V.compact(spark, f"{at}/evidence", ["evidence_id"])
    V.append_version(evidence.where("NOT early").drop("early"), f"{at}/evidence", 2)
    V.append_version(decisions, f"{at}/decisions", 0)
    V.append_version(outcomes, f"{at}/outcomes", 0)
    held = V.last_version(spark, f"{at}/evidence", ["evidence_id"]), V.last_version(spark, f"{at}/decisions", ["decision_id"]), V.last_version(spark, f"{at}/outcomes", ["decision_id"])
    x = V.memory_view(*held, where="module = 'purchase'")
    return x.select("evidence_id", "decision_id", "at", "decision", "label", F.col("facts")["k"].alias("k"), F.col("facts")["user"].alias("user"))
