"""Streaming queries run to the end of their input, beside the SQL of the same batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..session import shared_folder
from ..sources import fixtures as S
from ..sources import versions
from ..streaming import bars as T
from ..streaming import sessions as G
from . import sqlbase as D
from .market import r6

QUERIES, ORACLE = {}, {}


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


FILES = 4


def _arrivals(spark, sf, folder: str, parts: int = 4, order: str = "time") -> DataFrame:
    """Ticks in the parts in which they arrive, and a last tick far ahead that moves the watermark past all others.

    order: time; late, where every tenth tick comes a part later than its time; or mixed, by their numbers, so that bars arrive in pieces.
    """
    t = in_parts(S.ticks(spark, sf), parts, order)
    arrive(t, folder, range(parts))
    end = spark.sql("SELECT 'end' AS symbol, TIMESTAMP_NTZ '2100-01-01 00:00:00' AS timestamp, 0D AS bid, 0D AS ask, 0D AS bid_size, 0D AS ask_size, 0D AS mid, 0D AS spread, -1L AS seq")
    end.write.mode("append").parquet(folder)
    return T.tick_stream(spark, folder, t.drop("part").schema, FILES)


def in_parts(t: DataFrame, parts: int, order: str) -> DataFrame:
    first, last = t.agg(F.min(F.unix_micros(F.col("timestamp").cast("timestamp"))), F.max(F.unix_micros(F.col("timestamp").cast("timestamp")))).first()
    by_time = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - F.lit(first)) * parts / F.lit(last - first + 1)).cast("int")
    by_time = by_time + (F.col("seq") % 10 == 3).cast("int") if order == "late" else by_time
    return t.withColumn("part", F.col("seq") % parts if order == "mixed" else F.least(by_time, F.lit(parts - 1)))


def arrive(rows: DataFrame, folder: str, parts) -> None:
    """Writes the rows of each part after those of the part before, in FILES files, which are one micro-batch (unless some are empty)."""
    for k in parts:
        rows.where(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(folder)


def stream_minute_bars(spark, sf):
    at = _folder(spark)
    T.run_available(T.minute_bars(_arrivals(spark, sf, f"{at}/in"), 15, "30 days"), f"{at}/out", f"{at}/state")
    out = spark.read.parquet(f"{at}/out").where("symbol <> 'end'")
    return r6(out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("tick_count", F.col("tick_count").cast("int")))


def stream_dedupe(spark, sf):
    at = _folder(spark)
    s = _arrivals(spark, sf, f"{at}/in")
    T.run_available(T.deduplicated(s.withColumn("slot", F.date_trunc("hour", "timestamp")), ["symbol", "slot"], "30 days").select("symbol", "slot"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").where("symbol <> 'end'").select("symbol", F.col("slot").cast("timestamp_ntz").alias("slot"))


def stream_cooldown(spark, sf):
    at = _folder(spark)
    T.run_available(T.cooldown(_arrivals(spark, sf, f"{at}/in"), 3600), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").where("symbol <> 'end'").select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "seq")


def stream_lookback_signal(spark, sf):
    at = _folder(spark)
    bars = B.tick_bars(S.ticks(spark, sf), 60).select("symbol", "timestamp", "close")
    bars.write.parquet(f"{at}/in")
    s = spark.readStream.schema(bars.schema).parquet(f"{at}/in").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    T.run_available(T.lookback_signals(s), f"{at}/out", f"{at}/state")
    return r6(spark.read.parquet(f"{at}/out").select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "z"))


def stream_upsert_bars(spark, sf):
    """Bars as they stand after every micro-batch: later versions of a bar replace earlier ones."""
    at = _folder(spark)
    T.upsert_available(T.minute_bars(_arrivals(spark, sf, f"{at}/in", order="mixed"), 60, "40 days"), f"{at}/out", f"{at}/state", ["symbol", "timestamp"], compact_every=2)
    out = versions.last_version(spark, f"{at}/out", ["symbol", "timestamp"]).where("symbol <> 'end'")
    return r6(out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("tick_count", F.col("tick_count").cast("int")))


def stream_merge(spark, sf):
    """Repeated reports of one order: equal ones count once, gaps are filled by later ones, and a different value is a conflict."""
    at = _folder(spark)
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"))
    arrive(e.withColumn("part", F.ntile(3).over(Window.partitionBy(F.col("seq") % 8).orderBy("seq"))), f"{at}/in", range(1, 4))
    T.run_available(T.merged_reports(T.tick_stream(spark, f"{at}/in", e.schema, FILES), ["kind"], "20 days"), f"{at}/out", f"{at}/state", "append")
    return spark.read.parquet(f"{at}/out").groupBy("outcome").agg(F.count("*").alias("n"))


def stream_plans(spark, sf):
    """Signals that are planned: each hash once, so many a day and symbol."""
    at = _folder(spark)
    s = _arrivals(spark, sf, f"{at}/in").where("symbol <> 'end'").withColumn("hash", F.sha2(F.concat_ws("|", "symbol", F.date_trunc("hour", "timestamp").cast("string")), 256))
    T.run_available(T.planned(s, 5), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "seq")


def stream_gaps(spark, sf):
    """Gaps of more than an hour inside a day, told when they have closed; every tenth tick comes late."""
    at = _folder(spark)
    T.run_available(G.gaps(_arrivals(spark, sf, f"{at}/in", order="late"), 60, "16 days"), f"{at}/out", f"{at}/state")
    out = spark.read.parquet(f"{at}/out")
    return out.select("symbol", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("gap_from", "gap_to")))


def stream_outages(spark, sf):
    """Times when a symbol had no tick for 90 minutes, told by a clock and not by the next tick."""
    at = _folder(spark)
    ticks = _arrivals(spark, sf, f"{at}/in", order="late").where("symbol <> 'end'")
    hours = in_parts(S.ticks(spark, sf), 4, "time").select(F.date_trunc("hour", "timestamp").alias("timestamp"), "part").distinct()
    arrive(hours, f"{at}/clock", range(4))
    spark.sql("SELECT TIMESTAMP '2100-01-01 00:00:00' AS timestamp").write.mode("append").parquet(f"{at}/clock")
    clock = T.tick_stream(spark, f"{at}/clock", hours.drop("part").schema, FILES)
    T.run_available(G.outages(ticks, 5400, "16 days", clock), f"{at}/out", f"{at}/state")
    out = spark.read.parquet(f"{at}/out")
    return out.select("symbol", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_tick", "stale_from")))


QUERIES |= {"stream_gaps": stream_gaps, "stream_outages": stream_outages, "stream_upsert_bars": stream_upsert_bars, "stream_merge": stream_merge, "stream_plans": stream_plans, "stream_minute_bars": stream_minute_bars, "stream_dedupe": stream_dedupe, "stream_cooldown": stream_cooldown, "stream_lookback_signal": stream_lookback_signal}
ORACLE |= {
    "stream_gaps": f"WITH {D.TICKS} SELECT * FROM (SELECT symbol, lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS gap_from, timestamp AS gap_to FROM ticks) WHERE gap_to > gap_from + INTERVAL 60 MINUTES AND gap_from::DATE = gap_to::DATE",
    "stream_outages": f"WITH {D.TICKS} SELECT symbol, timestamp AS last_tick, timestamp + INTERVAL 90 MINUTES AS stale_from FROM (SELECT symbol, timestamp, lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS next FROM ticks) WHERE next IS NULL OR next > timestamp + INTERVAL 90 MINUTES",
    "stream_upsert_bars": f"WITH {D.bars(60)} SELECT symbol, timestamp, tick_count, {D.rounded('open high low close')} FROM bars",
    "stream_plans": f"""WITH {D.TICKS}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('hour', timestamp) ORDER BY timestamp, seq) AS k FROM ticks), d AS (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp::DATE ORDER BY timestamp, seq) AS n FROM f WHERE k = 1) SELECT symbol, timestamp, seq FROM d WHERE n <= 5""",
    "stream_merge": """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, ntile(3) OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS part FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY part, seq) AS k FROM o),
m AS (SELECT key, k, kind AS held, 'new' AS outcome FROM n WHERE k = 1 UNION ALL SELECT n.key, n.k, coalesce(m.held, n.kind), CASE WHEN n.kind IS NULL OR n.kind = m.held THEN 'duplicate' WHEN m.held IS NULL THEN 'enriched' ELSE 'conflict' END FROM m JOIN n ON n.key = m.key AND n.k = m.k + 1) SELECT outcome, count(*) AS n FROM m GROUP BY outcome""",
    "stream_minute_bars": f"WITH {D.bars(15)} SELECT symbol, timestamp, tick_count, {D.rounded('open high low close')} FROM bars",
    "stream_dedupe": f"WITH {D.TICKS} SELECT DISTINCT symbol, date_trunc('hour', timestamp) AS slot FROM ticks",
    "stream_cooldown": f"""WITH RECURSIVE {D.TICKS}, n AS (SELECT symbol, timestamp, seq, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS k FROM ticks),
c AS (SELECT symbol, timestamp, seq, k, timestamp AS held, true AS ok FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.timestamp, n.seq, n.k, CASE WHEN n.timestamp >= c.held + INTERVAL 1 HOUR THEN n.timestamp ELSE c.held END, n.timestamp >= c.held + INTERVAL 1 HOUR
  FROM c JOIN n ON n.symbol = c.symbol AND n.k = c.k + 1) SELECT symbol, timestamp, seq FROM c WHERE ok""",
    "stream_lookback_signal": f"""WITH {D.bars(60)}, x AS (SELECT symbol, timestamp, close, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, timestamp, {D.rounded('z')} FROM (SELECT *, CASE WHEN s > 0 THEN (close - m) / s ELSE 0 END AS z FROM x WHERE n = 20) WHERE abs(z) >= 1.5""",
}
