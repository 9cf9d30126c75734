"""Domain tables made from the star-schema tables: ticks (also quotes), macro events, trades and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, timestamp, bid, ask, bid_size, ask_size, mid, spread, seq; seq breaks ties of time."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_type AS symbol", "ts AS timestamp", "100 + value / 10 AS mid", "0.25D * (1 + user_id % 4) AS spread", "cast(1 + user_id % 5 AS double) AS bid_size", "cast(1 + event_id % 7 AS double) AS ask_size", "event_id AS seq").selectExpr(
        "symbol", "timestamp", "mid - spread / 2 AS bid", "mid + spread / 2 AS ask", "bid_size", "ask_size", "mid", "spread", "seq")


def macro_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar with an event for each supplier: 30 minutes before, 10 of release and 45 after it; some concern all symbols."""
    e = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(s_suppkey * 43 % 43200 AS int)) AS event_time", "cast(s_nationkey % 3 AS int) AS importance",
                                                    "element_at(array('click', 'error', 'purchase', 'signup', 'view', '*'), cast(s_suppkey % 6 + 1 AS int)) AS symbol")
    return e.selectExpr("*", "event_time - INTERVAL 30 MINUTES AS pre_from", "event_time + INTERVAL 10 MINUTES AS release_to", "event_time + INTERVAL 55 MINUTES AS post_to")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade for each event, held for an hour."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS trade_id", "event_type AS symbol", "ts AS entry_time", "ts + INTERVAL 60 MINUTES AS exit_time", "CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side", "cast(1 + user_id % 3 AS int) AS contracts")


def order_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: grp, ts, seq, pnl."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS grp", "o_orderdate AS ts", "o_orderkey AS seq", "o_totalprice - 250000 AS pnl", "o_orderstatus AS status", "o_custkey AS custkey")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of contracts: day, contract, size."""
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate AS date) AS day", "l_suppkey AS contract", "l_quantity AS size")
