"""Stores of runs as tables that are only appended to: experiments, trials, audit, orders. The last row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import existing

SCHEMAS = {
    "experiments": "experiment_id string, symbol string, status string, metadata string",
    "trials": "experiment_id string, trial_id string, strategy string, spec_hash string, status string, passed boolean, score double, net_test double, sharpe_test double, reasons array<string>, result string",
    "audit": "experiment_id string, trial_id string, event_type string, payload string",
    "orders": "intent_id string, status string, detail string",
}
KEYS = {"experiments": ["experiment_id"], "trials": ["trial_id"], "orders": ["intent_id"]}
#: States that may follow each state of an order: fixed values.
NEXT = {
    "created": ["risk_rejected", "risk_approved"], "risk_rejected": [], "risk_approved": ["pending_human_approval", "approved"], "pending_human_approval": ["human_rejected", "approved"], "human_rejected": [], "approved": ["submitted"],
    "submitted": ["accepted", "failed"], "accepted": ["partially_filled", "filled", "cancel_requested", "failed"], "partially_filled": ["filled", "cancel_requested", "failed"], "filled": ["reconciled"], "cancel_requested": ["cancelled", "failed"],
    "cancelled": ["reconciled"], "failed": [], "reconciled": [],
}


def append(spark: SparkSession, root: str, store: str, rows: list[tuple] | DataFrame) -> None:
    """Adds rows with the time and an order among rows of one time."""
    d = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, SCHEMAS[store])
    d = d.withColumns({"recorded_at": F.current_timestamp(), "seq": F.monotonically_increasing_id()})
    d.write.mode("append").parquet(f"{root}/{store}")


def history(spark: SparkSession, root: str, store: str) -> DataFrame:
    """All rows of a store; none before the first."""
    schema = SCHEMAS[store] + ", recorded_at timestamp, seq long"
    return spark.read.schema(schema).parquet(f"{root}/{store}") if existing(spark, [f"{root}/{store}"]) else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, store: str) -> DataFrame:
    """The last row of each key."""
    d, keys = history(spark, root, store), KEYS[store]
    rest = [c for c in d.columns if c not in (*keys, "recorded_at", "seq")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("recorded_at", "seq")).alias("r")).select(*keys, "r.*")


def experiment_summary(spark: SparkSession, root: str) -> DataFrame:
    """Each experiment with its trials, those that passed, the best of them and the reasons against the others."""
    t = current(spark, root, "trials")
    sums = t.groupBy("experiment_id").agg(F.count("*").alias("trials"), F.count_if("passed").alias("passed"), F.max_by("trial_id", F.struct(F.when(F.col("passed"), F.col("score")), "trial_id")).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return current(spark, root, "experiments").join(sums, "experiment_id", "left")


def bad_transitions(changes: DataFrame) -> DataFrame:
    """Changes of state that aren't allowed. changes: intent_id, at, status."""
    from pyspark.sql import Window

    w = Window.partitionBy("intent_id").orderBy("at")
    allowed = changes.sparkSession.createDataFrame([(a, b) for a, bs in NEXT.items() for b in bs] + [(None, "created")], "before string, status string")
    x = changes.withColumn("before", F.lag("status").over(w))
    y = allowed.withColumnsRenamed({"before": "b", "status": "s"})
    return x.join(y, x.before.eqNullSafe(y.b) & (x.status == y.s), "left_anti").select("intent_id", "at", "before", "status")
