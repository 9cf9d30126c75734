"""Tables of appended versions: the last version of a key counts, and compaction keeps what is read from growing with what was written.

A version is a folder of Parquet. A manifest names a base folder and the last version in it; readers take the newest manifest, its
base and the versions after it. Compaction writes a new base, then its manifest by one rename, so a reader sees the
table before or after it and never between. What no manifest needs any more goes by vacuum, when no reader uses it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    _, fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def append_version(rows: DataFrame, root: str, number: int) -> None:
    """Writes version `number`; a repeated one replaces itself, as a repeated micro-batch does."""
    rows.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/version-{number:012d}")


def manifest(spark: SparkSession, root: str) -> tuple[str | None, int]:
    """The base folder and the last version in it; (None, -1) before the first compaction."""
    found = [c for c in _children(spark, f"{root}/manifests") if c.endswith(".json")]
    if not found:
        return None, -1
    held = json.loads(spark.read.option("wholetext", True).text(f"{root}/manifests/{found[-1]}").first()[0])
    return held["base"], held["upto"]


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the base and of the versions after it, with their version."""
    base, upto = manifest(spark, root)
    paths = [f"{root}/{c}" for c in _children(spark, root) if c.startswith("version-") and int(c[8:]) > upto]
    paths += [f"{root}/{base}"] if base else []
    if not paths:
        raise FileNotFoundError(f"no version under {root}")
    return spark.read.parquet(*paths)


def last_version(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The last version of each key."""
    return _last(read_versions(spark, root), keys).drop("version")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, root: str, keys: list[str]) -> int:
    """Makes all versions that are there one base, and tells the last version in it."""
    versions = [int(c[8:]) for c in _children(spark, root) if c.startswith("version-")]
    before, upto = manifest(spark, root)
    last = max(versions, default=-1)
    if last <= upto:
        return upto
    base = f"base-{last:012d}-{uuid.uuid4().hex}"
    _last(read_versions(spark, root).where(F.col("version") <= last), keys).write.parquet(f"{root}/{base}")
    jvm, fs, at = _fs(spark, f"{root}/manifests/{last:012d}.json.new-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"base": base, "upto": last}).encode()))
    out.close()
    if not fs.rename(at, jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{last:012d}.json")):
        raise OSError(f"another compaction of {root} came first")
    return last


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the folders that the newest manifest doesn't need, and how many they were."""
    base, upto = manifest(spark, root)
    old = [c for c in _children(spark, root) if (c.startswith("version-") and int(c[8:]) <= upto) or (c.startswith("base-") and c != base and c[5:17] <= f"{upto:012d}")]
    for c in old:
        _, fs, at = _fs(spark, f"{root}/{c}")
        fs.delete(at, True)
    return len(old)


def merged_map(under: Column, over: Column) -> Column:
    """A map with the entries of both; of a key in both the second map's value counts."""
    under, over = F.coalesce(under, F.create_map().cast("map<string,string>")), F.coalesce(over, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def memory_view(evidence: DataFrame, decisions: DataFrame, outcomes: DataFrame, where: str | None = None, limit: int | None = None) -> DataFrame:
    """A row for each decision with its evidence and outcome, and for each evidence without a decision; the latest first where limited.

    evidence: evidence_id, at, module, facts (map of strings); decisions: decision_id, evidence_id, at, decision; outcomes: decision_id, label, facts.
    Out come evidence_id, decision_id, at (the decision's, else the evidence's), module, decision, label and facts, where the outcome's
    entries count before the evidence's. where is a condition on these.
    """
    e = evidence.select("evidence_id", F.col("at").alias("e_at"), "module", F.col("facts").alias("e_facts"))
    d = decisions.where("evidence_id IS NOT NULL").select("decision_id", "evidence_id", F.col("at").alias("d_at"), "decision")
    o = outcomes.select("decision_id", "label", F.col("facts").alias("o_facts"))
    x = e.join(d, "evidence_id", "full_outer").join(o, "decision_id", "left")
    x = x.select("evidence_id", "decision_id", F.coalesce("d_at", "e_at").alias("at"), "module", "decision", "label", merged_map(F.col("e_facts"), F.col("o_facts")).alias("facts"))
    x = x.where(where) if where else x
    return x.orderBy(F.desc("at"), F.desc_nulls_last("decision_id"), "evidence_id").limit(limit) if limit else x
