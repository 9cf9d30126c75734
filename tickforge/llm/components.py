"""Connected components of links, by alternating stars; no neighbourhood is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SALTS = 8


def with_minimum(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m); a node with very many edges is spread over SALTS tasks."""
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of links (a, b); component is the smallest id reachable."""
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_minimum(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = with_minimum(large, least)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        step += 1
        edges = scratch.table(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
