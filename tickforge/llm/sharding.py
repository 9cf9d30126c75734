"""Proportional stratified interleaving of a table into shards (DataFrame functions only).

Rows of each source are put in a seeded shuffled order; the row of rank r among the n of its source gets the
fraction (r - 1 + u) / n, where u in (0, 1) comes from the source's name, so sources of one row spread too.
All rows are sorted by that fraction and the order is cut into shards of equal row counts, so every run of
consecutive rows, and so every shard, holds the sources in the mixture of the whole table.

No sort is global and no window holds a whole source: ranks and positions are taken inside cells of the
shuffle key (then of the fraction), and prefix sums over the cells' counts make them global. A source that
holds a third of all rows spreads over all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ROWS_PER_CELL = 50_000
LEAST_CELL_BITS = 10
SEED = 20_240_117


def _unit(*cols: Column) -> Column:
    """Uniform in (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) + F.lit(0.5)) / F.lit(float(1 << 20))


def _before(order: str, *part: str) -> Column:
    """Sum of the counts of the cells before a cell."""
    w = (Window.partitionBy(*part) if part else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("cell_rows").over(w), F.lit(0))


def stratified_shards(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text",
                      stratum_col: str = "source", seed: int = SEED) -> DataFrame:
    """Columns id_col, stratum_col, size, text_crc32, position, shard, slot for every row of docs.

    Law `rows`: the counts of shards are at most one apart; slot counts from 0 inside a shard without gaps.
    The method groups rows by stratum only; equal texts are not kept together (a group larger than a shard
    could not be, under this law).

    A null text counts as empty (size 8, CRC 0); a null stratum is a stratum of its own; rows with null or
    repeated ids are placed like others; rows equal in every input fill adjacent places of one order. Texts of any
    length count whole. An empty table gives no rows. Other columns of docs, whatever their names, are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    narrow = narrow.withColumn("key", F.when(F.col("stratum").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("stratum").cast("string"))))
    narrow = narrow.withColumn("h", F.xxhash64(F.lit(seed), "id", "key", "size", "crc"))
    scratch = Scratch(docs.sparkSession, "sharding")
    narrow = scratch.table(narrow, "narrow")  # the texts are read once
    rows = narrow.count()
    bits = max(LEAST_CELL_BITS, (max(1, rows // ROWS_PER_CELL) - 1).bit_length())
    narrow = narrow.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))

    tie = ["h", "id", "size", "crc"]
    cells = narrow.groupBy("key", "cell").agg(F.count("*").alias("cell_rows"))
    cells = cells.select("key", "cell", _before("cell", "key").alias("before"), F.sum("cell_rows").over(Window.partitionBy("key")).alias("n"))
    ranked = narrow.withColumn("in_cell", F.row_number().over(Window.partitionBy("key", "cell").orderBy(*tie)))
    ranked = ranked.join(cells, ["key", "cell"])
    frac = (F.col("before") + F.col("in_cell") - 1 + _unit(F.lit(seed), F.col("key"))) / F.col("n")
    ranked = ranked.select("id", "stratum", "key", "size", "crc", "h", frac.alias("frac"))
    ranked = scratch.table(ranked.withColumn("slice", F.floor(F.col("frac") * (1 << bits))), "ranked")

    slices = ranked.groupBy("slice").agg(F.count("*").alias("cell_rows")).select("slice", _before("slice").alias("before"))
    placed = ranked.withColumn("in_slice", F.row_number().over(Window.partitionBy("slice").orderBy("frac", "key", *tie)))
    placed = placed.join(slices, "slice").withColumn("position", F.col("before") + F.col("in_slice") - 1)
    shard = F.expr(f"((position + 1) * {shards} - 1) div {max(1, rows)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(bigint(shard) * {rows}) div {shards}")
    return placed.select(
        F.col("id").alias(id_col), F.col("stratum").alias(stratum_col), "size", F.col("crc").alias("text_crc32"), "position",
        "shard", (F.col("position") - start).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`."""
    out = stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
