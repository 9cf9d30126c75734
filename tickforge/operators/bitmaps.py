"""Thousands of predicate trees over one scan of a feature table.

Each different leaf of all trees becomes one bitmap for each symbol and run of BITS bars, built by Spark's bitmap aggregate
with partial aggregation. A run is then one row: its bitmaps and the outcomes of its bars. Trees are evaluated there by AND,
OR and NOT of whole bitmaps; a leaf that a thousand trees share is compared once. Counts and sums of the runs are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import leaf, leaves

#: Bits of Spark's bitmaps.
BITS = 32_768
#: Outcomes are added as whole numbers of this part of a point, so sums don't depend on the order of rows.
SCALE = 1_000_000
_OUT = "name string, symbol string, n long, wins long, gain long, loss long"


def _key(node: dict) -> tuple:
    return node["feature"], node["op"], str(node["value"])


def evaluate(node: dict | None, maps: dict[tuple, np.ndarray], full: np.ndarray) -> np.ndarray:
    """The bitmap of a tree, as grammar.compile_node decides row by row."""
    if not node:
        return full
    out = full
    for x in node.get("all", []):
        out = out & evaluate(x, maps, full)
    if "any" in node:
        some = np.zeros_like(full)
        for x in node["any"]:
            some = some | evaluate(x, maps, full)
        out = out & some
    if "not" in node:
        out = out & ~evaluate(node["not"], maps, full)
    if "feature" in node:
        out = out & maps[_key(node)]
    return out


def tree_results(features: DataFrame, trees: list[dict], outcome: str) -> DataFrame:
    """name, symbol, n, wins, total, gain and loss of the rows that each tree (name, direction, entry) selects.

    outcome is the column of a row's result for a long position; rows where it is null are left out. Trees without rows in a symbol have
    none. A feature table has one row a symbol and timestamp.
    """
    once = {}
    for t in trees:
        for x in leaves(t["entry"]):
            once.setdefault(_key(x), x)
    keys = list(once)
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1
    value = F.round(F.col(outcome) * SCALE).cast("long")
    conditions = [leaf(x, features.columns).alias(f"leaf{k}") for k, x in enumerate(once.values())]
    rows = features.where(F.col(outcome).isNotNull()).select("symbol", i.alias("i"), value.alias("value"), *conditions)
    bit = (F.col("i") % BITS).cast("long")
    runs = rows.groupBy("symbol", F.floor(F.col("i") / BITS).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct(bit.alias("bit"), "value"))).alias("values"), *(F.bitmap_construct_agg(F.when(F.col(f"leaf{k}"), bit)).alias(f"leaf{k}") for k in range(len(keys))))
    runs = runs.select("symbol", F.col("values.value").alias("values"), *(f"leaf{k}" for k in range(len(keys))))

    def run(batches):
        for batch in batches:
            symbols, values, *columns = batch.columns
            for r in range(batch.num_rows):
                value = np.array(values[r].as_py(), np.int64)
                full = np.packbits(np.ones(len(value), np.uint8), bitorder="little")
                maps = {k: np.frombuffer(c[r].as_py(), np.uint8)[:len(full)] & full for k, c in zip(keys, columns)}
                out = []
                for t in trees:
                    chosen = value[np.unpackbits(evaluate(t["entry"], maps, full), count=len(value), bitorder="little").view(bool)] * t["direction"]
                    if len(chosen):
                        out.append((t["name"], symbols[r].as_py(), len(chosen), int((chosen > 0).sum()), int(chosen[chosen > 0].sum()), -int(chosen[chosen < 0].sum())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[c.split()[0] for c in _OUT.split(", ")])

    found = runs.mapInArrow(run, _OUT).groupBy("name", "symbol").agg(*(F.sum(c).alias(c) for c in ("n", "wins", "gain", "loss")))
    points = lambda c: c / F.lit(float(SCALE))
    return found.select("name", "symbol", "n", "wins", points(F.col("gain") - F.col("loss")).alias("total"), points(F.col("gain")).alias("gain"), points(F.col("loss")).alias("loss"))
