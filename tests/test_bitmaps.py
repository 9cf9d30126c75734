"""Trees on bitmaps against the same trees compiled to columns."""

import pytest
from pyspark.sql import functions as F

from tickforge.functions import families as G
from tickforge.functions.grammar import compile_node
from tickforge.operators import bitmaps as M
from tickforge.plans import grammars
from tickforge.plans.market import hourly

SF = "/root/testdata/sf0.001"


def by_columns(features, trees, outcome):
    rows = features.where(F.col(outcome).isNotNull())
    whole = F.round(F.col(outcome) * M.SCALE).cast("long")
    picked = F.explode(F.array_compact(F.array(*[F.when(compile_node(t["entry"], features.columns), F.struct(F.lit(t["name"]).alias("name"), (whole * t["direction"]).alias("v"))) for t in trees])))
    x = rows.select("symbol", picked.alias("x")).groupBy("x.name", "symbol").agg(F.count("*").alias("n"), F.count_if(F.col("x.v") > 0).alias("wins"), F.sum("x.v").alias("total"))
    return {(r.name, r.symbol): (r.n, r.wins, round(r.total / M.SCALE, 6)) for r in x.collect()}


@pytest.mark.parametrize("bits", [64, 32_768])
def test_every_tree_equals_its_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BITS", bits)
    f = grammars.grammar_features(hourly(spark, SF)).withColumn("p", F.col("return_1m"))
    f = spark.createDataFrame(f.collect(), f.schema)
    levels = {"close_zscore_20": [-1, 0, 1], "relative_volume_20": [0.8, 1.2], "ema_spread": [0], "vwap_dist": [-1, 0, 1], "pullback_depth": [0.5, 2]}
    odd = [{"name": "everything", "direction": 1, "entry": None}, {"name": "nothing", "direction": 1, "entry": {"any": []}}, {"name": "unknown", "direction": 1, "entry": {"feature": "no_such", "op": ">", "value": 0}},
           {"name": "not_null", "direction": -1, "entry": {"not": {"feature": "ema_spread", "op": ">", "value": "vwap_dist"}}}, {"name": "nested", "direction": 1, "entry": {"all": [{"any": [{"feature": "vwap_dist", "op": "<", "value": "0"}, {"not": {"feature": "return_5m", "op": "!=", "value": 1}}]}], "feature": "return_1m", "op": ">=", "value": 0.1}}]
    trees = [*G.base_families(), *G.seeded_trees(levels, 120, 3), *odd]
    assert len({t["name"] for t in trees}) == len(trees) == 7 * 2 + 6 * 5 * 2 + 120 + 5
    got = {(r.name, r.symbol): (r.n, r.wins, round(r.total, 6)) for r in M.tree_results(f, trees, "p").collect()}
    want = by_columns(f, trees, "p")
    assert got == want and len(want) > 300 and not any(n.startswith(("nothing", "unknown")) for n, _ in want)


def test_seeded_trees_are_the_same_each_time():
    levels = {"a": [1, 2], "b": [0], "c": [5]}
    a, b = (G.seeded_trees(levels, 30, 9) for _ in range(2))
    assert a == b != G.seeded_trees(levels, 30, 10) and len({str(t["entry"]) for t in a}) == len(a)
    assert len(G.seeded_trees({"a": [1], "b": [2]}, 10_000, 1, (2, 2))) < 100  # as many as there are


def test_one_scan(spark):
    f = spark.createDataFrame([], "symbol string, timestamp timestamp_ntz, x double, y double, p double")
    trees = G.seeded_trees({"x": [1, 2, 3], "y": [1, 2]}, 50, 4, (1, 2))
    plan = M.tree_results(f, trees, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bitmap_construct_agg") == len({str(x) for t in trees for x in M.leaves(t["entry"])}) and plan.count("LogicalRDD") == 1 and "Generate" not in plan
    assert M.tree_results(f, trees, "p").count() == 0
