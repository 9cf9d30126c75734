"""Greedy selection of a pool under a budget, caps and exclusions, as the walk down the ranking would choose, without walking.

Of each candidate two bounds are known: what is surely taken before it, and what may be. One that breaks a limit already by the first
is out, one that keeps all limits even by the second is in, and both decisions narrow the bounds of those behind. The first undecided
one has equal bounds, so every round decides something; usually whole stretches. Running sums go by block of the ranking, with the sums of
earlier blocks added, so neither the ranking nor a large key lies in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_MONEY, _PLACE = "decimal(28,6)", ["block", "pos"]


def _with_before(d: DataFrame, key: str | None, sums: dict[str, Column]) -> DataFrame:
    """Adds to each row sums over all earlier rows, or all of its key; rows without a key get nulls."""
    by = [key] if key else []
    d = d.withColumns({f"v_{c}": v for c, v in sums.items()})
    total = d.groupBy(*by, "block").agg(*(F.sum(f"v_{c}").alias(c) for c in sums))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    total = total.select(*by, "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c in sums))
    inside = Window.partitionBy("block", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"v_{c}": F.coalesce(F.sum(f"v_{c}").over(inside), F.lit(0)) for c in sums})
    d = d.join(total, [*by, "block"], "left")
    return d.withColumns({c: F.col(f"v_{c}") + F.col(f"o_{c}") for c in sums}).drop(*(f"{p}_{c}" for c in sums for p in "vo"))


def select_pool(candidates: DataFrame, name: str, order: list[Column], cost: str, least: float | None, most: float, size: int, caps: dict[str, int], twins: DataFrame | None = None, quality: str | None = None, blocks: int = 0) -> DataFrame:
    """The candidates with a decision for each, and what was spent before its turn.

    Candidates have their turn by `order`, then name. The walk stops when `least` is spent or `size` are taken (stopped). Otherwise one is left
    out if its value of a column of `caps` is taken that often (capped; null values are not capped), if it is a twin of one taken
    (twin), or if the cost would go over `most` (costly). If less than `least` is spent in the end and the pool isn't full,
    one more that isn't capped and no twin is added, whatever `most` says: the one that brings the sum nearest to `least`, then of the best
    `quality`, then the earliest (nearest). Without `least` the walk goes on to the end and none is added.

    Costs are rounded to six places; a null or negative one is never taken (costless), one of zero may be, but not as the nearest. Names
    must be unique; rows without a name are not returned. twins: a, b, in either order; pairs with unknown names or equal ones don't count.
    An empty table gives an empty one. Other columns are handed through; decision, spent_before, block, pos and names that start with c_, v_, o_, lo_ or hi_ are taken.
    """
    d = candidates.where(F.col(name).isNotNull()).withColumn("c_cost", F.round(F.col(cost).cast("decimal(28,8)"), 6).cast(_MONEY))
    parts = blocks or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, *order, F.col(name)).withColumn("block", F.spark_partition_id())
    d = cut(d)  # the limits of ranges come from a sample: they must not be drawn again
    ranked = cut(d.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy(*order, F.col(name)))))
    lean = ranked.select(F.col(name).alias("c_name"), *_PLACE, "c_cost", *(F.col(k).alias(f"c_{j}") for j, k in enumerate(caps)))
    limits = {f"c_{j}": n for j, n in enumerate(caps.values())}
    top = F.lit(most).cast(_MONEY)
    goal = F.lit(least).cast(_MONEY)
    edges = None
    if twins is not None:
        pairs = twins.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*").where("x <> y").distinct()
        at = lean.select("c_name", *_PLACE)
        edges = pairs.join(at.toDF("x", "bx", "px"), "x").join(at.toDF("y", "by", "py"), "y").where("struct(by, py) < struct(bx, px)")
        edges = cut(edges.select(F.col("x").alias("c_name"), F.col("y").alias("c_twin")))  # of each one the twins that have their turn before it

    def bounds(d: DataFrame, sides: dict[str, Column]) -> DataFrame:
        """By side, over those that it holds: number, cost, number of the same key, any earlier twin."""
        d = _with_before(d, None, {f"{s}_{c}": F.when(on, v).otherwise(F.lit(0)) for s, on in sides.items() for c, v in (("n", F.lit(1)), ("spent", F.col("c_cost")))})
        for key in limits:
            d = _with_before(d, key, {f"{s}_{key}": F.when(on, 1).otherwise(0) for s, on in sides.items()})
        if edges is None:
            return d.withColumns({f"{s}_twin": F.lit(False) for s in sides})
        held = d.select(F.col("c_name").alias("c_twin"), *(on.alias(f"h_{s}") for s, on in sides.items()))
        near = edges.join(held, "c_twin").groupBy("c_name").agg(*(F.bool_or(f"h_{s}").alias(f"{s}_twin") for s in sides))
        return d.join(near, "c_name", "left").withColumns({f"{s}_twin": F.coalesce(f"{s}_twin", F.lit(False)) for s in sides})

    def breaks(s: str) -> dict[str, Column]:
        capped = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{s}_{k}") >= n, F.lit(False)) for k, n in limits.items()], F.lit(False))
        return {"stopped": F.coalesce(F.col(f"{s}_spent") >= goal, F.lit(False)) | (F.col(f"{s}_n") >= size), "capped": capped, "twin": F.col(f"{s}_twin"), "costly": F.col(f"{s}_spent") + F.col("c_cost") > top}

    some = lambda s: reduce(lambda a, b: a | b, breaks(s).values())
    names = lean.columns
    state = lean.where("c_cost >= 0").withColumn("c_in", F.lit(False))
    while True:
        x = bounds(state, {"lo": F.col("c_in"), "hi": F.lit(True)})
        state = cut(x.where(F.col("c_in") | ~some("lo")).select(*names, (F.col("c_in") | ~some("hi")).alias("c_in")))
        if not state.where("NOT c_in").limit(1).count():
            break
    taken = state.select("c_name", "c_in")

    x = bounds(lean.join(taken, "c_name", "left").withColumn("c_in", F.coalesce("c_in", F.lit(False))), {"lo": F.col("c_in")})
    why = reduce(lambda w, b: w.when(b[1], b[0]), breaks("lo").items(), F.when(F.col("c_in"), "taken").when(F.coalesce(F.col("c_cost") < 0, F.lit(True)), "costless"))
    x = cut(x.select(*names, why.alias("decision"), F.col("lo_spent").alias("spent_before")))

    # one more, if the walk ended below its goal
    spare = x.where("decision <> 'taken' AND c_cost > 0")
    inside = x.where("decision = 'taken'")
    for key, n in limits.items():
        full = inside.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n).select(key)
        spare = spare.join(full, key, "left_anti")
    if edges is not None:
        of = inside.select("c_name")
        bad = edges.join(of, "c_name").select(F.col("c_twin").alias("c_name")).union(edges.join(of.toDF("c_twin"), "c_twin").select("c_name"))
        spare = spare.join(bad, "c_name", "left_anti")
    end = inside.agg(F.count("*").alias("n"), F.coalesce(F.sum("c_cost"), F.lit(0)).cast(_MONEY).alias("spent")).where((F.col("spent") < goal) & (F.col("n") < size))
    better = ranked.select(F.col(name).alias("c_name"), (F.col(quality) if quality else F.lit(0)).alias("c_quality"))
    one = spare.join(better, "c_name").join(F.broadcast(end))  # one row
    one = one.groupBy().agg(F.min_by("c_name", F.struct(F.abs(F.col("spent") + F.col("c_cost") - goal), -F.coalesce("c_quality", F.lit(float("-inf"))), *_PLACE)).alias("c_one"))
    x = x.join(F.broadcast(one))  # one row
    x = x.select(F.col("c_name").alias(name), F.when(F.col("c_name") == F.col("c_one"), "nearest").otherwise(F.col("decision")).alias("decision"), "spent_before")
    return ranked.drop(*_PLACE, "c_cost").join(x, name)
