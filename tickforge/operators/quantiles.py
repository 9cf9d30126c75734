"""Exact quantiles of large, uneven groups by refinement of ranges.

A histogram of each group (partial aggregation, at most BINS rows a group) tells the bin that holds a rank; the next histogram is of that
bin alone, between the least and the greatest value that really lie in it, and so on. The first one is on a logarithmic scale, so a value
far outside takes a bin of its own and not all others' room. At the end the few values that are left are counted by value, so
ties cost nothing. No task sorts or holds a group's values. Of few groups the ranges go to the rows: a join by group would deal all
rows of a group to one task. What a round finds is kept, so each round reads the rows once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BINS, ROUNDS = 4096, 3
#: Groups up to which their ranges, two for each wanted quantile, are broadcast.
FEW_GROUPS = 20_000
#: How ranks (from 0) and the weight of the upper one follow from a probability and the number of values.
METHODS = ("linear", "nearest", "discrete")


def _ranks(q: float, method: str, n: Column) -> tuple[Column, Column, Column]:
    """Lower and upper rank, and the upper one's weight: linear between the two, the nearest with ties to even, or the least rank with a share of q up to it."""
    at = F.lit(float(q)) * (n - 1)
    if method == "linear":
        low = F.floor(at)
        return low, F.least(low + 1, n - 1), at - low
    rank = F.bround(at).cast("long") if method == "nearest" else F.greatest(F.ceil(F.round(F.lit(float(q)) * n, 9)) - 1, F.lit(0))
    return rank, rank, F.lit(0.0)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """by, n and a column for each of wanted: name -> (probability, method). Nulls and NaN don't count; a group without values is not there.

    Groups may be null. Values are doubles; infinite ones are ordered as such.
    """
    keys = [f"g{k}" for k in range(len(by))]
    d = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    log = lambda c: F.signum(c) * F.log1p(F.abs(c))
    plain = lambda c: c

    def bin_of(scale):
        share = (scale(F.col("v")) - scale(F.col("lo"))) / (scale(F.col("hi")) - scale(F.col("lo"))) * BINS
        inside = F.when(F.col("hi") > F.col("lo"), F.when(F.isnan(share), F.lit(0)).otherwise(F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(BINS - 1)))).otherwise(0)
        # infinite ends make no scale: they have bins of their own, and the rest is one bin that the next round divides
        return F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), BINS).otherwise(inside).cast("int")

    ends = d.groupBy(*keys).agg(F.count("*").alias("n"), *(f(F.when(F.abs(F.col("v")) < float("inf"), F.col("v"))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))))
    ends = cut(ends)
    few = F.broadcast if ends.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else plain
    first = few(ends.toDF(*(f"e_{c}" for c in ends.columns)))
    x = d.join(first, reduce(lambda a, b: a & b, [d[k].eqNullSafe(first[f"e_{k}"]) for k in keys], F.lit(True)))
    x = x.withColumns({"lo": F.col("e_lo"), "hi": F.col("e_hi")}).withColumn("bin", bin_of(log))
    hist = x.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))

    ranks = []
    for name, (q, method) in wanted.items():
        low, high, _ = _ranks(q, method, F.col("n"))
        ranks += [F.struct(F.lit(name).alias("name"), F.lit(s).alias("side"), r.cast("long").alias("rank")) for s, r in (("low", low), ("high", high))]
    targets = ends.select(*keys, F.explode(F.array(*ranks)).alias("t")).select(*keys, "t.*")

    def chosen(hist, targets, own: list[str]):
        """Of each target the bin that holds its rank, and its rank in there."""
        before = Window.partitionBy(*keys, *own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        h = hist.withColumn("upto", F.sum("c").over(before))
        t = targets.toDF(*(f"t_{c}" for c in targets.columns))
        on = [h[k].eqNullSafe(t[f"t_{k}"]) for k in [*keys, *own]]
        on = [*on, (t.t_rank < h.upto) & (t.t_rank >= h.upto - h.c)]
        out = h.join(t, reduce(lambda a, b: a & b, on))
        return out.select(*(F.col(f"t_{k}").alias(k) for k in [*keys, "name", "side"]), (F.col("t_rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("a").alias("lo"), F.col("b").alias("hi"))

    state = cut(chosen(hist, targets, []))

    def inside(state):
        s = few(state.toDF(*(f"s_{c}" for c in state.columns)))
        on = reduce(lambda a, b: a & b, [d[k].eqNullSafe(s[f"s_{k}"]) for k in keys], F.lit(True)) & d.v.between(s.s_lo, s.s_hi)
        return d.join(s, on).select(*(F.col(f"s_{c}").alias(c) for c in state.columns), "v")

    for _ in range(ROUNDS - 1):
        x = inside(state).withColumn("bin", bin_of(plain))
        state = cut(chosen(x.groupBy(*keys, "name", "side", "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")), state.select(*keys, "name", "side", "rank"), ["name", "side"]))
    left = inside(state).groupBy(*keys, "name", "side", "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "name", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = left.withColumn("upto", upto).where("rank < upto AND rank >= upto - c").groupBy(*keys).agg(*(F.max(F.when((F.col("name") == n) & (F.col("side") == s), F.col("v"))).alias(f"{s}_{k}") for k, n in enumerate(wanted) for s in ("low", "high")))
    f = found.toDF(*(f"f_{c}" for c in found.columns))
    out = ends.join(f, reduce(lambda a, b: a & b, [ends[k].eqNullSafe(f[f"f_{k}"]) for k in keys], F.lit(True))) if keys else ends.where("n > 0").join(F.broadcast(f))
    columns = []
    for k, (name, (q, method)) in enumerate(wanted.items()):
        weight = _ranks(q, method, F.col("n"))[2]
        low, high = F.col(f"f_low_{k}"), F.col(f"f_high_{k}")
        columns.append(F.when((weight == 0) | (low == high), low).otherwise(low * (1 - weight) + high * weight).alias(name))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "n", *columns)
