"""Pools against the walk down the ranking, one candidate after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators.pools import select_pool

SCHEMA = "n long, cost double, kind int, family string, rate double, decision_note string"


def walk(rows, least, most, size, caps, twins):
    pool, spent, out = [], 0, {}
    near = {(a, b) for a, b in twins} | {(b, a) for a, b in twins}
    ranked = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[4], r[0]))
    capped = lambda r: any(r[k] is not None and sum(p[k] == r[k] for p in pool) >= n for k, n in caps.items())
    twin = lambda r: any((r[0], p[0]) in near for p in pool)
    micros = lambda r: round(r[1] * 10**6)
    for r in ranked:
        if r[1] is None or r[1] < 0:
            why = "costless"
        elif spent >= least * 10**6 or len(pool) >= size:
            why = "stopped"
        elif capped(r):
            why = "capped"
        elif twin(r):
            why = "twin"
        else:
            why = "costly" if spent + micros(r) > most * 10**6 else "taken"
        out[r[0]] = (why, spent / 10**6)
        if why == "taken":
            pool.append(r)
            spent += micros(r)
    if spent < least * 10**6 and len(pool) < size:
        held = {p[0] for p in pool}
        rest = [(abs(spent + micros(r) - least * 10**6), -r[4], k, r[0]) for k, r in enumerate(ranked) if r[0] not in held and r[1] and r[1] > 0 and not capped(r) and not twin(r)]
        if rest:
            one = min(rest)[-1]
            out[one] = ("nearest", out[one][1])
    return out


def pool(spark, rows, least, most, size, caps, twins):
    d = spark.createDataFrame(rows, SCHEMA)
    t = spark.createDataFrame(twins, "a long, b long") if twins is not None else None
    names = SCHEMA.replace(",", "").split()[::2]
    got = select_pool(d, "n", [F.desc("rate")], "cost", least, most, size, {names[k]: v for k, v in caps.items()}, t, "rate", 3)
    assert got.columns[:1] == ["n"] and "decision_note" in got.columns
    return {r["n"]: (r["decision"], float(r["spent_before"])) for r in got.collect()}


@pytest.mark.parametrize("seed,least,most,size", [(1, 9, 10, 30), (2, 1e4, 12.5, 30), (3, 1e4, 1e4, 1000)])
def test_as_the_walk(spark, seed, least, most, size):
    g = random.Random(seed)
    # a kind with a third of all rows, ties of rate, costs of zero, below zero and none
    rows = [(k, g.choice([0.0, None, -1.0] + [g.randint(1, 200) / 100] * 9), 0 if g.random() < 0.35 else g.randint(1, 6), g.choice([None, *"abcdef"]), g.randint(0, 9) / 10, "x") for k in range(120)]
    twins = [(g.randrange(125), g.randrange(125)) for _ in range(60)]
    caps = {2: 5, 3: 6}
    assert pool(spark, rows, least, most, size, caps, twins) == walk(rows, least, most, size, caps, twins)


def test_no_candidates_no_twins_and_no_names(spark):
    assert pool(spark, [], 1, 2, 3, {2: 1}, []) == {}
    rows = [(None, 1.0, 1, "a", 0.9, None), (1, 1.0, None, None, 0.5, None), (2, None, None, None, 0.4, None), (3, 1.0, None, None, 0.4, None)]
    assert pool(spark, rows, 9, 9, 9, {2: 1}, None) == {1: ("taken", 0.0), 2: ("costless", 1.0), 3: ("taken", 1.0)}


def test_without_a_goal_the_budget_is_filled(spark):
    rows = [(k, c, None, f, 1 - k / 10, None) for k, c, f in [(1, 3.0, "a"), (2, 3.0, "a"), (3, 9.0, "b"), (4, 2.0, "b")]]
    got = pool(spark, rows, None, 8, 9, {3: 1}, None)
    assert [n for n, (why, _) in sorted(got.items()) if why == "taken"] == [1, 4] and "nearest" not in {why for why, _ in got.values()}
