"""First passages against plain loops, with narrow blocks so that searches climb and go down several levels."""

import random
from datetime import datetime, timedelta

import pytest

from tickforge.operators import passage as P
from tickforge.plans import passages

R = random.Random(12)
T0 = datetime(2024, 5, 6)


@pytest.mark.parametrize("width", [2, 3, 64])
def test_first_equals_loops(spark, monkeypatch, width):
    monkeypatch.setattr(P, "WIDTH", width)
    rows = [(k, i, R.randint(0, 100), R.randint(100, 200)) for k, n in (("a", 50), ("b", 1), ("c", 17), (None, 3)) for i in range(n)]
    rows += [("d", i, None if i % 3 else 50, None if i % 4 else 150) for i in range(12)]
    searches = [(q, R.choice("abcde"), R.randint(0, 55), R.choice([-1, 0, 1, 5, 50]), R.choice([201, 200, 199, 150])) for q in range(150)] + [(999, None, 0, 101, 101)]
    index = P.Passage(spark.createDataFrame(rows, "k string, i long, low int, high int"), ["k"], ["low"], ["high"])
    assert len(index.levels) == {2: 6, 3: 4, 64: 1}[width]
    out = index.first(spark.createDataFrame(searches, "q int, k string, start int, below int, above int"), "start", "x.low <= below OR x.high >= above").collect()
    assert len(out) == len(searches)
    for r in out:
        want = min((i for k, i, low, high in rows if k is not None and k == r.k and i >= r.start and (low is not None and low <= r.below or high is not None and high >= r.above)), default=None)
        assert (r.found.i if r.found else None) == want


def quotes():
    out, mid = [], 100.0
    for k in range(260):
        mid += R.choice([-1, -0.5, 0, 0.5, 1])
        out.append((R.choice("ab"), T0 + timedelta(minutes=11 * k + R.randint(0, 9)), k, mid - 0.25, mid + 0.25))
    return out


def loop_quotes(rows, entry, direction, stop_points, reward, hold):
    own = sorted((r for r in rows if r[0] == entry[0]), key=lambda r: (r[1], r[2]))
    price = entry[4] if direction == 1 else entry[3]
    stop, target = price - direction * stop_points, price + direction * stop_points * reward
    for r in own[own.index(entry) + 1:]:
        side = r[3] if direction == 1 else r[4]
        if r[1].date() != entry[1].date() or r[1] > entry[1] + timedelta(seconds=hold):
            return r[1], side, "time"
        if (side - stop) * direction <= 0:
            return r[1], stop, "stop"
        if (side - target) * direction >= 0:
            return r[1], target, "target"
    return None


@pytest.mark.parametrize("width", [3, 64])
def test_quote_brackets_equal_loops(spark, monkeypatch, width):
    monkeypatch.setattr(P, "WIDTH", width)
    rows = quotes()
    signals = [(*r[:3], R.choice([1, -1])) for r in rows]
    got = P.quote_brackets(spark.createDataFrame(signals, "symbol string, timestamp timestamp_ntz, seq long, direction int"), spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, seq long, bid double, ask double"), 1.0, 1.5, 9000)
    want = {(r[2]): x for r, s in zip(rows, signals) if (x := loop_quotes(rows, r, s[3], 1.0, 1.5, 9000))}
    assert {r.seq: (r.exit_time, r.exit_price, r.reason) for r in got.collect()} == want
    assert {x[2] for x in want.values()} == {"stop", "target", "time"}


def test_every_exit_is_there(spark):
    sf = "/root/testdata/sf0.001"
    seen = {n: {r.reason for r in passages.QUERIES[n](spark, sf).select("reason").distinct().collect()} for n in ("quote_brackets", "minute_brackets", "atr_brackets")}
    assert seen == {"quote_brackets": {"stop", "target", "time"}, "minute_brackets": {"stop", "target", "time", "date"}, "atr_brackets": {"stop", "target", "time"}}
    fills = passages.QUERIES["gap_fills"](spark, sf).select("filled_at").collect()
    assert any(r.filled_at is None for r in fills) and any(r.filled_at for r in fills)
    gates = passages.QUERIES["retest_gates"](spark, sf).collect()
    assert all({getattr(r, c) for r in gates} >= {True, False} for c in ("sweep_low", "sweep_high", "gap_up", "gap_down"))


def test_no_row_is_exploded(spark):
    b = spark.createDataFrame([("a", T0, 1.0, 0.5)], "symbol string, timestamp timestamp_ntz, high double, low double")
    g = spark.createDataFrame([("a", T0, 1, 0.1, 0.2)], "symbol string, timestamp timestamp_ntz, direction int, gap_low double, gap_high double")
    plan = P.gap_fills(g, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
