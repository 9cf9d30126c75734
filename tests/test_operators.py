"""Small literal cases."""

from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.functions import grammar
from tickforge.operators import bars, features, joins, metrics, quality, replay, validation

T0 = dt(2024, 1, 2, 9, 30)


def ticks(spark, rows):
    t = [("A", T0 + timedelta(milliseconds=ms), float(b), float(a), float(bs), float(s), (a + b) / 2, float(a - b), i) for i, (ms, a, b, s, bs) in enumerate(rows)]
    return spark.createDataFrame(t, "symbol string, timestamp timestamp_ntz, bid double, ask double, bid_size double, ask_size double, mid double, spread double, seq long")


def test_ticks_to_minutes(spark):
    t = ticks(spark, [(100, 100.2, 100.0, 1.0, 2.0), (1000, 100.4, 100.1, 3.0, 4.0), (60100, 100.8, 100.5, 5.0, 6.0)])
    out = bars.tick_bars(t).orderBy("timestamp").collect()
    assert [r.tick_count for r in out] == [2, 1]
    assert out[0].open == pytest.approx(100.1) and out[0].close == pytest.approx(100.25) and out[1].close == pytest.approx(100.65)


def test_right_label(spark):
    rows = [("A", T0 + timedelta(minutes=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10 + i, 0.5) for i in range(15)]
    b = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, tick_count int, avg_spread double")
    (r,) = bars.rebucket(b, 15, "right").collect()
    assert (r.timestamp, r.open, r.high, r.low, r.close, r.tick_count) == (dt(2024, 1, 2, 9, 45), 100.0, 115.0, 99.0, 114.5, sum(10 + i for i in range(15)))


def test_active_contract_prefers_rows_then_size_then_name(spark):
    rows = [(1, 5, 1.0), (1, 5, 1.0), (1, 7, 9.0), (2, 7, 2.0), (2, 5, 2.0)]
    got = {r.day: r.contract for r in bars.active_contract(spark.createDataFrame(rows, "day int, contract int, size double")).collect()}
    assert got == {1: 5, 2: 5}


def test_uncross(spark):
    (r,) = bars.uncross(ticks(spark, [(0, 99.0, 100.0, 1.0, 2.0)])).collect()
    assert (r.bid, r.ask, r.bid_size, r.ask_size) == (99.0, 100.0, 1.0, 2.0)


def test_quality_counts(spark):
    q = quality.tick_quality(ticks(spark, [(0, 100.2, 100.0, 1, 1), (0, 100.2, 100.0, 1, 1), (5, 101.5, 100.5, 1, 1)]), 0.5, 0.2).collect()[0]
    assert (q.n_rows, q.duplicates, q.wide, q.jumps) == (3, 1, 1, 1)


def test_asof_both_ways_and_ties(spark):
    q = ticks(spark, [(0, 100.25, 100.0, 1, 1), (30000, 100.0, 99.75, 1, 1), (30000, 100.5, 99.5, 1, 1)])
    p = spark.createDataFrame([(1, "A", T0 + timedelta(seconds=10)), (2, "A", T0 + timedelta(seconds=30)), (3, "A", T0 + timedelta(seconds=40)), (4, "B", T0)], "trade_id int, symbol string, at timestamp_ntz")
    fwd = {r.trade_id: r.bid for r in joins.asof(p, q, ["bid"]).collect()}
    back = {r.trade_id: r.bid for r in joins.asof(p, q, ["bid"], forward=False).collect()}
    assert fwd == {1: 99.75, 2: 99.75, 3: None, 4: None}
    assert back == {1: 100.0, 2: 99.5, 3: 99.5, 4: None}


def test_grammar_truth_table(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0), (3, 0.0, 1.0)], "i int, a double, b double")
    ids = lambda n: [r.i for r in d.where(grammar.compile_node(n, d.columns)).orderBy("i").collect()]
    leaf = {"feature": "a", "op": ">", "value": "b"}
    assert ids(leaf) == [1]
    assert ids({"not": leaf}) == [2, 3]
    assert ids({}) == [1, 2, 3]
    assert ids({"any": [leaf, {"feature": "a", "op": "==", "value": "0"}]}) == [1, 3]
    with pytest.raises(ValueError):
        grammar.compile_node({"feature": "a", "op": "~", "value": 1}, d.columns)


def test_metrics(spark):
    rows = [("g", T0 + timedelta(minutes=i), i, p) for i, p in enumerate([100.0, -50.0, -25.0, 75.0, -10.0, -5.0])]
    m = metrics.trade_metrics(spark.createDataFrame(rows, "grp string, ts timestamp_ntz, seq long, pnl double"), ["grp"]).collect()[0]
    assert (m.wins, m.losses, m.avg_win, m.avg_loss, m.max_losing_run) == (2, 4, 87.5, -22.5, 2)
    assert m.payoff == pytest.approx(87.5 / 22.5) and m.max_drawdown == pytest.approx(75.0)


def test_stop_wins_when_both_are_hit(spark):
    b = spark.createDataFrame([("A", 0, 100.0, 100.0, 100.0), ("A", 1, 104.0, 95.0, 100.0)], "symbol string, i int, high double, low double, close double")
    s = spark.createDataFrame([("x", "A", 0, 1, 100.0, 96.0, 103.0)], "signal_id string, symbol string, i int, direction int, entry double, stop double, target double")
    (r,) = replay.exit_sim(s, b, 5).collect()
    assert (r.exit_i, r.exit_price, r.reason) == (1, 96.0, "stop")


def test_slots_and_cooldown(spark):
    s = spark.createDataFrame([("a", "A", 1, 2, "r"), ("b", "A", 3, 4, "r")], "signal_id string, symbol string, i int, exit_i int, regime string")
    assert replay.select_signals(s, 1, 0, "regime").count() == 2
    assert replay.select_signals(s, 1, 5, "regime").count() == 1


def test_pivot_is_confirmed_later(spark):
    highs = [100, 101, 110, 109, 104, 112, 113]
    rows = [("A", T0 + timedelta(minutes=i), float(h), float(h) - 5, float(h) - 1) for i, h in enumerate(highs)]
    d = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, high double, low double, close double")
    (r,) = replay.pivots(d).where("is_high").collect()
    assert (r.timestamp, r.confirmed_at) == (T0 + timedelta(minutes=2), T0 + timedelta(minutes=4))


def test_folds_have_embargo_and_holdout(spark):
    f = validation.rolling_folds(spark, dt(2020, 1, 1).date(), dt(2021, 12, 31).date(), 60, 20, 20, 30, 5, 60).toPandas()
    one = f[f.fold == 0].set_index("split")
    assert (one.from_day["validation"] - one.to_day["train"]).days == 6 and (one.from_day["test"] - one.to_day["validation"]).days == 6
    assert pd.to_datetime(f.to_day).max() <= pd.Timestamp(2021, 11, 1)


def test_full_window_is_null_until_full(spark):
    rows = [("A", T0 + timedelta(minutes=i), 1.0, 2.0 + i, 0.5, 1.5, 10, 0.1) for i in range(20)]
    d = features.full_features(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, tick_count int, avg_spread double")).orderBy("timestamp").collect()
    assert d[12].atr_14 is None and d[13].atr_14 is not None and d[18].volume_ma_20 is None and d[19].volume_ma_20 == 10.0


def test_results_do_not_depend_on_partitions(spark):
    t = ticks(spark, [(i * 7000, 100 + (i * 37 % 11) / 10 + 0.2, 100 + (i * 37 % 11) / 10, 1 + i % 3, 2) for i in range(200)])
    a, b = (sorted(map(tuple, bars.tick_bars(t.repartition(n)).collect())) for n in (1, 8))
    assert a == b


def test_merge_and_upsert(spark):
    d = spark.createDataFrame([("A", 1, 3), ("A", 2, 5), ("A", 7, 8)], "symbol string, a int, b int")
    assert sorted((r.start, r.end) for r in metrics.merge_intervals(d, ["symbol"], "a", "b").collect()) == [(1, 5), (7, 8)]
    o, n = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), spark.createDataFrame([(2, 9)], "k int, v int")
    assert sorted(map(tuple, joins.upsert(o, n, ["k"]).collect())) == [(1, 1), (2, 9)]


def test_interval_join_holds_both_ends(spark):
    p = spark.createDataFrame([(i, T0 + timedelta(minutes=i)) for i in range(5)], "i int, ts timestamp_ntz")
    s = spark.createDataFrame([(T0 + timedelta(minutes=1), T0 + timedelta(minutes=3))], "a timestamp_ntz, b timestamp_ntz")
    assert sorted(r.i for r in joins.interval_join(p, s, "ts", "a", "b", 60).select("i").collect()) == [1, 2, 3]
    assert joins.interval_join(p.where(F.lit(False)), s, "ts", "a", "b").count() == 0


def test_first_row_that_fits_price_and_size():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 64, 1000):
        price, size = r.integers(0, 40, n).astype(float), r.integers(0, 30, n).astype(float)
        start, limit, least = r.integers(0, n + 2, 300), r.integers(-1, 6, 300).astype(float), r.integers(0, 32, 300).astype(float)
        want = [next((j for j in range(s, n) if price[j] <= a and size[j] >= b), -1) for s, a, b in zip(start.tolist(), limit, least)]
        assert joins.first_fits(price, size, start, limit, least).tolist() == want


def test_limit_orders_wait_through_many_quotes(spark):
    """Quotes and orders at one time make no row for each pair, and orders fill in the next bin of time."""
    n = 20_000
    q = spark.range(n).selectExpr("'A' AS symbol", "timestamp_micros(id * 1000)::timestamp_ntz AS timestamp", "99D AS bid", f"if(id = {n - 1}, 90D, 100D) AS ask", "1D AS bid_size", "if(id % 2 = 1, 2D, 1D) AS ask_size", "id AS seq")
    o = spark.range(n).selectExpr("id AS trade_id", "'A' AS symbol", "timestamp_micros(0)::timestamp_ntz AS at", "'long' AS side", "95D AS limit", "2 AS contracts")
    rows = joins.limit_fills(o, q, 60).groupBy("fill_time", "fill_price").count().collect()
    assert [(r["count"], r.fill_price) for r in rows] == [(n, 95.0)]
    late = spark.createDataFrame([(1, "A", dt(2024, 1, 1, 0, 59, 30), "short", 99.0, 1), (2, "A", dt(2024, 1, 1, 0, 58, 0), "short", 99.0, 1), (3, "A", dt(2024, 1, 1, 0, 59, 30), "short", 99.5, 1)], "trade_id int, symbol string, at timestamp_ntz, side string, limit double, contracts int")
    one = spark.createDataFrame([("A", dt(2024, 1, 1, 1, 0, 30), 99.25, 100.0, 1.0, 1.0, 0)], "symbol string, timestamp timestamp_ntz, bid double, ask double, bid_size double, ask_size double, seq long")
    got = {r.trade_id: r.fill_time for r in joins.limit_fills(late, one, 60).collect()}
    assert got == {1: dt(2024, 1, 1, 1, 0, 30), 2: None, 3: None}


def test_links_are_counted_in_parts_and_tiles(spark, monkeypatch):
    r = np.random.default_rng(5)
    sets = [frozenset(r.choice(12, r.integers(1, 8)).tolist()) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "i long, t long")
    want = [(i, min(j for j, z in enumerate(sets) if z == s), sum(len(s & z) / len(s | z) >= 0.5 for z in sets) - 1) for i, s in enumerate(sets)]
    for tokens, tile, columns in ((joins.PART_TOKENS, joins.TILE, joins.COLUMNS), (60, 3, 5)):
        for name, v in (("PART_TOKENS", tokens), ("TILE", tile), ("COLUMNS", columns)):
            monkeypatch.setattr(joins, name, v)
        assert sorted(map(tuple, joins.jaccard_links(rows, "i", "t", 0.5).collect())) == want


def rows_made(plan):
    """Most rows that a step of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(rows_made, below)])


def test_event_context_equals_pairs_and_makes_none(spark):
    """Points on and beside all edges, over midnight, without a symbol or time; many points in many events make no row for a pair."""
    r = np.random.default_rng(4)
    minute, start = timedelta(minutes=1), dt(2024, 1, 2, 22, 0)
    events = []
    for k in range(60):
        at = start + int(r.integers(0, 300)) * minute
        events.append((k, at, int(r.integers(0, 3)), ["A", "B", "*"][k % 3], at - 30 * minute, at + 10 * minute, at + 55 * minute))
    e = spark.createDataFrame(events, "event_id long, event_time timestamp_ntz, importance int, symbol string, pre_from timestamp_ntz, release_to timestamp_ntz, post_to timestamp_ntz")
    times = [t + d * timedelta(microseconds=1) for x in events[:20] for t in (x[1], x[4], x[5], x[6]) for d in (-1, 0, 1)]
    times += [start + timedelta(seconds=int(s)) for s in r.integers(-9000, 30000, 6000)]
    points = [(["A", "B", "C", "*", None][k % 5], t, k) for k, t in enumerate(times)] + [("A", None, len(times))]
    out = joins.event_context(spark.createDataFrame(points, "symbol string, timestamp timestamp_ntz, point_id long"), e)
    got = {x.point_id: tuple(x)[3:] for x in out.collect()}
    assert out.columns[:3] == ["point_id", "symbol", "timestamp"] and len(got) == len(points)
    pairs = 0
    for symbol, t, k in points:
        hit = [x for x in events if t and (x[3] == "*" or x[3] == symbol) and x[4] <= t <= x[6]]
        pairs += len(hit)
        top = max(hit, key=lambda x: (x[2], -x[0]), default=None)
        state = "normal" if not top else "pre_event" if t < top[1] else "release_window" if t <= top[5] else "post_event"
        to, since = ([abs((x[1] - t) / minute) for x in hit if (x[1] >= t if later else x[1] <= t)] for later in (True, False))
        want = (state, ",".join(str(x[0]) for x in hit), top and top[2], min(to, default=None), min(since, default=None))
        assert got[k][:3] == want[:3] and got[k][3:] == pytest.approx(want[3:]), (symbol, t)
    made = rows_made(out._jdf.queryExecution().executedPlan())
    assert 0 < made < 2 * len(points) < pairs, (made, pairs)
