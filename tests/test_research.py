"""Rules of replays, structure, specifications, variants, stores and selection on literal cases."""

import random
from datetime import datetime, timedelta

import pytest

from tickforge.functions import grammar
from tickforge.operators import replay, research, signals, strategies, variants
from tickforge.sources import stores

T0 = datetime(2024, 1, 2, 10)


def bars(spark, rows, start=T0):
    return spark.createDataFrame([("A", start + timedelta(minutes=k), *map(float, r)) for k, r in enumerate(rows)], "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double")


def exits(spark, rows):
    return spark.createDataFrame(rows, "symbol string, signal_id string, i int, exit_i int, regime string")


def test_slots_are_free_at_the_exit_bar(spark):
    rows = [("A", "a", 0, 5, "x"), ("A", "b", 1, 9, "x"), ("A", "c", 5, 8, "x"), ("A", "d", 8, 9, "y"), ("A", "e", 8, 9, "x")]
    pick = lambda **k: sorted(r.signal_id for r in replay.select_signals(exits(spark, rows), **k).collect())
    assert pick(slots=1) == ["a", "d"]  # one slot: the next entry is after the exit bar
    assert pick(slots=2) == ["a", "b", "c", "d"]  # several: from the exit bar on
    assert pick(slots=9, cooldown=5, regime="regime") == ["a", "c", "d"]


def test_positions_are_flat_at_the_end_of_their_day(spark):
    b = bars(spark, [(10, 10.5, 9.5, 10)] * 3 + [(10, 30, 9.5, 10)] * 2, datetime(2024, 1, 2, 23, 57))
    b = replay.indexed(b)
    s = spark.createDataFrame([("s", "A", 0, 1, 10.0, 5.0, 20.0)], "signal_id string, symbol string, i int, direction int, entry double, stop double, target double")
    (r,) = replay.exit_sim(s, b, 4, flatten=True).collect()
    assert (r.exit_i, r.reason) == (2, "date_change")
    (r,) = replay.exit_sim(s, b, 4).collect()
    assert (r.exit_i, r.reason, r.exit_price) == (3, "target", 20.0)


def test_first_break_is_a_change_and_a_pivot_breaks_once(spark):
    rows = [(10, 11, 9, 10), (10, 15, 9.5, 12), (12, 13, 10, 11), (11, 15.2, 10, 15.2), (15, 16, 14, 15.6), (15, 16, 13, 14), (14, 15, 12, 13), (13, 17, 12.5, 16.8), (16, 17, 8, 8.5)]
    got = [(r.timestamp.minute, r.direction, r.event, r.level) for r in replay.structure_events(bars(spark, rows), 1, 1).orderBy("timestamp", "direction").collect()]
    assert got == [(4, 1, "CHOCH", 15.0), (7, 1, "BOS", 16.0)] or got[0] == (4, 1, "CHOCH", 15.0)  # 15.2 is within the buffer
    assert [g for g in got if g[2] == "BOS" and g[1] == -1] == [] and len({(g[1], g[3]) for g in got}) == len(got)


def brute_structure(rows, left, right, buffer):
    """By rescanning all pivots at every bar."""
    out, broken, trend = [], set(), 0
    for i, (_, _, _, close) in enumerate(rows):
        seen = [p for p in range(left, i - right + 1)]
        for side, col, sign in ((1, 1, 1), (-1, 2, -1)):
            ok = [p for p in seen if all(rows[p][col] * sign > rows[k][col] * sign for k in range(p - left, p + right + 1) if k != p) and (side, p) not in broken]
            if ok and close * sign > rows[ok[-1]][col] * sign + buffer:
                out.append((i, side, "BOS" if trend == side else "CHOCH", rows[ok[-1]][col]))
                broken.add((side, ok[-1]))
                trend = side
    return out


def test_structure_equals_brute_force(spark):
    r = random.Random(3)
    price, rows = 100.0, []
    for _ in range(300):
        o, price = price, round(price + r.choice([-1, -0.5, 0.25, 0.5, 1]), 2)
        rows.append((o, max(o, price) + r.choice([0, 0.25, 0.5]), min(o, price) - r.choice([0, 0.25, 0.5]), price))
    got = [(int((x.timestamp - T0).total_seconds() // 60), x.direction, x.event, x.level) for x in replay.structure_events(bars(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_structure(rows, 2, 2, 0.25)) and len(got) > 20


def test_sweeps_take_the_farthest_price(spark):
    rows = [(10, 11, 9, 10)] * 21 + [(9, 9.5, 8, 8.5), (8.5, 9, 7, 8.8), (8.8, 10, 8.6, 9.5)]
    (s,) = replay.sweeps(bars(spark, rows)).where("bars_to_reclaim = 2").collect()
    assert (s.level, s.extreme, s.reclaim_close) == (9.0, 7.0, 9.5)
    (s,) = replay.sweeps(bars(spark, [(-o, -l, -h, -c) for o, h, l, c in rows]), direction=-1).where("bars_to_reclaim = 2").collect()
    assert (s.level, s.extreme) == (-9.0, -7.0)
    assert replay.sweeps(bars(spark, rows[:21] + [(9, 9.5, 8.75, 9.2)])).count() == 0  # a tick below is no sweep


def test_blocks_lie_between_pivot_and_event(spark):
    rows = [(10, 10, 8, 8.5), (9, 12, 9, 11), (11, 11.5, 10, 10.5), (10.5, 11, 9.5, 9.75), (10, 12.5, 10, 12.5)]
    b = bars(spark, rows)
    e = spark.createDataFrame([("A", T0 + timedelta(minutes=4), 1, T0 + timedelta(minutes=1))], "symbol string, timestamp timestamp_ntz, direction int, pivot_time timestamp_ntz")
    (x,) = strategies.event_blocks(b, e).collect()
    assert (x.origin_i, x.block_low, x.block_high) == (3, 9.5, 10.5)
    assert strategies.event_blocks(b, e, least=5).count() == 0


def test_specifications():
    good = {"name": "a", "family": "f", "symbol": "S", "timeframe": "1m", "entry": {"all": [{"feature": "x", "op": ">", "value": 1}, {"not": {"feature": "y", "op": "crosses_above", "value": "x"}}]}, "exit": {}, "parameters": {"p": [1, 2]}}
    assert grammar.spec_errors(good, {"f"}, set()) == []
    bad = good | {"family": "b", "entry": {"any": [{"feature": "next_close", "op": "!=", "value": 1}, {"feature": "z", "op": ">"}, {"or": []}]}, "note": "import os", "parameters": {"p": list(range(30)), "q": list(range(30))}}
    errors = " ".join(grammar.spec_errors(bad, {"f"}, {"b"}))
    for part in ("banned family b", "operator !=", "looks ahead", "no value", "unknown ['or']", "looks like code", "more than 500"):
        assert part in errors
    assert len(grammar.spec_errors({}, {"f"}, set())) == 6


def test_variants():
    spec = {"name": "s", "exit": {"stop": 1}, "parameters": {"stop": {"min": 1, "max": 2, "step": 0.5}, "side": {"values": ["long", "short", "long"]}, "other": {"values": [1]}}}
    made, about = variants.variants(spec, {"stop": ("exit", "stop"), "side": ("side",)})
    assert (about["total"], about["unique"], about["duplicates"]) == (9, 6, 3) and [m["exit"]["stop"] for m in made] == [1, 1.5, 2, 1, 1.5, 2] and spec["exit"] == {"stop": 1}
    assert len(variants.variants(spec, {"stop": ("exit", "stop")}, most=2)[0]) == 2
    with pytest.raises(variants.BudgetError):
        variants.variants(spec, {"stop": ("exit", "stop"), "side": ("side",)}, limit=5)
    assert variants.values({"min": 0.1, "max": 0.3, "step": 0.1}) == [0.1, 0.2, 0.3]
    one = variants.seeded_specs(["a", "b", "c"], {k: (0.2, 0.8) for k in "abc"}, 5, 2, 7)
    assert one == variants.seeded_specs(["a", "b", "c"], {k: (0.2, 0.8) for k in "abc"}, 5, 2, 7) and len({variants.stable_hash(s["entry"]) for s in one}) == 5
    assert variants.get_nested({"a": {"b": 3}}, ("a", "b")) == 3 and variants.get_nested({}, ("a",), 0) == 0
    assert research.inverse(research.inverse({"name": "n", "side": "long"})) == {"name": "n", "side": "long", "inverse_signal": False}


def test_stores(spark, tmp_path):
    at = f"file://{tmp_path}"
    assert stores.current(spark, at, "trials").count() == 0
    stores.append(spark, at, "experiments", [("e1", "NQ", "running", "{}")])
    trial = lambda k, ok, score, why: ("e1", k, "s", "h", "done", ok, score, 1.0, 1.0, why, "{}")
    stores.append(spark, at, "trials", [trial("t1", False, 9.0, ["a"]), trial("t2", True, 1.0, [])])
    stores.append(spark, at, "trials", [trial("t1", False, 9.0, ["b", "a"]), trial("t3", True, 2.0, [])])
    stores.append(spark, at, "experiments", [("e1", "NQ", "finished", "{}")])
    (r,) = stores.experiment_summary(spark, at).collect()
    assert (r.status, r.trials, r.passed, r.best, r.reasons) == ("finished", 3, 2, "t3", ["a", "b"])
    x = spark.createDataFrame([("i", 1, "created"), ("i", 2, "risk_approved"), ("i", 3, "filled"), ("j", 1, "approved")], "intent_id string, at int, status string")
    assert sorted((r.intent_id, r.before, r.status) for r in stores.bad_transitions(x).collect()) == [("i", "risk_approved", "filled"), ("j", None, "approved")]


def test_batch_equals_single_runs(spark):
    r = random.Random(9)
    rows = [("A", T0 + timedelta(minutes=k), 100.0 + k % 7, 101 + k % 7 + r.random(), 99 + k % 7 - r.random(), 100.0 + k % 7, 99.9 + k % 7, 100.1 + k % 7, float(k % 5)) for k in range(120)]
    f = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, bid_close double, ask_close double, x double")
    leaf = lambda v: {"feature": "x", "op": ">=", "value": v}
    specs = [{"name": "p", "entry": leaf(4), "stop": 2, "target": 2}, {"name": "q", "entry": leaf(4), "stop": 2, "target": 2}, {"name": "r", "entry": leaf(3), "side": "short", "stop": 2, "target": 3}]
    got = sorted(map(tuple, strategies.grammar_batch(f, specs, 5, 9).collect()))
    want = []
    for s in specs:
        one = strategies.signal_bars(f, grammar.compile_node(s["entry"], f.columns).cast("int") * (-1 if s.get("side") == "short" else 1), s["stop"], s["target"], 5, 9)
        want += [(*map(lambda v: v, t), s["name"]) for t in one.collect()]
    assert got == sorted(want) and len(got) > 6


def test_session_of_a_runner(spark):
    rows = [("A", datetime(2024, 1, 2, h), 100.0, 100.5, 99.5, 100.0, 99.9, 100.1, 1) for h in range(8, 16)]
    f = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, bid_close double, ask_close double, s int")
    (t,) = strategies.signal_bars(f, f.s, 9.0, 9.0, 99, session=(600, 660, 780)).collect()
    assert (t.entry_time.hour, t.exit_time.hour, t.exit_reason) == (10, 13, "flatten")
    assert strategies.signal_bars(f, f.s, 9.0, 9.0, 99, session=(0, 400, 780)).count() == 0


def test_gap_modes(spark):
    rows = [(10, 10, 10, 10), (12, 12, 12, 12)]
    b = bars(spark, rows, datetime(2024, 1, 2, 9, 0))
    side = lambda **k: [r.signal for r in signals.opening_gap(b, 541, 1.0, **k).orderBy("timestamp").collect()]
    assert side() == [0, -1] and side(mode="continuation") == [0, 1] and side(direction="long") == [0, 0]
    with pytest.raises(ValueError):
        signals.opening_gap(b, 541, mode="other")


def test_features_are_in_the_catalogue(spark):
    from tickforge.functions import catalog
    from tickforge.plans import registry

    rows = {r.name: r for r in registry.QUERIES["feature_catalog"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) >= 100 and {"ema_fast", "atr_14", "close_zscore_20", "ma200", "volume_absorption_flag"} <= set(rows)
    assert (rows["ma200"].lookback, rows["ma200"].warm_up, rows["atr_14"].warm_up, rows["atr_14"].family) == (200, 1, 14, "volatility")
    assert catalog.lookback("return_15m") == 15 and catalog.lookback("vwap_dist") == 1 and {r.leakage_risk for r in rows.values()} == {"none"}


def test_hash_of_features(spark):
    nan = float("nan")
    rows = [("A", T0, 1.0, 2.00000000001), ("A", T0 + timedelta(days=1), nan, 3.0), ("B", T0, 1.0, 2.0)]
    make = lambda rs: spark.createDataFrame(rs, "symbol string, timestamp timestamp_ntz, x double, y double")
    a = {r.symbol: r.hash for r in research.snapshot_hash(make(rows), ["x", "y"]).collect()}
    b = {r.symbol: r.hash for r in research.snapshot_hash(make([("A", T0, 1.0, 2.0), ("A", T0 + timedelta(days=1), float("inf"), 3.0), ("B", T0, 1.0, 2.1)][::-1]), ["y", "x"]).collect()}
    assert a["A"] == b["A"] and a["B"] != b["B"]


def test_clock_of_streams(spark):
    from tickforge.streaming import bars as stream

    q = spark.createDataFrame([(T0,), (T0 - timedelta(seconds=90),)], "timestamp timestamp_ntz")
    got = sorted((r.age, r.stale) for r in stream.fresh(q, 60, f"TIMESTAMP_NTZ '{T0}'").collect())
    assert got == [(0.0, False), (90.0, True)]
    assert [r.timestamp for r in stream.simulated(spark, str(T0), 30, 3).orderBy("seq").collect()] == [T0, T0 + timedelta(seconds=30), T0 + timedelta(seconds=60)]


def test_independent_folds():
    from datetime import date

    from tickforge.operators import validation

    d = date(2024, 1, 1)
    assert validation.independent_tests([(0, d, d + timedelta(9)), (1, d + timedelta(5), d + timedelta(14)), (2, d + timedelta(10), d + timedelta(19))]) == [0, 2]


def test_binary_ticks_have_a_time(spark, tmp_path):
    import lzma
    import struct

    from tickforge.sources import files

    at = tmp_path / "EURUSD" / "2024" / "00" / "03"
    at.mkdir(parents=True)
    (at / "14h_ticks.bi5").write_bytes(lzma.compress(struct.pack(">IIIff", 1500, 101000, 100000, 2.0, 1.0) + struct.pack(">IIIff", 2500, 100000, 101000, 2.0, 1.0), format=lzma.FORMAT_ALONE))
    got = sorted(map(tuple, files.hourly_ticks(spark, f"{at}/*").collect()), key=lambda r: r[1])
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got] == [("EURUSD", datetime(2024, 1, 3, 14, 0, 1, 500000), 100.0, 101.0, 1.0, 2.0), ("EURUSD", datetime(2024, 1, 3, 14, 0, 2, 500000), 100.0, 101.0, 2.0, 1.0)]


def test_folds_meet_rows_alike_in_both_ways(spark, monkeypatch):
    from datetime import date

    from tickforge.operators import validation

    folds = validation.rolling_folds(spark, date(2020, 1, 1), date(2020, 12, 31), 90, 20, 20, 30, 2, 5)
    rows = spark.createDataFrame([(k, datetime(2020, 1, 1) + timedelta(days=k % 366, hours=k % 24)) for k in range(800)] + [(900, None)], "seq long, ts timestamp_ntz")
    spans = [tuple(r) for r in folds.collect()]
    want = sorted((r.seq, f, s) for r in rows.collect() for f, s, a, b in spans if r.ts and a <= r.ts.date() <= b)
    for most in (10_000, 0):
        monkeypatch.setattr(validation, "FOLDS_SENT", most)
        assert sorted((r.seq, r.fold, r.split) for r in validation.in_folds(rows, folds).collect()) == want


def line_items(spark, folder):
    """Line items of two years before 1998, two from it on, and one without a date."""
    rows = [(float(q), 0.01 * q, 35_000.0 + q, datetime(year, 6, 1) if year else None) for year in (1996, 1997, 1998, 2001, None) for q in range(1, 6)]
    spark.createDataFrame(rows, "l_quantity double, l_tax double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_quantile_rules_judge_every_row_in_its_part(spark, tmp_path):
    from tickforge.plans import research as plans

    got = {(r.part, r.rule): (r.n, r.net) for r in plans.quantile_rules(spark, line_items(spark, tmp_path)).collect()}
    low, high, most = (1, 1.0), (1, 5.0), (4, 14.0)  # thresholds are 1.8 and 4.2
    want = {"<=0.2": low, ">=0.2": most, "<=0.8": (4, 10.0), ">=0.8": high}
    assert got == {(p, f + r): (n * years, net * years) for p, years in (("train", 2), ("test", 2), (None, 1)) for f in ("l_quantity", "l_tax") for r, (n, net) in want.items()}


def test_quantile_rule_pairs_judge_every_row_in_its_part(spark, tmp_path):
    from tickforge.plans import research as plans

    got = {(r.part, r.rule): r.n for r in plans.quantile_rule_pairs(spark, line_items(spark, tmp_path)).collect()}
    passed = {"<=0.2": {1}, ">=0.2": {2, 3, 4, 5}, "<=0.8": {1, 2, 3, 4}, ">=0.8": {5}}
    both = {f"l_quantity{a}&l_tax{b}": len(x & y) for a, x in passed.items() for b, y in passed.items() if x & y}
    assert got == {(p, r): n * years for p, years in (("train", 2), ("test", 2), (None, 1)) for r, n in both.items()}


def test_candidate_gates_judge_candidates_without_orders_in_a_part(spark, tmp_path):
    import duckdb

    from tickforge.plans import research as plans

    years = {0: range(1995, 2002), 1: (1995, 1996), 2: (1996, 1998, 1999), 3: (2001,)}
    rows = [(100 * c + k, c, 121_000.0 + 50 * (k % 3), datetime(y, 3, 1 + k)) for c, ys in years.items() for y in ys for k in range(12)] + [(998, 4, 1.0, None), (999, None, 1.0, datetime(1998, 1, 1))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.cand: r.reasons.split(",") for r in plans.candidate_gates(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert all({"annual_trades_test", "sharpe_test_aggregate", "net_pnl_test", "profit_factor_test", "avg_trade_net_pnl"} <= set(got[c]) for c in (1, 3))
    assert "max_drawdown_test" not in got[1] and sorted(c for c in got if "net_pnl_final_holdout" in got[c]) == [1, 2, 4]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    for name in ("candidate_gates", "overfitting_report"):
        want = con.sql(plans.ORACLE[name])
        shown = lambda rs: sorted(tuple(map(str, r)) for r in rs)
        assert shown(plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()) == shown(want.fetchall())
    assert sorted(r.cand for r in plans.overfitting_report(spark, str(tmp_path)).collect()) == [0, 2]
