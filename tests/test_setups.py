"""The machine of eight states on scripted bars."""

from datetime import datetime, timedelta

from tickforge.operators.setups import Setup, setups

FAST = Setup(minutes=1, coarse_swing=(1, 1), swing=(1, 1), break_buffer=0, least_range=4, block=(1, 80), micro_block=(1, 80), clearance=0, sweep_buffer=0, stop_buffer=1, stop=(1, 80), target_r=2.0, ttl=2, rest_after_cancel=1, rest_after_exit=1)
BARS = [(101, 102, 100.5, 101), (100.5, 101, 100, 100.25), (103, 105, 101, 104), (104, 104, 99, 103), (103, 106, 102, 106), (106, 108, 106, 107), (107, 108, 105, 106), (106, 109, 106, 108), (108, 108, 103.5, 105.5), (105.5, 109, 105, 107), (107, 107, 104.5, 105), (105, 110, 105, 110)]
MIRROR = [(-o, -l, -h, -c) for o, h, l, c in BARS]


def steps(spark, *series):
    start = datetime(2024, 1, 1, 9, 30)
    rows = [(s, start + timedelta(minutes=k), *map(float, b), 0.25) for s, bars in series for k, b in enumerate(bars)]
    out = setups(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, avg_spread double"), FAST).collect()
    return {s: sorted((r for r in out if r.symbol == s), key=lambda r: r.timestamp) for s, _ in series}


def test_long_and_short_setups(spark):
    done = [(109, 110, 107, 109), (109, 115, 108, 114.75), (114, 115, 113, 114)]
    got = steps(spark, ("long", BARS + done), ("short", MIRROR + [(-o, -l, -h, -c) for o, h, l, c in done]), ("early", BARS + [(109, 115, 108, 114.75), (114, 115, 113, 114)]), ("late", BARS + [(109, 110, 108, 109)] * 3))
    path = ["FINDING_HTF_POI", "WAITING_FOR_PBL", "WAITING_FOR_SWEEP", "MONITORING_LTF_CHOCH", "ORDER_PENDING"]
    assert [r.to_state for r in got["long"]] == [*path, "IN_POSITION", "COOLDOWN", "IDLE"] == [r.to_state for r in got["short"]]
    assert tuple(got["long"][4])[5:] == (1, 107, 103.25, 114.5) and tuple(got["short"][4])[5:] == (-1, -107, -103.25, -114.5)
    assert [r.reason for r in got["long"]][5:] == ["parent_limit_filled", "take_profit", "cooldown_complete"]
    assert [r.reason for r in got["early"]][5:] == ["target_reached_before_fill", "cooldown_complete"]
    assert [r.reason for r in got["late"]][5:] == ["pending_ttl_expired"]
