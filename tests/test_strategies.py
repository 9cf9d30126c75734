"""Strategy runners on literal bars and ticks."""

from datetime import datetime as dt
from datetime import timedelta

import pytest

from tickforge.operators import strategies as Y

T0 = dt(2024, 1, 2, 13, 30)
BARS = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, bid_close double, ask_close double"


def make(spark, closes):
    return spark.createDataFrame([("A", T0 + timedelta(minutes=i), c, c + 0.3, c - 0.3, c, c - 0.1, c + 0.1) for i, c in enumerate(closes)], BARS)


def test_opening_range_takes_profit(spark):
    (t,) = Y.opening_range(make(spark, [100.0, 100.1, 100.2, 104.0, 107.4, 107.0]), 3, 2.75, 3.0).collect()
    assert (t.side, t.exit_reason, t.gross_pnl, t.net_pnl) == ("long", "take_profit", pytest.approx(60.0), pytest.approx(45.0))


def test_position_is_closed_with_the_day(spark):
    (t,) = Y.opening_range(make(spark, [100.0, 100.1, 100.2, 104.0, 104.1]), 3, 2.75, 3.0).collect()
    assert t.exit_reason == "end_of_data" and t.exit_price == pytest.approx(104.0)


def ticks(spark, rows):
    return spark.createDataFrame([("A", T0 + timedelta(seconds=s), b, a, (a + b) / 2, i) for i, (s, b, a) in enumerate(rows)], "symbol string, timestamp timestamp_ntz, bid double, ask double, mid double, seq long")


def test_tick_replay_long_and_short(spark):
    quiet = [(0, 99.9, 100.1), (60, 100.0, 100.2), (120, 99.95, 100.15)]
    (t,) = Y.tick_replay(ticks(spark, [*quiet, (180, 103.9, 104.1), (181, 104.1, 104.3), (240, 107.6, 107.8)]), 3, 2.75, 3.0).collect()
    assert (t.side, t.entry_price, t.exit_price, t.gross_pnl, t.net_pnl) == ("long", 104.5, 107.5, 60.0, 45.0)
    (t,) = Y.tick_replay(ticks(spark, [*quiet, (180, 95.9, 96.1), (181, 95.9, 96.1), (240, 98.0, 98.3)]), 3, 2.5, 3.0).collect()
    assert (t.side, t.entry_price, t.exit_price, t.net_pnl) == ("short", 95.75, 98.5, -70.0)
