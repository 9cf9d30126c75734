"""A setup of eight states over bars of two timeframes.

Everything a bar can know of structure comes from window and join operators: pivots, breaks and the blocks behind
them, of the bars themselves and of coarser ones. They and the bars are one stream of small rows in order of time, and
the machine, which is sequential, is one pass over a symbol's rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replay import pivots, structure_events
from .strategies import event_blocks

IDLE, FINDING, WAIT_PIVOT, WAIT_SWEEP, WATCHING, PENDING, OPEN, COOLDOWN = "IDLE", "FINDING_HTF_POI", "WAITING_FOR_PBL", "WAITING_FOR_SWEEP", "MONITORING_LTF_CHOCH", "ORDER_PENDING", "IN_POSITION", "COOLDOWN"
STEPS = "symbol string, timestamp timestamp_ntz, from_state string, to_state string, reason string, direction int, entry double, stop double, target double"
#: Kinds of rows, in the order that they count in at one time.
COARSE_PIVOT, COARSE_EVENT, PIVOT, EVENT, BAR = range(5)


@dataclass(frozen=True)
class Setup:
    """Parameters; distances are in ticks, waits in bars."""

    tick: float = 0.25
    minutes: int = 15
    coarse_swing: tuple = (3, 3)
    swing: tuple = (2, 2)
    break_buffer: int = 1
    least_range: int = 80
    block: tuple = (8, 120)
    micro_block: tuple = (4, 60)
    clearance: int = 4
    sweep_buffer: int = 1
    reclaim: int = 3
    stop_buffer: int = 4
    stop: tuple = (8, 80)
    target_r: float = 3.0
    ttl: int = 10
    most_spread: float = 4.0
    rest_after_cancel: int = 5
    rest_after_exit: int = 15


class Machine:
    """The state of one symbol; bar() gives the step that a bar made, if it made one."""

    def __init__(self, p: Setup):
        self.p, self.state, self.n = p, IDLE, 0
        self.recent: list = []  # the last bars, as many as a reclaim may take
        self.high = self.low = None  # latest coarse pivots
        self.coarse: list = []  # coarse breaks not looked at yet
        self.breaks: list = []  # breaks not looked at yet
        self.marks: list = []  # confirmed pivots: time, index, is_low, price
        self.clear()

    def clear(self) -> None:
        self.zone = self.pivot = self.sweep = self.order = None

    def to(self, state: str, reason: str) -> tuple:
        old, self.state = self.state, state
        return old, state, reason

    def rest(self, bars: int, reason: str) -> tuple:
        self.until = self.n + bars
        return self.to(COOLDOWN, reason)

    def tick(self, x: float, mode=round) -> float:
        return round(mode(x / self.p.tick) * self.p.tick, 10)

    def ticks(self, a: float, b: float) -> int:
        return round(abs(a - b) / self.p.tick)

    def bar(self, b) -> tuple | None:
        self.n += 1
        self.recent = (self.recent + [b])[-self.p.reclaim - 1:]
        if self.state == PENDING and (made := self.pending(b)):
            return made
        if self.state == OPEN and (made := self.position(b)):
            return made
        if self.state == COOLDOWN and self.n >= self.until:
            self.clear()
            return self.to(IDLE, "cooldown_complete")
        return {IDLE: self.find, FINDING: lambda b: self.to(WAIT_PIVOT, "htf_ob_validated"), WAIT_PIVOT: self.wait_pivot, WAIT_SWEEP: self.wait_sweep, WATCHING: self.watch}.get(self.state, lambda b: None)(b)

    def find(self, b) -> tuple | None:
        if not self.coarse:
            return None
        side, low, high, at = self.coarse.pop()
        if low is None or self.high is None or self.low is None or self.ticks(self.low, self.high) < self.p.least_range:
            return None
        if ((low + high) / 2 - (self.low + self.high) / 2) * side > 0:
            return None  # a long zone lies in the lower half, a short one in the upper
        self.zone = side, low, high, at
        return self.to(FINDING, "htf_poi_detected")

    def wait_pivot(self, b) -> tuple | None:
        side, low, high, since = self.zone
        gap = self.p.clearance * self.p.tick
        for at, index, is_low, price in reversed(self.marks):
            if is_low == (side == 1) and at > since and index < self.n - 1 and (price > high + gap if side == 1 else price < low - gap):
                self.pivot, self.from_bar, self.missed = price, self.n, False
                return self.to(WAIT_SWEEP, "pbl_confirmed")
        return None

    def wait_sweep(self, b) -> tuple | None:
        side, low, high, _ = self.zone
        far = (lambda x: x.low) if side == 1 else (lambda x: -x.high)
        level, back = self.pivot * side, b.close * side > self.pivot * side
        if self.missed or not back:
            return None
        window = self.recent[-min(len(self.recent), self.n - self.from_bar + 1):]
        pierced = [k for k, x in enumerate(window) if far(x) < level - self.p.sweep_buffer * self.p.tick]
        if not pierced:
            return None
        if not (b.low <= high and b.high >= low):
            self.missed = True  # the first sweep is the one that counts
            return None
        self.sweep = min(map(far, window[pierced[0]:])) * side, self.n - 1
        return self.to(WATCHING, "liquidity_sweep_confirmed")

    def watch(self, b) -> tuple | None:
        p, (side, *_) = self.p, self.zone
        if b.avg_spread == b.avg_spread and b.avg_spread is not None and b.avg_spread / p.tick > p.most_spread:
            return None
        k = next((k for k in reversed(range(len(self.breaks))) if self.breaks[k][0] == side and self.breaks[k][3] > self.sweep[1]), None)
        if k is None:
            return None
        _, low, high, _ = self.breaks.pop(k)
        if low is None:
            return None
        entry = self.tick(high if side == 1 else low)
        stop = min(low, self.sweep[0]) if side == 1 else max(high, self.sweep[0])
        stop = self.tick(stop - side * p.stop_buffer * p.tick, math.floor if side == 1 else math.ceil)
        if not p.stop[0] <= self.ticks(entry, stop) <= p.stop[1]:
            return None
        self.order, self.since = (side, entry, stop, self.tick(entry + p.target_r * (entry - stop))), self.n
        return self.to(PENDING, "ltf_choch_signal")

    def pending(self, b) -> tuple | None:
        side, entry, _, target = self.order
        filled = b.low <= entry if side == 1 else b.high >= entry
        reached = b.high >= target if side == 1 else b.low <= target
        if reached and not filled:
            return self.rest(self.p.rest_after_cancel, "target_reached_before_fill")
        if self.n - self.since > self.p.ttl:
            return self.rest(self.p.rest_after_cancel, "pending_ttl_expired")
        return self.to(OPEN, "parent_limit_filled") if filled else None

    def position(self, b) -> tuple | None:
        side, _, stop, target = self.order
        if b.low <= stop if side == 1 else b.high >= stop:
            return self.rest(self.p.rest_after_exit, "stop_loss")
        if b.high >= target if side == 1 else b.low <= target:
            return self.rest(self.p.rest_after_exit, "take_profit")
        return None


def coarse_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars stamped with the end of their bucket; of one minute, the bars themselves."""
    if minutes == 1:
        return bars.select("symbol", "timestamp", "open", "high", "low", "close")
    w = F.window("timestamp", f"{minutes} minutes")
    return bars.groupBy("symbol", w.alias("w")).agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close")).select("symbol", F.col("w.end").alias("timestamp"), "open", "high", "low", "close")


def _structure(bars: DataFrame, swing: tuple, heights: tuple, p: Setup, pivot_kind: int, event_kind: int) -> DataFrame:
    """Pivots at their confirmation and breaks with their blocks as rows."""
    from .replay import indexed

    at = indexed(bars.select("symbol", "timestamp"))
    marks = pivots(bars, *swing)
    marks = marks.join(at, ["symbol", "timestamp"])
    side = F.explode(F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit(False).alias("low_side"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit(True).alias("low_side"), F.col("low").alias("price"))))))
    empty = F.lit(None).cast("double")
    marks = marks.select("symbol", F.col("confirmed_at").alias("timestamp"), F.lit(pivot_kind).alias("kind"), F.col("timestamp").alias("since"), "i", side.alias("s"))
    marks = marks.select("symbol", "timestamp", "kind", "since", "i", F.col("s.low_side").cast("int").alias("side"), F.col("s.price").alias("low"), empty.alias("high"))
    events = structure_events(bars, *swing, buffer=p.break_buffer * p.tick)
    blocks = event_blocks(bars, events, *heights, p.tick)
    origin = at.select("symbol", F.col("i").alias("origin_i"), F.col("timestamp").alias("since"))
    blocks = blocks.join(origin, ["symbol", "origin_i"]).select("symbol", "event_i", "direction", "block_low", "block_high", "since")
    events = events.join(at.withColumnRenamed("i", "event_i"), ["symbol", "timestamp"]).join(blocks, ["symbol", "event_i", "direction"], "left")
    events = events.select("symbol", "timestamp", F.lit(event_kind).alias("kind"), "since", F.col("event_i").alias("i"), F.col("direction").alias("side"), F.col("block_low").alias("low"), F.col("block_high").alias("high"))
    return marks.unionByName(events)


def setups(bars: DataFrame, p: Setup = Setup()) -> DataFrame:
    """All steps of the machine over each symbol's bars (symbol, timestamp, open, high, low, close, avg_spread), with the order from ORDER_PENDING on."""
    rows = _structure(bars, p.swing, p.micro_block, p, PIVOT, EVENT).unionByName(_structure(coarse_bars(bars, p.minutes), p.coarse_swing, p.block, p, COARSE_PIVOT, COARSE_EVENT))
    none = F.lit(None)
    rows = rows.select("symbol", "timestamp", "kind", "since", F.col("i").cast("int").alias("i"), "side", "low", "high", none.cast("double").alias("close"), none.cast("double").alias("avg_spread"))
    spread = F.col("avg_spread") if "avg_spread" in bars.columns else none.cast("double")
    own = bars.select("symbol", "timestamp", F.lit(BAR).alias("kind"), none.cast("timestamp_ntz").alias("since"), none.cast("int").alias("i"), none.cast("int").alias("side"), "low", "high", "close", spread.alias("avg_spread"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m, out = Machine(p), []
        for r in g.sort_values(["timestamp", "kind", "i", "side"], kind="stable").itertuples():
            if r.kind == BAR:
                made = m.bar(r)
                if made:
                    order = m.order or (m.zone[0] if m.zone else None, None, None, None)
                    out.append((r.symbol, r.timestamp, *made, *order))
            elif r.kind == PIVOT:
                m.marks.append((r.since, int(r.i), bool(r.side), r.low))
            elif r.kind == COARSE_PIVOT:
                m.low, m.high = (r.low, m.high) if r.side else (m.low, r.low)
            else:
                (m.breaks if r.kind == EVENT else m.coarse).append((int(r.side), *((None, None) if r.low != r.low else (r.low, r.high)), r.since if r.kind == COARSE_EVENT else int(r.i)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    return rows.unionByName(own).groupBy("symbol").applyInPandas(run, STEPS)
