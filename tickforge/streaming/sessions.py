"""Sessions of a stream, and what lies between them: gaps that have closed and outages that last.

A session of a symbol holds ticks of which each comes at most a limit after the one before. Late ticks lengthen sessions or
join two, until the watermark passes them; only then is something told of them, and they are forgotten. The state is a row
or a pair of times for each session inside the allowed delay, however many ticks it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def joined_intervals(first: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals, joined where the next begins at most `most` after what came before."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1] + most))
    return first[new], reach[np.append(new[1:], len(first)) - 1]


def _keyed(ticks: DataFrame, late: str, clock: DataFrame | None, most: int, told, out: str) -> DataFrame:
    """Sessions of each symbol, of which told(first, last, watermark) gives out some, tells how many are done with and when to look again."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # the clock's rows, and ticks without symbol
            for _ in frames:
                pass
            return
        first, last = map(np.array, state.get) if state.exists else (np.empty(0, np.int64),) * 2
        if not state.hasTimedOut:
            new = np.concatenate([f["at"].to_numpy(np.int64) for f in frames])
            first, last = joined_intervals(np.concatenate([first, new]), np.concatenate([last, new]), most)
        rows, done, again = told(first, last, state.getCurrentWatermarkMs() * 1000)
        if done < len(first):
            state.update((first[done:].tolist(), last[done:].tolist()))
            if again is not None:
                state.setTimeoutTimestamp(int(again) // 1000 + 1)
        elif state.exists:
            state.remove()
        if len(rows["a"]):
            yield pd.DataFrame({"symbol": key[0]} | rows)

    time = F.col("timestamp").cast("timestamp").alias("timestamp")
    rows = ticks.where("timestamp IS NOT NULL").select("symbol", time)
    if clock is not None:
        rows = rows.unionByName(clock.select(F.lit(None).cast("string").alias("symbol"), time))
    # a condition on the symbol would be pushed below the watermark, which would then not see the clock
    rows = rows.withWatermark("timestamp", late).select("symbol", "timestamp", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("symbol").applyInPandasWithState(run, f"symbol string, {out}", "first array<long>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(ticks: DataFrame, seconds: int, late: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """Closed sessions: symbol, first_tick, last_tick, quiet_from; quiet_from is `seconds` after the last tick, and the watermark has passed it.

    Rows of clock (timestamp) are no ticks but move the watermark, so a session closes though no symbol has ticks any more.
    """
    most = seconds * 1_000_000

    def told(first, last, mark):
        done = int((last + most <= mark).sum())
        return {"a": first[:done], "b": last[:done]}, done, last[done] + most if done < len(last) else None

    found = _keyed(ticks, late, clock, most, told, "a long, b long")
    return found.select("symbol", F.timestamp_micros("a").alias("first_tick"), F.timestamp_micros("b").alias("last_tick"), F.timestamp_micros(F.col("b") + most).alias("quiet_from"))


def outages(ticks: DataFrame, seconds: int, late: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """One row for each time that a symbol has no tick for longer than `seconds`, given out while it lasts: symbol, last_tick, stale_from."""
    return sessions(ticks, seconds, late, clock).select("symbol", "last_tick", F.col("quiet_from").alias("stale_from"))


def gaps(ticks: DataFrame, minutes: int, late: str = "10 minutes", clock: DataFrame | None = None, same_day: bool = True) -> DataFrame:
    """Gaps longer than `minutes` between ticks of a symbol, inside a day or anywhere: symbol, gap_from, gap_to.

    A gap is given out once, when the watermark has passed its end; the session that ends it is kept for the next gap.
    """
    def told(first, last, mark):
        done = max(0, int((first <= mark).sum()) - 1)
        return {"a": last[:done], "b": first[1:done + 1]}, done, first[done + 1] if done + 1 < len(first) else None

    found = _keyed(ticks, late, clock, minutes * 60_000_000, told, "a long, b long")
    found = found.select("symbol", F.timestamp_micros("a").alias("gap_from"), F.timestamp_micros("b").alias("gap_to"))
    return found.where(F.to_date("gap_from") == F.to_date("gap_to")) if same_day else found
