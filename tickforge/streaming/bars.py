"""Structured Streaming: bars, deduplication, cooldown and lookback signals over a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import versions


def tick_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Ticks (symbol, timestamp, ..., seq) from Parquet files that arrive in a folder; timestamps become event time."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def minute_bars(ticks: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """OHLC bars that are given out once, when the watermark has passed them; state is dropped then."""
    at = F.struct("timestamp", "seq")
    return ticks.withWatermark("timestamp", late).groupBy("symbol", F.window("timestamp", f"{minutes} minutes").alias("w")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("tick_count")).select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "tick_count")


def deduplicated(ticks: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of repeated ticks; keys are forgotten behind the watermark."""
    return ticks.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(keys)


def cooldown(signals: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Signals of a symbol at least so many seconds after the one before that was let through; the state is one time a symbol, until the watermark has passed the cooldown."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        keep = []
        for now in rows["at"]:
            keep.append(last is None or now - last >= seconds * 1_000_000)
            if keep[-1]:
                last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        if any(keep):
            yield rows[keep][["symbol", "timestamp", "seq"]]

    timed = signals.where("timestamp IS NOT NULL").withWatermark("timestamp", late).select("symbol", "timestamp", "seq", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))
    return timed.groupBy("symbol").applyInPandasWithState(run, "symbol string, timestamp timestamp, seq long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def lookback_signals(bars: DataFrame, n: int = 20, z: float = 1.5) -> DataFrame:
    """Bars whose close is z standard deviations from the mean of the n before it; the state is the last n closes of a symbol."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("timestamp").itertuples():
            if len(past) == n:
                s = pd.Series(past)
                sd = s.std(ddof=0)
                score = (r.close - s.mean()) / sd if sd > 0 else 0.0
                if abs(score) >= z:
                    out.append((r.symbol, r.timestamp, float(score)))
            past = (past + [float(r.close)])[-n:]
        state.update((past,))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "timestamp", "z"])

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, timestamp timestamp, z double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def merged_reports(reports: DataFrame, columns: list[str], late: str = "1 day", keep_hours: int = 24 * 40) -> DataFrame:
    """What each report (key, timestamp, seq and columns) is to those of its key before: new, duplicate (adds nothing), enriched (fills a gap) or conflict (a value differs; the first stays).

    The state is a row a key, and a time after which the key is forgotten: keep_hours after its last report, by the watermark. Reports behind the watermark are dropped.
    """
    fields = ", ".join(f"{c} string" for c in columns)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *held, until = state.get if state.exists else (None,)
        held, until = held or None, until or 0
        out = []
        frames = list(frames)
        rows = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = rows["seq"].to_numpy().argsort(kind="stable")  # a key has few rows: what counts is the cost of a call
        seqs, times, *values = (rows[c].to_numpy()[order].tolist() for c in ("seq", "at", *columns))
        for seq, at, *own in zip(seqs, times, *values):
            own = [None if v is None or v != v else v for v in own]
            if held is None:
                held, kind = own, "new"
            else:
                differs = any(a is not None and b is not None and a != b for a, b in zip(held, own))
                fills = any(a is None and b is not None for a, b in zip(held, own))
                kind = "conflict" if differs else "enriched" if fills else "duplicate"
                if not differs:
                    held = [a if a is not None else b for a, b in zip(held, own)]
            until = max(until, at // 1000 + keep_hours * 3_600_000)
            out.append(kind)
        state.update((*held, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "seq": seqs, "outcome": out})

    timed = reports.where("timestamp IS NOT NULL").withWatermark("timestamp", late).withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp")))
    return timed.groupBy("key").applyInPandasWithState(run, "key long, seq long, outcome string", f"{fields}, until long", "append", GroupStateTimeout.EventTimeTimeout)


def planned(signals: DataFrame, a_day: int, late: str = "10 minutes", slots: int | None = None) -> DataFrame:
    """Signals (symbol, timestamp, seq, hash) whose hash was not planned before, up to a number a day and symbol; with slots (and a column until), up to so many open at a time.

    The state is the hashes of the days of a symbol that the watermark has not passed, so a late signal of an earlier day counts to that day and makes nothing forgotten; signals behind the watermark are dropped.
    """
    day = 86_400_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, hashes, ends = map(list, state.get) if state.exists else ([], [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            rows, keep = pd.concat(list(frames)).sort_values(["at", "seq"]), []
            for at, hash_, end in zip(rows["at"], rows["hash"], rows["end"]):
                today = at // day
                busy = slots is not None and sum(e > at for e in ends) >= slots
                ok = hash_ not in hashes and days.count(today) < a_day and not busy
                if ok:
                    days.append(today)
                    hashes.append(hash_)
                    ends.append(end)
                keep.append(ok)
            if any(keep):
                yield rows[keep][["symbol", "timestamp", "seq"]]
        held = [k for k, d in enumerate(days) if (d + 1) * day > mark or slots is not None and ends[k] > mark]
        if not held:
            if state.exists:
                state.remove()
            return
        days, hashes, ends = ([x[k] for k in held] for x in (days, hashes, ends))
        state.update((days, hashes, ends))
        state.setTimeoutTimestamp(max(min((d + 1) * day // 1000 for d in days), state.getCurrentWatermarkMs()) + 1)

    end = F.unix_micros(F.col("until").cast("timestamp")) if slots is not None else F.lit(0).cast("long")
    timed = signals.where("timestamp IS NOT NULL").withWatermark("timestamp", late)
    timed = timed.select("symbol", "timestamp", "seq", "hash", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), end.alias("end"))
    return timed.groupBy("symbol").applyInPandasWithState(run, "symbol string, timestamp timestamp, seq long", "days array<long>, hashes array<string>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def fresh(quotes: DataFrame, seconds: int, now: str = "current_timestamp()") -> DataFrame:
    """Adds age in seconds and whether a quote is stale by now."""
    age = F.expr(f"timestampdiff(MICROSECOND, cast(timestamp AS timestamp), cast({now} AS timestamp)) / 1e6D")
    return quotes.withColumn("age", age).withColumn("stale", F.col("age") > seconds)


def simulated(spark: SparkSession, start: str, seconds: int, count: int) -> DataFrame:
    """Trigger events at a fixed step: seq, timestamp."""
    return spark.range(count).select(F.col("id").alias("seq"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * seconds).cast("int"))).alias("timestamp"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Handles all that is there and ends; out is a Parquet folder, exactly once by the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def upsert_available(stream: DataFrame, out: str, checkpoint: str, keys: list[str], compact_every: int = 32) -> None:
    """Later rows of a key replace earlier ones: each micro-batch is a version of its number, and every so many versions become one (sources.versions.last_version reads them)."""
    def write(batch: DataFrame, number: int) -> None:
        versions.append_version(batch, out, number)
        if (number + 1) % compact_every == 0:
            versions.compact(batch.sparkSession, out, keys)

    stream.drop("version").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
