"""File sources: vendor CSV, aliased quote CSV, minute CSV, binary ticks, JSON calendars and reports."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import existing

OHLCV = "ts_event string, rtype int, publisher_id int, instrument_id long, open double, high double, low double, close double, volume long, symbol string"
#: Names that vendors give to a column, in order of preference: fixed values.
ALIASES = {"timestamp": ["ts_event", "timestamp", "ts_recv", "time"], "bid": ["bid_px_00", "bid", "bid_price"], "ask": ["ask_px_00", "ask", "ask_price"], "bid_size": ["bid_sz_00", "bid_size"], "ask_size": ["ask_sz_00", "ask_size"]}
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMdd HHmmss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss"]
#: Record of a binary tick: milliseconds, ask and bid as scaled integers, ask and bid size.
TICK = struct.Struct(">IIIff")


def utc_micros(text: str | Column) -> Column:
    """A time of up to nanoseconds as timestamp without zone, cut to microseconds."""
    c = F.col(text) if isinstance(text, str) else text
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(c, r"(\.\d{6})\d+", "$1"), r"[Zz]$|\+00:?00$", ""))


def ohlcv_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Vendor bars: outright contracts only, times in UTC; a bad cell is null."""
    d = spark.read.schema(OHLCV).option("header", True).option("mode", "PERMISSIVE").csv(path)
    d = d.where(F.col("symbol").rlike(r"^[A-Z]{2,3}[HMUZ]\d$"))
    return d.select("symbol", utc_micros("ts_event").alias("timestamp"), "instrument_id", "open", "high", "low", "close", F.col("volume").cast("int").alias("tick_count"))


def quote_csv(spark: SparkSession, path: str | list[str], symbol: str) -> DataFrame:
    """Quotes under any of the known column names; crossed ones are swapped with their sizes, rows without prices left out."""
    d = spark.read.option("header", True).csv(path)
    pick = lambda k: F.coalesce(*[F.col(f"`{a}`") for a in ALIASES[k] if a in d.columns], F.lit(None).cast("string"))
    q = d.select(utc_micros(pick("timestamp")).alias("timestamp"), *[pick(k).try_cast("double").alias(k) for k in ("bid", "ask", "bid_size", "ask_size")]).where("bid IS NOT NULL AND ask IS NOT NULL AND timestamp IS NOT NULL")
    swap = F.col("bid") > F.col("ask")
    side = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    q = q.select(F.lit(symbol).alias("symbol"), "timestamp", side("bid", "ask"), side("ask", "bid"), side("bid_size", "ask_size"), side("ask_size", "bid_size"))
    return q.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def minute_csv(spark: SparkSession, path: str | list[str], symbol: str, header: bool = True) -> DataFrame:
    """Minute bars with a timestamp or a date and a time column (or six or seven columns by place), in one of six time formats."""
    d = spark.read.option("header", header).csv(path)
    if not header:
        d = d.toDF(*(["date", "time"] if len(d.columns) == 7 else ["timestamp"]), "open", "high", "low", "close", "volume")
    names = {c.strip().lower(): c for c in d.columns}
    at = F.col(names["timestamp"]) if "timestamp" in names else F.concat_ws(" ", F.col(names["date"]), F.col(names["time"]))
    when = F.coalesce(*[F.try_to_timestamp(at, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")
    price = [F.col(names[c]).try_cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return d.select(F.lit(symbol).alias("symbol"), when.alias("timestamp"), *price, F.col(names["volume"]).try_cast("double").cast("int").alias("tick_count")).where("timestamp IS NOT NULL")


def decode_ticks(data: bytes, scale: float) -> list[tuple[int, float, float, float, float]]:
    """(milliseconds, bid, ask, bid size, ask size) of an LZMA file; crossed prices are swapped with their sizes."""
    raw = lzma.decompress(data) if data else b""
    out = []
    for ms, ask, bid, ask_size, bid_size in TICK.iter_unpack(raw[:len(raw) // TICK.size * TICK.size]):
        if bid > ask:
            bid, ask, bid_size, ask_size = ask, bid, ask_size, bid_size
        out.append((ms, bid / scale, ask / scale, float(bid_size), float(ask_size)))
    return out


def binary_ticks(spark: SparkSession, path: str, scale: float = 1000.0) -> DataFrame:
    """Ticks of binary hour files; path and milliseconds since the start of the hour."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows := decode_ticks(data, scale):
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows)), *[pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), *[pa.float64()] * 4])]], names=["path", "ms", "bid", "ask", "bid_size", "ask_size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, ms long, bid double, ask double, bid_size double, ask_size double")


def hourly_ticks(spark: SparkSession, path: str, scale: float = 1000.0) -> DataFrame:
    """Ticks of binary hour files with symbol and time, both from the path: SYMBOL/year/month/day/hour..., months from 0."""
    part = lambda k: F.regexp_extract("path", r"([A-Za-z0-9.]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h?[^/]*$", k)
    num = lambda k: part(k).cast("int")
    hour = F.make_timestamp_ntz(num(2), num(3) + 1, num(4), num(5), F.lit(0), F.lit(0))
    d = binary_ticks(spark, path, scale).select(part(1).alias("symbol"), (hour + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ms") / F.lit(1000).cast("decimal(10,0)"))).alias("timestamp"), "bid", "ask", "bid_size", "ask_size")
    return d.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON calendars, one row for each affected symbol."""
    d = spark.read.option("multiLine", True).json(path).select("calendar_id", F.explode("events").alias("e")).select("calendar_id", "e.*")
    minutes = lambda c: F.make_dt_interval(F.lit(0), F.lit(0), F.col(c).cast("int"))
    at = utc_micros("timestamp_utc")
    return d.select("calendar_id", "event_id", "name", "importance", at.alias("event_time"), F.explode("affected_symbols").alias("symbol"), (at - minutes("pre_event_minutes")).alias("pre_from"), (at + minutes("release_window_minutes")).alias("release_to"), (at + minutes("release_window_minutes") + minutes("post_event_minutes")).alias("post_to"))


def last_rows(d: DataFrame, n: int, time: str = "timestamp") -> DataFrame:
    """The last n rows, in order of time."""
    return d.orderBy(F.desc(time)).limit(n).orderBy(time)


def write_days(d: DataFrame, path: str, time: str = "timestamp", force: bool = False) -> None:
    """Parquet by symbol and day; days that are there stay unless forced, and then only days of the new rows are replaced."""
    spark = d.sparkSession
    d = d.withColumn("date", F.to_date(time))
    if not force and existing(spark, [path]):
        present = spark.read.schema("symbol string, date date").parquet(path).select("symbol", "date").distinct()
        d = d.join(present, ["symbol", "date"], "left_anti")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").parquet(path)
