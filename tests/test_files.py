"""File sources and the day-partitioned sink."""

import json
import lzma
from datetime import datetime as dt

from pyspark.sql import functions as F

from tickforge.sources import files


def test_binary_ticks(spark, tmp_path):
    rows = [(100, 100200, 100000, 1.0, 2.0), (1000, 100100, 100400, 3.0, 4.0)]
    (tmp_path / "a.bi5").write_bytes(lzma.compress(b"".join(files.TICK.pack(*r) for r in rows)))
    (tmp_path / "b.bi5").write_bytes(b"")
    got = sorted((r.ms, r.bid, r.ask, r.bid_size, r.ask_size) for r in files.binary_ticks(spark, str(tmp_path)).collect())
    assert got == [(100, 100.0, 100.2, 2.0, 1.0), (1000, 100.1, 100.4, 3.0, 4.0)]


def test_quote_csv_aliases_and_swap(spark, tmp_path):
    (tmp_path / "q.csv").write_text("ts_event,bid_px_00,ask_px_00,bid_sz_00,ask_sz_00\n2024-01-02T13:30:00.123456789Z,100.25,100.0,1,2\n2024-01-02T13:30:01Z,,100.0,1,2\n")
    (r,) = files.quote_csv(spark, str(tmp_path / "q.csv"), "A").collect()
    assert (r.timestamp, r.bid, r.ask, r.bid_size, r.ask_size) == (dt(2024, 1, 2, 13, 30, 0, 123456), 100.0, 100.25, 2.0, 1.0)


def test_minute_csv_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,time,open,high,low,close,volume\n01/02/2024,09:30,1,2,0.5,1.5,10\n")
    (tmp_path / "b.csv").write_text("2024-01-02 09:31:00,1,2,0.5,1.5,10\n")
    assert files.minute_csv(spark, str(tmp_path / "a.csv"), "A").collect()[0].timestamp == dt(2024, 1, 2, 9, 30)
    assert files.minute_csv(spark, str(tmp_path / "b.csv"), "A", header=False).collect()[0].timestamp == dt(2024, 1, 2, 9, 31)


def test_ohlcv_keeps_outright_contracts(spark, tmp_path):
    head = "ts_event,rtype,publisher_id,instrument_id,open,high,low,close,volume,symbol\n"
    (tmp_path / "v.csv").write_text(head + "2024-01-02T13:30:00.000000000Z,33,1,111,1,2,0.5,1.5,10,NQH4\n2024-01-02T13:30:00.000000000Z,33,1,9,1,2,0.5,1.5,99,NQH4-NQM4\n")
    (r,) = files.ohlcv_csv(spark, str(tmp_path)).collect()
    assert (r.symbol, r.tick_count, r.timestamp) == ("NQH4", 10, dt(2024, 1, 2, 13, 30))


def test_calendar(spark, tmp_path):
    e = {"event_id": "e1", "name": "CPI", "timestamp_utc": "2024-01-02T13:30:00Z", "importance": "high", "affected_symbols": ["A", "B"], "pre_event_minutes": 15, "release_window_minutes": 5, "post_event_minutes": 20}
    (tmp_path / "c.json").write_text(json.dumps({"calendar_id": "c", "events": [e]}, indent=1))
    rows = files.event_calendar(spark, str(tmp_path / "c.json")).collect()
    assert {r.symbol for r in rows} == {"A", "B"} and rows[0].pre_from == dt(2024, 1, 2, 13, 15) and rows[0].post_to == dt(2024, 1, 2, 13, 55)


def test_days_that_are_there_stay(spark, tmp_path):
    at = str(tmp_path / "days")
    d = spark.createDataFrame([("A", dt(2024, 1, 2, 1), 1.0), ("A", dt(2024, 1, 3, 1), 2.0)], "symbol string, timestamp timestamp_ntz, close double")
    files.write_days(d.limit(1), at)
    files.write_days(d.withColumn("close", F.col("close") + 10), at)
    read = lambda: sorted(r.close for r in spark.read.parquet(at).collect())
    assert read() == [1.0, 12.0]
    files.write_days(d.where("close = 1").withColumn("close", F.lit(5.0)), at, force=True)
    assert read() == [5.0, 12.0]
    assert [r.close for r in files.last_rows(d, 1).collect()] == [2.0]
