"""Scans and sinks of stored tables on small files."""

import sqlite3
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickforge.sources import sinks, tables


def test_files_that_are_there(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.sql("SELECT 'S' AS symbol, 1.5D AS open").write.parquet(a)
    schema = "symbol string, open double"
    assert [tuple(r) for r in tables.parquet_files(spark, [a, b], schema).collect()] == [("S", 1.5)]
    assert tables.parquet_files(spark, [b], schema).count() == 0
    files = tables.existing(spark, [a, b])
    assert files == [a]


def test_glob_unites_columns(spark, tmp_path):
    spark.sql("SELECT 1 AS x").write.parquet(f"{tmp_path}/t/date=2024-01-01")
    spark.sql("SELECT 2 AS x, 'new' AS y").write.parquet(f"{tmp_path}/t/date=2024-01-02")
    spark.sql("SELECT 3 AS x").write.parquet(f"{tmp_path}/t/date=2024-01-03")
    d = tables.parquet_glob(spark, f"{tmp_path}/t/date=*", "2024-01-01", "2024-01-02", base=f"{tmp_path}/t")
    assert sorted((r.x, r.y) for r in d.collect()) == [(1, None), (2, "new")]
    assert "PartitionFilters: [isnotnull(date" in d._jdf.queryExecution().toString()


def test_counts_of_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 0)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    import glob

    files = {k: glob.glob(f"{tmp_path}/{k}.parquet/*.parquet") for k in "ab"}
    got = {r.path: r.rows for r in tables.file_counts(spark, [*files["a"], *files["b"], f"{tmp_path}/none.parquet"]).collect()}
    assert got == {**{f: 3 for f in files["a"]}, **{f: 0 for f in files["b"]}, f"{tmp_path}/none.parquet": 0}


def test_quotes_in_windows(spark):
    at = lambda m: datetime(2024, 1, 1 + m // 1440, m % 1440 // 60, m % 60)
    q = spark.createDataFrame([("A", at(m), float(m)) for m in range(0, 3000, 7)] + [("B", at(5), 0.0)], "symbol string, timestamp timestamp_ntz, bid double")
    w = spark.createDataFrame([("A", at(10), at(40)), ("A", at(30), at(60)), ("A", at(1430), at(1450)), ("C", at(0), at(9))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    got = sorted(r.bid for r in tables.quotes_in_windows(q, w).collect())
    assert got == [float(m) for m in range(0, 3000, 7) if 10 <= m <= 60 or 1430 <= m <= 1450]


def test_json_and_reports(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert sorted((r.a, r.b) for r in tables.json_lines_to_parquet(spark, f"{tmp_path}/m.jsonl", f"{tmp_path}/out").collect()) == [(1, None), (2, "x")]
    for k in (1, 2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "board.json").write_text('{"rows": [{"name": "r%d",\n "score": %d}]}' % (k, k))
    got = tables.json_reports(spark, f"{tmp_path}/*/board.json", "rows")
    assert sorted((r.name, r.score, r.report_path.rsplit("/", 2)[1]) for r in got.collect()) == [("r1", 1, "1"), ("r2", 2, "2")]


def test_archives(spark, tmp_path):
    import zstandard

    body = b"ts_event,open,close\n2024-01-01T00:00:00Z,1.5,2\n2024-01-01T00:01:00Z,,bad\n"
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("x/data.ohlcv.csv.zst", zstandard.ZstdCompressor().compress(body))
        z.writestr("notes.txt", "no")
    (tmp_path / "p.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(body))
    (tmp_path / "q.csv").write_bytes(body)
    for name in ("v.zip", "p.csv.zst", "q.csv"):
        got = tables.archive_csv(spark, f"{tmp_path}/{name}", "ts_event string, open double, close double, volume long")
        assert sorted(tuple(r) for r in got.collect()) == [("2024-01-01T00:00:00Z", 1.5, 2.0, None), ("2024-01-01T00:01:00Z", None, None, None)]
    assert tables.member_names(["b.csv", "a.csv.zst", "c.txt"], "", True) == ["a.csv.zst", "b.csv"]
    with pytest.raises(ValueError):
        tables.member_names(["b.txt"], "ohlcv")


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("CREATE TABLE trials (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO trials VALUES (?, ?)", [(1, "a"), (2, None)])
    assert sorted(tuple(r) for r in tables.sqlite_table(spark, f"{tmp_path}/s.db", "trials", "id long, name string").collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        tables.sqlite_table(spark, f"{tmp_path}/s.db", "none", "id long")


def test_tables_are_written_whole(spark, tmp_path):
    at = f"{tmp_path}/t"
    sinks.write_table(spark.sql("SELECT 1 AS a, 'x' AS b"), at, "a long, b string, c double")
    sinks.write_table(spark.sql("SELECT 2 AS a"), at, "a long, b string, c double")
    assert [tuple(r) for r in spark.read.parquet(at).collect()] == [(2, None, None)]
    with pytest.raises(Exception):
        sinks.write_table(spark.sql("SELECT raise_error('no') AS a"), at, "a string")
    assert spark.read.parquet(at).count() == 1 and {p.name for p in tmp_path.iterdir() if ".old" in p.name} == set()
    sinks.write_event_context(spark.sql("SELECT 1 AS id, array('a', 'b') AS ids"), f"{at}-c")
    assert spark.read.parquet(f"{at}-c").first().ids == '["a","b"]'


def test_reports_and_orders(spark, tmp_path):
    d = spark.sql("SELECT 'a|b' AS name, 1 AS n UNION ALL SELECT '<i>', NULL").orderBy("name")
    assert sinks.markdown(d, "T").splitlines()[2:] == ["| name | n |", "|---|---|", "| <i> |  |", "| a\\|b | 1 |"]
    assert "<td>&lt;i&gt;</td><td></td>" in sinks.html(d, "T")
    t = spark.createDataFrame([("t1", "NQ", "short", datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10), 5.0, 4.0, 2)], "trade_id string, symbol string, side string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, contracts int")
    assert [(r.time, r.action, r.quantity, r.price) for r in sinks.order_csv(t).orderBy("time").collect()] == [("2024-01-01 09:00:00", "SELL", 2, 5.0), ("2024-01-01 10:00:00", "BUY", 2, 4.0)]
    assert sorted(r.value for r in sinks.order_lines(t, "Sim").collect())[0].startswith("PLACE;Sim;NQ;BUY;2;MARKET")
    sinks.write_json_lines(t.select("trade_id", F.lit(None).cast("int").alias("x")), f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first().value == '{"trade_id":"t1","x":null}'


def test_days_are_derived_once(spark, tmp_path):
    asked = []

    def make(days):
        asked.append(days)
        return spark.createDataFrame([(d, len(asked)) for d in days], "date string, n int").withColumn("date", F.col("date").cast("date"))

    at = f"{tmp_path}/cache"
    assert sinks.cached_days(spark, at, ["2024-01-01"], make).count() == 1
    got = sinks.cached_days(spark, at, ["2024-01-01", "2024-01-02"], make)
    assert asked == [["2024-01-01"], ["2024-01-02"]] and sorted(r.n for r in got.collect()) == [1, 2]
    assert sinks.cached_days(spark, at, ["2024-01-02"], make).count() == 1 and len(asked) == 2
