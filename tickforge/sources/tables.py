"""Scans of stored tables: Parquet by list and by glob, quotes by windows, JSON, archives of CSV files and small SQLite stores."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import interval_join
from ..operators.metrics import merge_intervals

TICKS = "symbol string, timestamp timestamp_ntz, bid double, ask double, bid_size double, ask_size double, mid double, spread double"
BARS = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, tick_count int, bid_close double, ask_close double, avg_spread double"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, on whatever file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def parquet_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the listed files that are there; none of them gives an empty table of the schema."""
    paths = existing(spark, paths)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def parquet_glob(spark: SparkSession, pattern: str, first: str | None = None, last: str | None = None, *, base: str | None = None, date: str = "date") -> DataFrame:
    """All files of a pattern, columns united by name, of days from first to last (both included); days prune folders where they are partitions under base."""
    r = spark.read.option("mergeSchema", True)
    d = (r.option("basePath", base) if base else r).parquet(pattern)
    if first:
        d = d.where(F.col(date).cast("date") >= F.lit(first).cast("date"))
    if last:
        d = d.where(F.col(date).cast("date") <= F.lit(last).cast("date"))
    return d


def quotes_in_windows(quotes: DataFrame, windows: DataFrame) -> DataFrame:
    """Quotes inside any of the windows (symbol, start, end), each once: overlapping windows are merged first, and only their days are read."""
    merged = merge_intervals(windows, ["symbol"], "start", "end")
    days = merged.select("symbol", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("__day")).distinct()
    near = quotes.withColumn("__day", F.to_date("timestamp")).join(days, ["symbol", "__day"], "left_semi").drop("__day")
    return interval_join(near, merged.select("symbol", F.col("start").alias("__start"), F.col("end").alias("__end")), "timestamp", "__start", "__end", keys=["symbol"]).drop("__start", "__end")


def bar_times(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "timestamp")


def file_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of each listed file: path, rows (0 where it is empty or missing). Counts come from the footers."""
    want = spark.createDataFrame([(p,) for p in paths], "path string")
    name = F.regexp_extract("path", "([^/]+(?:/[^/]+)?)$", 1)
    found = existing(spark, paths)
    if not found:
        return want.withColumn("rows", F.lit(0).cast("long"))
    seen = spark.read.parquet(*found).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")).select(name.alias("name"), "rows")
    return want.withColumn("name", name).join(seen.groupBy("name").agg(F.sum("rows").alias("rows")), "name", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Records, one a line; blank lines are left out, a line that isn't JSON is an error."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def json_lines_to_parquet(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Records with the columns that they have, as Parquet."""
    json_lines(spark, path).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def json_reports(spark: SparkSession, pattern: str, rows: str | None = None) -> DataFrame:
    """Documents of a glob with the path each is from; with rows the records of that array."""
    d = spark.read.option("multiLine", True).json(pattern).withColumn("report_path", F.col("_metadata.file_path"))
    return d.select("report_path", F.explode(rows).alias("__r")).select("report_path", "__r.*") if rows else d


def member_names(names: list[str], part: str, every: bool = False) -> list[str]:
    """CSV members of an archive whose names hold a text; without every there must be one at least, and the first by name counts."""
    found = sorted(n for n in names if part in n and n.removesuffix(".zst").endswith(".csv"))
    if every:
        return found
    if not found:
        raise ValueError(f"no member with {part!r}")
    return found[:1]


def _text(name: str, data: bytes) -> Iterator[str]:
    if name.endswith(".zst"):
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    else:
        stream = io.BytesIO(data)
    yield from io.TextIOWrapper(stream, "utf-8")


def archive_lines(spark: SparkSession, path: str, part: str = "", every: bool = False) -> DataFrame:
    """Lines of CSV files: plain, zstd, zip, or zstd inside zip; file, line number, line. An archive is read by one task, line by line."""
    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        members = [(f"{file}#{n}", z.read(n)) for n in member_names(z.namelist(), part, every)]
                else:
                    members = [(file, data)]
                for name, raw in members:
                    held = []
                    for n, line in enumerate(_text(name, raw)):
                        held.append((name, n, line.rstrip("\r\n")))
                        if len(held) == 50_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(("file", "number", "line"), h)) for h in held])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist([dict(zip(("file", "number", "line"), h)) for h in held])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, number long, line string")


def archive_csv(spark: SparkSession, path: str, schema: str, part: str = "", every: bool = False) -> DataFrame:
    """Rows of the CSV files of an archive by the names in their headers; a cell that can't be read is null."""
    lines = archive_lines(spark, path, part, every)
    heads = lines.where("number = 0").select("file", F.split("line", ",").alias("head"))
    rows = lines.where("number > 0 AND line <> ''").join(heads, "file").select(F.map_from_arrays("head", F.slice(F.concat(F.split("line", ","), F.array_repeat(F.lit(""), F.size("head"))), F.lit(1), F.size("head"))).alias("m"))
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return rows.select(*[F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")).try_cast(t).alias(n) for n, t in fields])


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of a small local SQLite store (experiments, tasks, execution state)."""
    names = [f.strip().split(" ", 1)[0] for f in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        if table not in {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}:
            raise ValueError(f"no table {table!r}")
        rows = con.execute(f'SELECT {", ".join(f"{chr(34)}{n}{chr(34)}" for n in names)} FROM "{table}"').fetchall()
    return spark.createDataFrame(rows, schema)
