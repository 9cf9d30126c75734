"""File statistics from Parquet footers, and scans that open only the files that can hold what is asked for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import merge_intervals
from .tables import quotes_in_windows

STATISTICS = "path string, rows long, first timestamp_ntz, last timestamp_ntz, first_symbol string, last_symbol string"


def _footer(path: str, time: str, symbol: str) -> tuple:
    """Rows, and the extremes of two columns that the footer's row groups tell; null where one doesn't."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    with files.open_input_file(at) as f:
        meta = pq.read_metadata(f)
    out: dict[str, list] = {time: [], symbol: []}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema in out and group.num_rows:
                s = column.statistics
                out[column.path_in_schema].append((s.min, s.max) if s is not None and s.has_min_max else None)
    ends = [(None, None) if not x or None in x else (min(a for a, _ in x), max(b for _, b in x)) for x in out.values()]
    times = [t.replace(tzinfo=None) if t is not None else None for t in ends[0]]
    return meta.num_rows, *times, *ends[1]


def file_statistics(spark: SparkSession, path: str, time: str = "timestamp", symbol: str = "symbol", tasks: int = 64) -> DataFrame:
    """A row for each Parquet file under path (STATISTICS); footers are read by tasks, and a file whose footer can't be opened or tells nothing has nulls."""
    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                try:
                    rows.append((p, *_footer(p, time, symbol)))
                except (OSError, ValueError, NotImplementedError, pa.ArrowException):
                    rows.append((p, None, None, None, None, None))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in STATISTICS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.repartition(tasks).mapInArrow(run, STATISTICS)


def files_in_windows(statistics: DataFrame, windows: DataFrame) -> DataFrame:
    """path of the files that may hold rows of any window (symbol, start, end): those whose times and symbols reach one, and those that tell nothing."""
    merged = merge_intervals(windows, ["symbol"], "start", "end")
    day = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    known = statistics.where("first IS NOT NULL AND last IS NOT NULL")
    met = known.withColumn("day", day("first", "last")).join(merged.withColumn("day", day("start", "end")), "day")
    met = met.where("first <= end AND last >= start AND (first_symbol IS NULL OR symbol BETWEEN first_symbol AND last_symbol)")
    return met.select("path").unionByName(statistics.where("(first IS NULL OR last IS NULL) AND coalesce(rows, 1) > 0").select("path")).distinct()


def scan_windows(spark: SparkSession, statistics: DataFrame, windows: DataFrame, schema: str) -> DataFrame:
    """Rows inside any of the windows, each once, from the files that may hold some; times outside all windows are skipped by row group.

    The list of chosen files comes to the driver, as Spark's own listing does.
    """
    paths = [r.path for r in files_in_windows(statistics, windows).collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    first, last = windows.agg(F.min("start"), F.max("end")).first()
    rows = spark.read.schema(schema).parquet(*paths).where(F.col("timestamp").between(F.lit(first), F.lit(last)))
    return quotes_in_windows(rows, windows)
