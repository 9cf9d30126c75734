"""Sinks: typed Parquet written whole or not at all, JSON and text reports, order exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BARS, TICKS, existing

TRADES = "trade_id string, symbol string, side string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, contracts int, gross_pnl double, net_pnl double, exit_reason string"
EQUITY = "seq long, timestamp timestamp_ntz, equity double, drawdown double"
FOLDS = "fold int, split string, trade_count long, net_pnl double, sharpe double, max_drawdown double"


def typed(d: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast; one that is missing is null."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return d.select(*[(F.col(n) if n in d.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def write_table(d: DataFrame, path: str, schema: str | None = None) -> None:
    """Parquet that readers see whole: written beside the path, then renamed, after what was there is moved away."""
    spark = d.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    (typed(d, schema) if schema else d).write.parquet(new)
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = at.getFileSystem(conf)
    there = fs.exists(at)
    if there and not fs.rename(at, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, at):
        if there:
            fs.rename(old, at)
        raise OSError(f"can't write {path}")
    if there:
        fs.delete(old, True)


def cached_days(spark, path: str, days: list[str], make) -> DataFrame:
    """A table derived by day, stored under path by date: days that are there are read, make(days) is asked for the others only."""
    there = set()
    if existing(spark, [path]):
        there = {str(r.date) for r in spark.read.schema("date date").parquet(path).select("date").distinct().collect()}  # a row a day
    if missing := [d for d in days if d not in there]:
        make(missing).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return spark.read.parquet(path).where(F.col("date").isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False))


def write_ticks(d: DataFrame, path: str) -> None:
    write_table(d, path, TICKS)


def write_bars(d: DataFrame, path: str) -> None:
    write_table(d, path, BARS)


def write_event_context(d: DataFrame, path: str) -> None:
    """Event contexts, arrays as JSON text."""
    write_table(d.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in d.dtypes]), path)


def write_research(path: str, trades: DataFrame, equity: DataFrame, folds: DataFrame) -> None:
    """The tables of a research run under one folder."""
    for name, d, schema in (("trades", trades, TRADES), ("equity", equity, EQUITY), ("fold_metrics", folds, FOLDS)):
        write_table(d, f"{path}/{name}", schema)


def write_json_lines(d: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record a line; mode append adds to what is there."""
    d.write.mode(mode).option("ignoreNullFields", False).json(path)


def markdown(d: DataFrame, title: str, rows: int = 100) -> str:
    """A short table as text; rows bounds what comes to the driver."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in d.limit(rows).collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(d.columns) + " |", "|" + "---|" * len(d.columns), *body, ""])


def html(d: DataFrame, title: str, rows: int = 100) -> str:
    """The same as a page."""
    from html import escape

    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(row("td", r) for r in d.limit(rows).collect())
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{row('th', d.columns)}{body}</table>"


def order_csv(trades: DataFrame) -> DataFrame:
    """Two orders a trade, its entry and its exit, for a platform's CSV import."""
    leg = lambda k: F.struct(F.col(f"{k}_time").alias("time"), F.when((F.col("side") == "long") == F.lit(k == "entry"), "BUY").otherwise("SELL").alias("action"), F.col(f"{k}_price").alias("price"), F.lit(k).alias("leg"))
    x = trades.select("trade_id", "symbol", "contracts", F.explode(F.array(leg("entry"), leg("exit"))).alias("o"))
    return x.select("trade_id", "symbol", F.date_format("o.time", "yyyy-MM-dd HH:mm:ss").alias("time"), "o.action", F.col("contracts").alias("quantity"), "o.price", "o.leg")


def order_lines(trades: DataFrame, account: str) -> DataFrame:
    """The same as lines of order text, fields split by semicolons."""
    o = order_csv(trades)
    return o.select(F.concat_ws(";", F.lit("PLACE"), F.lit(account), "symbol", "action", "quantity", F.lit("MARKET"), F.lit(""), F.lit(""), F.lit("DAY"), F.lit(""), F.concat_ws("-", "trade_id", "leg")).alias("value"))
