"""Memory of Python workers, which live through many stages.

Spark gathers up to 10,000 rows or 64 MB in an Arrow batch, which the JVM, the way between and Python each hold, and of
which the JVM keeps native memory; batches are bounded to BATCH_BYTES.

What an operator keeps from task to task (memos of units, counts) is dropped when a worker turns to another operator,
and memory that is free is given back, as Arrow's and C's allocators would keep it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Size of the Arrow batches that go to workers; a larger row is a batch of its own.
BATCH_BYTES = 2 << 20
_CACHES: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Tells how to drop what an operator keeps in a worker."""
    _CACHES[operator] = clear


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, unless it was given a size; rows and results are the same with any."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, f"{BATCH_BYTES}b"))


def begin(operator: str) -> None:
    """Called when a worker starts on an operator's task."""
    global _owner
    if _owner != operator:
        for name, clear in _CACHES.items():
            if name != operator:
                clear()
        _owner = operator
        trim()


def trim() -> None:
    """Gives free memory back; where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
