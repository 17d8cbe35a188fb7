"""Arrow batches in which texts go to Python workers, and the workers' memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS, BYTES = 1000, 4 << 20
_DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(ROWS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BYTES}b"),
}


def for_texts(spark: SparkSession) -> None:
    """Batches of whole texts: at most ROWS rows, and no more after BYTES bytes,
    where the session still has Spark's defaults (meant for numbers: 10,000 texts
    or 64 MB make a batch, which both sides hold several times over)."""
    for name, (default, ours) in _DEFAULTS.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that hands freed memory back when its task ends. Workers are
    reused, so what one operator held would count against the next one's room for minutes."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(stream)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only glibc has it
            pass

    return run
