"""Small helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of text are regrouped so that about this many characters are worked on at once.
SLICE_CHARS = 3_000_000
#: Rows of an Arrow batch where the session does not say: such rows are whole texts, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: StructType) -> DataFrame:
    """``df.mapInArrow`` for an ``fn`` that yields dicts of columns, cast to ``schema``.

    A session without a number of rows for Arrow batches gets BATCH_ROWS.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(iter(batches)):
            yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()
        return_memory()

    return df.mapInArrow(run, schema)


def return_memory() -> None:
    """Give memory that this Python worker no longer uses back, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other platforms
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, one row at least."""
    lengths = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
