"""Functions of one value as Arrow columns, in memory that the size of the table has no part in.

A worker holds one batch, bounded in rows and bytes, and of its values those of one slice; what it frees goes back to
the system. So an executor's Python stays as it is however many rows a task has.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows and bytes that go to Python at once; texts are long, and an executor has several workers beside its heap.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Values of a batch that are Python's at a time.
SLICE = 64
pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back, where the default keeps them for the worker
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-8, 2)  # few arenas
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Freed memory back to the system."""
    if _libc is not None:
        _libc.malloc_trim(0)


def give_back() -> None:
    """The same, garbage too: a worker outlives its task, and several wait beside an executor's heap."""
    gc.collect()
    trim()


def bounded(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at most; a longer row is a batch of its own."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def sliced(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of each row of the columns, by slices."""
    n = len(columns[0])
    out = [pa.array([f(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns))], type=kind) for at in range(0, n, SLICE)]
    made = pa.concat_arrays(out) if out else pa.array([], type=kind)
    del out
    trim()
    return made


def each(f: Callable, kind: DataType, nulls: bool = False) -> Callable[[Column], Column]:
    """A column function that applies ``f`` to each value of a column; a null stays null unless ``f`` takes ``nulls``."""
    one = f if nulls else lambda x: None if x is None else f(x)

    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        return sliced(one, to_arrow_type(kind), a)

    return run
