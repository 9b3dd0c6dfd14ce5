"""What the operators of this subpackage share: the cluster's folder, text as byte arrays, hashes, packed shuffles.

Texts reach Python as Arrow batches. A batch's UTF-8 buffer is viewed as one ``uint8`` array with the
documents' offsets, and every per-byte or per-word step is a numpy pass over a chunk of whole documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from vellum.functions.each import BATCH_ROWS, bounded, give_back
from vellum.sources.folders import work_path

U64 = np.uint64
#: Bytes of text that one numpy pass covers; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18


# The cluster:
_large: list = []


def large(cached):
    """A cached function whose values are so large that a worker drops them when a task of another operator begins."""
    _large.append(cached)
    return cached


def drop_large(keep: object = None) -> None:
    for cached in _large:
        if cached is not keep:
            cached.cache_clear()


def task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that leaves no freed memory with the worker when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_large()
        yield from f(batches)
        give_back()

    return run


prepare = bounded


def fields(schema: StructType, leave: Iterable[str] = ()) -> str:
    """The fields of ``schema`` but some, as a schema string; any name and nested names can be there."""

    def kind(t: DataType) -> str:
        if isinstance(t, StructType):
            return f"struct<{', '.join(f'{name(f.name)}: {kind(f.dataType)}' for f in t)}>"
        if isinstance(t, ArrayType):
            return f"array<{kind(t.elementType)}>"
        if isinstance(t, MapType):
            return f"map<{kind(t.keyType)}, {kind(t.valueType)}>"
        return t.simpleString()

    def name(n: str) -> str:
        return "`" + n.replace("`", "``") + "`"

    left_out = set(leave)
    return ", ".join(f"{name(f.name)} {kind(f.dataType)}" for f in schema if f.name not in left_out)


def column(name: str):
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Whether Spark removes the shuffle files of a query when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, leaves no shuffle files."""
    spark = df.sparkSession
    path, before = work_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    prepare(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows that must share a key before it is hot; there are at most as many hot keys as rows divided by this.
HOT = 100_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], count: str) -> DataFrame:
    """``big`` joined to ``small``, which has one row a key with the number of its rows in ``big``: hot keys by broadcast, others by shuffle."""
    few = small.where(F.col(count) >= HOT)
    if few.isEmpty():
        return big.join(small, on)
    return big.join(F.broadcast(few), on).unionByName(big.join(F.broadcast(few.select(*on)), on, "left_anti").join(small.where(F.col(count) < HOT), on))


# Text as arrays:
def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, width)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off.astype(np.int64)


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES, rows: int = BATCH_ROWS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive documents of about ``limit`` bytes and ``rows`` rows at most, one document at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, min(hi, n)
        lo = min(hi, n)


def texts_of(col: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time."""
    data, off = utf8(col)
    view = memoryview(data)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield bytes(view[a:b])


# Hashes:
_rng = np.random.default_rng(0x5EED)
BYTE_KEYS = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = int(_rng.integers(0, 2**63)) * 8 + 5  # odd, of large order
BASE &= (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(values: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every run of ``k`` values, by doubling; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, block, length = None, 0, base & (2**64 - 1), values, 1
    bits = k
    while bits:
        if bits & 1:  # take the block at the front of what is still missing
            part = block[done : done + n] if len(block) >= done + n else block[done:]
            out = part.copy() if out is None else out[:n] * U64(power) + part[:n]
            done += length
        bits >>= 1
        if bits:
            block = block[:-length] * U64(power) + block[length:]
            power = power * power & (2**64 - 1)
            length *= 2
    return out[:n]


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to 0 .. n, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(CHUNK_BYTES * 2, n + 1)
        have = np.empty(size, U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have


class Spans:
    """Hashes of arbitrary slices of one array in constant time each."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(BASE, len(values))[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the leftmost position of its least one, by the upper 32 bits."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = (values & U64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=U64)
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if w > span:
        best = np.minimum(best[:n], best[w - span : w - span + n])
    return (best[:n] & U64(0xFFFFFFFF)).astype(np.int64)


# Words:
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each document, and the words before each document."""
    base = int(off[0])
    body = data[base : int(off[-1])]
    inside = ~SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[off - base] = True
    before = np.empty(len(body), bool)
    if len(body):
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    after = np.empty(len(body), bool)
    if len(body):
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
        after |= edge[1:]
    ends = np.flatnonzero(inside & after) + 1
    return starts + base, ends + base, np.searchsorted(starts + base, off)


# Packed shuffles:
def group_slices(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values of a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start .. start + count - 1 of all pairs, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[first] = starts
    out[first[1:]] -= starts[:-1] + counts[:-1] - 1
    return np.cumsum(out)


def over(spark_schema: str, work: Callable[[pa.RecordBatch], Iterable[dict]], after: Callable[[], object] = int, keep: object = None):
    """A function for ``mapInArrow`` that turns each batch into column dictionaries; ``after`` is called at the end of a task, and of the ``large`` values those of ``keep`` stay."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(spark_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_large(keep)
        for columns in (c for batch in batches for c in work(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
        after()
        give_back()

    return run


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as bytes: byte planes, compressed."""
    heads, planes = [], []
    for a in arrays:
        heads.append(f"{a.dtype.str}{len(a)}")
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = b"".join(planes)
    return f"{len(raw)};{','.join(heads)}\n".encode() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    cut = blob.index(b"\n")
    size, heads = blob[:cut].decode().split(";")
    raw = np.frombuffer(pa.decompress(blob[cut + 1 :], int(size), codec="zstd", asbytes=True) if int(size) else b"", np.uint8)
    out, at = [], 0
    for head in heads.split(","):
        kind, n = np.dtype(head[:3]), int(head[3:])
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def partition_keys(n: int) -> np.ndarray:
    """For each of ``n`` hash partitions an integer that Spark puts there, so that n keys fill n partitions evenly."""
    out = np.full(n, -1, np.int64)
    lo, step = 0, max(1024, 4 * n)
    u32 = np.uint32
    while (out < 0).any():
        ints = np.arange(lo, lo + step)
        with np.errstate(over="ignore"):
            k = ints.astype(u32) * u32(0xCC9E2D51)
            k = (k << u32(15) | k >> u32(17)) * u32(0x1B873593)
            h = u32(42) ^ k
            h = (h << u32(13) | h >> u32(19)) * u32(5) + u32(0xE6546B64)
            h ^= u32(4)
            h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
            h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
            h ^= h >> u32(16)
        at = h.view(np.int32).astype(np.int64) % n
        where, first = np.unique(at, return_index=True)
        new = out[where] < 0
        out[where[new]] = ints[first[new]]
        lo += step
    return out.astype(np.int32)
