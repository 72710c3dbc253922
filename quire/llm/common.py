"""What the operators of this subpackage share: the shared folder, and vectorised word scans."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quire.plans.lineage import compact, settled, shared_dir  # noqa: F401


#: Any odd number serves as base of the polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_of(spark: SparkSession, path: str):
    """The JVM's path and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = store_of(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path made by scratch()."""
    at, store = store_of(spark, path)
    store.delete(at, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keeps Arrow batches to about ``size`` bytes, unless the session has its own bound: texts
    vary from nothing to megabytes, so a number of rows bounds no worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Returns the memory that this process has freed to the system. Python workers stay from
    stage to stage, several to an executor, and the allocators of C and Arrow would keep in each
    what its largest batch took. Called where a task's last batch is done."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Powers:
    """base**0 .. base**(n-1) and the inverse powers modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = _powers(BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


POWERS = Powers()
#: Bytes hashed at once; powers are kept for as many.
SPAN = 1 << 18


def texts_to_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, joined, and len+1 offsets; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text's end: starts, ends, and how many
    runs begin before each offset."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < len(inside)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:] - 1
    at = at[at >= 0]
    last[at] = inside[at]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run, from prefix sums of byte times power; runs are
    taken in spans of about SPAN bytes so that the powers stay in cache."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        lo = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, lo + SPAN, "right")))
        n = int(ends[j - 1] - lo)
        up, down = POWERS.upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        s, e = starts[k:j] - lo, ends[k:j] - lo
        out[k:j] = (total[e] - total[s]) * down[s]
        k = j
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a finaliser of multiply and shift steps)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def segment_positions(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(begin, counts)
