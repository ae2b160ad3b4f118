"""What the operators of this package share: tables, stage storage, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators import storage
from ..operators.storage import discard, settled, shared_dir  # noqa: F401  for the operators

#: Bytes of text that the vectorised kernels look at together.
SLICE_BYTES = 1 << 20

#: Bytes of a batch that crosses to Python, about: a task holds it twice in the JVM's own memory, and its worker once.
BATCH_BYTES = 4 << 20

#: ASCII white space: the complement of ``[^\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that cross to Python in this session, unless they are bounded lower."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() not in range(1, BATCH_BYTES + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """df in the shared folder, read again."""
    small_batches(df.sparkSession)
    return storage.stored(df, name)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of consecutive runs of about limit bytes; null counts as empty. No more than a run is copied at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    end = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        stop = min(int(np.searchsorted(end, (end[first - 1] if first else 0) + limit)) + 1, len(column))
        yield first, [x or b"" for x in column.slice(first, stop - first).cast(pa.large_binary()).to_pylist()]
        first = stop


def released(run):
    """run (on an iterator of batches), giving the memory that it has freed back to the system at its end: workers live on."""

    @wraps(run)
    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # so that trimming reaches it
        try:
            yield from run(batches)
        finally:
            batches = None
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_power = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 64, 2 * len(_power)), np.uint64(0x5851F42D4C957F2D))
        steps[0] = 1
        _power = np.cumprod(steps, dtype=np.uint64)
    return _power[:n]


def words_of(docs: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts: the joined bytes, each word's start and end in them, and the first word of each text.

    The last array has one entry more than texts."""
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    inside = ~space[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))
    first = np.concatenate(([0], np.searchsorted(starts, at)))
    return buf, starts, ends, first


#: Bytes of words that are hashed together: what is held for each is some thirty times as much.
HASHED = 1 << 18


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same everywhere."""
    lens = ends - starts
    out, total, a = np.empty(len(starts), np.uint64), np.cumsum(lens), 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HASHED, side="right")))
        part = lens[a:z]
        begin = np.cumsum(part) - part
        pos = np.arange(int(part.sum())) - np.repeat(begin, part)
        bytes_ = buf[pos + np.repeat(starts[a:z], part)]
        out[a:z] = mixed(np.add.reduceat(_BYTE[bytes_] * _powers(int(part.max()))[pos], begin) + part.astype(np.uint64))
        a = z
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes (len(h) - k + 1 of them)."""
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = (s ^ (s >> np.uint64(29))) * _GOLD + h[j : len(h) - k + 1 + j]
    return mixed(s)


def spans_of(values: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The part of values that belongs to each text."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield values[a:b]
