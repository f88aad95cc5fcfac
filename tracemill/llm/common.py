"""Shared pieces: durable materialisation, bounded Arrow batches, and byte-level text kernels on whole batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, and Spark runs in this process, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="tracemill-")
    return shared_dir.own


ROW_GROUP = 16 << 20  # bytes that a Parquet writer holds back
ARROW_BYTES = 4 << 20  # of an Arrow batch, unless a row alone is larger
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
_written: dict[str, SparkSession] = {}


def new_path(spark: SparkSession) -> str:
    """Where a table may be written; what is there goes when this Python process ends."""
    path = f"{shared_dir(spark)}/tracemill-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, and not lost with an executor.

    The table goes with discard(), or else when this Python process ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracemill_path = path
    return out


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be over
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes what stored() wrote for these tables. Nothing that is yet to run may read them."""
    for t in tables:
        _remove(t.__dict__.get("_tracemill_path", ""))


atexit.register(lambda: [_remove(path) for path in list(_written)])


def lean(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: 10,000 rows of long texts would take most of an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key, "64m").lower())
    if m and int(m[1]) * _UNITS[m[2]] > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def tidy() -> None:
    """Gives memory that this worker has freed back to the system; a reused worker else keeps the most that it ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then tidy()."""

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = 1 << 18):
    """Ranges of rows of about `most` bytes; a longer text has a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_R.integers(2**40, 2**62)) * 2 + 1
_PLACE = [int(x) * 2 + 1 for x in _R.integers(2**40, 2**62, 16)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= 1 << 20:  # longer texts have tables of their own
            _POWERS[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: np.ndarray | None = None):
    """Words between ASCII white space (or of the bytes in `letters`) of consecutive rows.

    data, offsets: as of raw(), rows first..last only. Returns starts, ends (into data), row of each word, 64-bit hash of each.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    if not len(b):
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    inside = ~SPACE[b] if letters is None else letters[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[(offsets - base)] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    rows = np.searchsorted(offsets - base, starts, "right") - 1
    value = _BYTE[LOWER[b] if lower else b]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value * _powers(_BASE, len(b))[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(b))[starts]
    return starts + base, ends + base, rows, mixed(h + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Per row, the sorted distinct 64-bit hashes of its `width`-word shingles (lower-cased A-Z; fewer words: the whole sequence as one)."""
    _, _, rows, h = words(data, offsets, lower=True)
    n = len(offsets) - 1
    bounds = np.searchsorted(rows, np.arange(n + 1))
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, np.uint64)
    for j in range(width):
        s += mixed(h[j : j + m] + np.uint64(j)) * np.uint64(_PLACE[j])
    s = mixed(s + np.uint64(width))
    for i in range(n):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= width:
            yield np.unique(s[lo : hi - width + 1])
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for j in range(hi - lo):
                x = x + mixed(h[lo + j : lo + j + 1] + np.uint64(j)) * np.uint64(_PLACE[j])
            yield mixed(x)
        else:
            yield np.zeros(0, np.uint64)
