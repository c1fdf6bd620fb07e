"""What the operators share: inputs, scratch tables, words and hash tables."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.files import open_read, open_write, qualified  # noqa: F401  used by the operators

#: Bytes that separate words: the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are worked on at a time, however long a text is.
PART = 1 << 20
_HASH_PART = 1 << 18

_SHIPPED: set[str] = set()
_OWN_ROOT: dict[str, str] = {}
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a single machine, as in tests, a temporary
    folder takes its place; on a cluster that is an error.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        # With its scheme, so that Python opens what Spark opens.
        return qualified(spark, root.rstrip("/"))
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN_ROOT:
        _OWN_ROOT[sc.applicationId] = tempfile.mkdtemp(prefix="driftline-")
    return _OWN_ROOT[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/driftline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and
    survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized frame that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run; those that its result doesn't read are deleted."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialize(df, label))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete some that no later plan reads."""
        for t in tables:
            discard(t)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]

    def close(self, *needed: DataFrame) -> None:
        for t in self.tables:
            if not any(t is n for n in needed):
                discard(t)
        self.tables = list(needed)


def numbered(df: DataFrame, id_col: str, *columns: str) -> tuple[DataFrame, bool]:
    """The columns and ``node``, a number of each row's own: its id, if all ids
    are there and differ (then False is returned too), else a row number,
    written once so that it stays the same."""
    ids = df.groupBy(id_col).agg(F.count("*").alias("n"))
    if ids.where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return df.select(*columns, F.col(id_col).alias("node")), False
    return materialize(df.select(*columns, F.monotonically_increasing_id().alias("node")), "numbered"), True


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    # The driver serves this file to the executors for as long as it runs.
    path = os.path.join(tempfile.mkdtemp(prefix="driftline-code-"), "driftline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    # Long texts: keep a batch of rows well within a Python worker's memory.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(df: DataFrame, piece: int = 128 << 20) -> int:
    """Into how many tasks to deal a frame: the session's shuffle partitions,
    or more where Spark's own estimate of its bytes asks for more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 62  # a plan without statistics claims the largest number
    return max(1, partitions(df.sparkSession), -(-size // piece) if known else 0)


#: What this Python worker keeps from task to task: one thing at a time, so
#: that a later job's tables take the place of an earlier one's.
_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` with the package shipped first. Give a function of a
    module, or a partial of one: it's sent by name, so that what its module
    keeps (tokenizers, caches) lasts from task to task."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_run, fn), schema)


def _run(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task, and afterwards its free memory back to the system: workers wait
    for their next task beside others that need it."""
    try:
        yield from fn(batches)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into runs of rows of about ``limit`` bytes of text, at least
    one row each, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_null(column.type):
            column = pa.nulls(len(column), pa.string())
        raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        data = raw.to_pylist()
        start, size = 0, 0
        for i, x in enumerate(data):
            if x is None:
                data[i] = x = b""
            if size and size + len(x) > limit:
                yield batch.slice(start, i - start), data[start:i]
                start, size = i, 0
            size += len(x) + 1
        if start < len(data):
            yield batch.slice(start), data[start:]


def parts(text: bytes, separators: np.ndarray = WHITE, limit: int = PART) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end after a separator: no
    run of other bytes is cut."""
    start, size = 0, len(text)
    if size <= limit:
        yield text
        return
    while start < size:
        end = min(start + limit, size)
        seen = start
        while end < size:
            at = np.flatnonzero(separators[np.frombuffer(text, np.uint8, end - seen, seen)])
            if len(at):
                end = seen + int(at[-1]) + 1
                break
            seen, end = end, min(end + limit, size)
        yield text[start:end]
        start = end


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _MULT), ("down", _INV)):
                out = np.full(size, base, dtype=np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up[:n], cls.down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte spans; equal bytes give equal hashes
    anywhere.

    A polynomial hash modulo 2**64 from one running sum: the base is odd, so
    its powers can be divided out again. Spans are taken a part of the bytes at
    a time, so the sums stay small.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + _HASH_PART)))
        s, e = starts[at:to] - low, ends[at:to] - low
        own = data[low : int(ends[at:to].max())]
        up, down = Powers.get(len(own) + 1)
        total = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * down[: len(own)], out=total[1:])
        raw = (total[e] - total[s]) * up[s]
        out[at:to] = mix64(raw + (e - s).astype(np.uint64) * np.uint64(_MULT))
        at = to
    return out


def words(data: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[bytes], separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased (A-Z) texts, and offsets: the
    words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    if len(texts) == 1 and len(texts[0]) > PART:  # as slices() gives long texts
        found = np.concatenate([_word_hashes([p], separators)[0] for p in parts(texts[0], separators)])
        return found, np.array([0, len(found)])
    return _word_hashes(texts, separators)


def _word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    starts, ends = words(data, separators)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


class HashTable:
    """Map from uint64 keys to numbers, probed and filled by whole arrays."""

    EMPTY = np.uint64(_MASK)

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0) -> None:
        self.size = 0
        self._room(max(len(keys), room), values.dtype)
        self.add(keys, values)

    def _room(self, n: int, dtype: np.dtype) -> None:
        self.bits = max(4, int(np.ceil(np.log2(1.25 * max(1, n)))))
        self.keys = np.full(1 << self.bits, self.EMPTY, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=dtype)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_MULT)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in distinct keys that aren't there yet."""
        if 1.2 * (self.size + len(keys)) > len(self.keys):
            full = self.keys != self.EMPTY
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.size = 0
            self._room(2 * len(keys), self.values.dtype)
        self.size += len(keys)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where the keys were found."""
        slot = self._slot(keys)
        have = self.keys[slot]
        found = have == keys
        out = np.where(found, self.values[slot], np.asarray(default, dtype=self.values.dtype))
        at = np.flatnonzero(~found & (have != self.EMPTY))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot]
            hit = have == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            found[at[hit]] = True
            more = ~hit & (have != self.EMPTY)
            at, slot = at[more], slot[more]
        return out, found


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... restarted for each run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_column(flat: np.ndarray, width: int) -> pa.Array:
    """A list column of fixed-width rows."""
    n = len(flat) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(flat))
