"""Text batches as numpy arrays, and tables kept in the shared folder.

Texts travel as Arrow batches. A batch is cut into slices of a few MB, so a task's memory does not depend on
how many rows Spark puts in a batch; one text longer than that is a slice of its own and is never cut.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

SLICE_BYTES = 3 << 20
PARITY_ROWS = 4096
U = np.uint64
_C1, _C2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Workspace:
    """A folder for intermediate tables inside spark.checkpoint.dir, which every executor sees; it goes when Python ends.

    Only where that setting is missing (tests, one machine) a temporary folder stands in. tidy: shuffles of a kept
    table are removed as soon as it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
            root = _local_root()
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/tributary-{name}-{uuid.uuid4().hex[:12]}", 0
        self.tidy = tidy
        _MADE.append(self)

    def remove(self) -> None:
        """Deletes the folder; DataFrames that read its tables can't be used after that."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df as Parquet and returns the written table: lineage ends there and lost executors cost nothing."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with _setting(self.spark, CLEANUP, "true") if self.tidy else contextlib.nullcontext():
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Queries remove their shuffle files when they end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries that run inside have this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Queries that run inside send BATCH_ROWS rows to a Python worker at once, so that it and the JVM hold few texts."""
    rows = int(spark.conf.get(ARROW_ROWS))
    return _setting(spark, ARROW_ROWS, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


#: Workspaces that have not been removed.
_MADE: list[Workspace] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Removes the workspaces that are made inside, at the end: for work whose result has been written by then."""
    before = len(_MADE)
    yield
    for ws in _MADE[before:]:
        ws.remove()
    del _MADE[before:]


@atexit.register
def _remove_all() -> None:
    for ws in _MADE:
        with contextlib.suppress(Exception):
            ws.remove()


_ROOT: list[str] = []


def _local_root() -> str:
    if not _ROOT:
        _ROOT.append("file://" + tempfile.mkdtemp(prefix="tributary-"))
    return _ROOT[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: The largest table that is broadcast, by bytes; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def hinted(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows take BROADCAST_BYTES at most. Its bytes are counted, not guessed."""
    width, measured = 48, []  # what a hash table has for each row

    def add(c: Column, kind: DataType) -> None:
        nonlocal width
        if isinstance(kind, StructType):
            width += 8
            for f in kind.fields:
                add(c[f.name], f.dataType)
        elif isinstance(kind, ArrayType):
            width += 24
            measured.append(F.size(c) * 8 if not isinstance(kind.elementType, (StringType, BinaryType)) else F.aggregate(c, F.lit(0), lambda n, x: n + 16 + F.octet_length(x)))
        elif isinstance(kind, (StringType, BinaryType)):
            width += 16
            measured.append(F.octet_length(c))
        else:
            width += 8

    for f in df.schema.fields:
        add(df[f.name], f.dataType)
    n, more = df.agg(F.count("*"), F.sum(sum((F.coalesce(m, F.lit(0)) for m in measured), F.lit(0).cast("long")))).first()
    return F.broadcast(df) if n * width + (more or 0) <= BROADCAST_BYTES else df


def conflicting_ids(ws: Workspace, rows: DataFrame, value: str) -> DataFrame | None:
    """Ids whose rows differ in value, or None if there are none. rows: id and value."""
    odd = ws.keep(rows.where("id is not null").groupBy("id").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi").select("id"), "conflicts")
    return None if odd.isEmpty() else odd


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser); works in place on a fresh copy."""
    x = x ^ (x >> U(30))
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and their n + 1 offsets. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def trim_memory() -> None:
    """Gives back to the system what this worker has freed, which its allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_encoders() -> None:
    """Frees what a reused worker still holds of the tokenizers of an earlier job."""
    if sys.__dict__.pop("_tributary_encoders", None):
        gc.collect()
        trim_memory()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, encoders: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches' rows in the same order, in record batches of at most `limit` bytes of text (or one row).

    encoders: the caller uses a tokenizer; else workers forget theirs.
    """
    if not encoders:
        release_encoders()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = raw(batch.column(column))[1]
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = j
        del at, batch  # else it is held while the next one is read
    trim_memory()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for text i its first word's number at i (n + 1 entries)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[at[1:][at[:-1] < at[1:]] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
    length = ends - starts
    h = mix(length.astype(U) * GOLD + (eight[starts] & masks[np.minimum(length, 8)]))
    left, k = np.flatnonzero(length > 8), 8
    while len(left):
        part = eight[starts[left] + k] & masks[np.minimum(length[left] - k, 8)]
        h[left] = mix(h[left] * GOLD + part)
        k += 8
        left = left[length[left] > k]
    return h


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct k-word shingles, sorted, with offsets by text.

    A text with fewer words has its whole sequence as the one shingle; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, at)
    w = span_hashes(data, starts, ends)
    n, count = len(w), np.diff(first)
    h = w.copy()
    for j in range(1, k):
        h[: n - j] = mix(h[: n - j] * GOLD + w[j:])
    parts, sizes = [], np.zeros(len(count), np.int64)
    for i, (f, c) in enumerate(zip(first[:-1].tolist(), count.tolist())):
        if c >= k:
            s = np.sort(h[f : f + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif c:
            one = w[f : f + 1].copy()
            for j in range(1, c):
                one = mix(one * GOLD + w[f + j : f + j + 1])
            s = mix(one + U(c))
        else:
            continue
        sizes[i] = len(s)
        parts.append(s)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])


def parities(values: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap for each list of hashes, as bits / 64 words: a bit is set if an odd number of its hashes fall on it.

    Two lists' bitmaps differ in no more bits than there are values in one list only, so the number of differing
    bits bounds that difference from below, whatever the hashes are.
    """
    n = len(at) - 1
    if n > PARITY_ROWS:
        parts = [(i, min(i + PARITY_ROWS, n)) for i in range(0, n, PARITY_ROWS)]
        return np.concatenate([parities(values[at[i] : at[j]], at[i : j + 1] - at[i], bits) for i, j in parts])
    cell = (values >> U(64 - bits.bit_length() + 1)).astype(np.int64) + np.repeat(np.arange(n) * bits, np.diff(at))
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").reshape(n, bits // 64)


def longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def pack(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Structured rows with a field "key" as one binary value for each part of the range of keys that has any."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    part = ((rows["key"] >> U(32)) * U(parts)) >> U(32)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(rows))
    return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array([rows[b:e].tobytes() for b, e in zip(begin.tolist(), ends.tolist())], pa.binary())], ["part", "rows"])


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All rows that a task got."""
    got = [np.frombuffer(x, dtype) for b in batches for x in b.column("rows").to_pylist()]
    return np.concatenate(got) if got else np.zeros(0, dtype)
