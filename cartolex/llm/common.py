"""Shared pieces of the operators: cut points, size-checked joins, word hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when it has at most this many bytes, counted before the join.
BROADCAST_BYTES = 24 << 20

#: Text bytes that one numpy pass handles at a time.
CHUNK_BYTES = 512 << 10

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset and all run on this machine, as in
    tests, one of our own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (set_to or "/tmp/checkpoints").rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder; it goes when the program ends."""
    at = f"{shared_dir(spark)}/cartolex/{spark.sparkContext.applicationId}"
    if at not in _SESSIONS:
        _SESSIONS.add(at)
        atexit.register(_drop, spark, at)
    return at


_SESSIONS: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back, so that lost executors redo nothing before it."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Deletes the files of a table made by ``cut`` that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if its counted rows stay below the limit; beyond it the join shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Rows of whole texts that move together, from Parquet and to Python, and bytes that a writer holds back: texts may be long.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 1024, "parquet.block.size": 32 << 20}


def small_batches(spark: SparkSession) -> None:
    """Sets the session to batches that stay small whatever the length of texts, unless it has smaller ones."""
    for key, most in SMALL.items():
        if not 0 < int(spark.conf.get(key, None) or 0) <= most:
            spark.conf.set(key, str(most))


def trimmed() -> None:
    """What this process has let go of goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A task's work over batches, after which its worker, which may idle through other stages, holds nothing of it."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trimmed()

    return task


#: What operators keep in a Python worker between tasks, and how to let go of it.
KEPT: dict = {}


def working(name: str) -> None:
    """Called as a task's work begins: what other operators have kept in this worker, which Spark uses again, goes."""
    others = [drop for owner, drop in KEPT.items() if owner != name]
    if others:
        for drop in others:
            drop()
        for owner in [x for x in KEPT if x != name]:
            del KEPT[owner]
        trimmed()


def bit_table(keys: DataFrame, n: int, most_bits: int) -> np.ndarray:
    """A table of bits, 16 for each of n keys (column k, bigint) up to ``most_bits``, with the places of the keys set."""
    bits = 1 << min(max(16, int(16 * n).bit_length()), most_bits.bit_length() - 1)
    place = lambda batches: (pa.RecordBatch.from_arrays([pa.array(_place(b.column(0).to_numpy().view(np.uint64), bits))], ["p"]) for b in batches)
    words = keys.mapInArrow(place, "p bigint").groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    found = words.toArrow()  # at most most_bits / 64 rows, whatever the input
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy()] = found["b"].to_numpy()
    del found
    trimmed()
    return table


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(keys) & np.uint64(bits - 1)).astype(np.int64)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of keys are set: true for every key of the table and for few others."""
    at = _place(keys, 64 * len(table))
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return col.fill_null(b"") if col.null_count else col


def byte_chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of slices that hold about ``size`` bytes, one row at least."""
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray, bases: tuple[int, ...], lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words of each row, one array for each odd base, and the offsets of the rows' words.

    A word is a maximal run of bytes outside space and 0x09-0x0D; rows end words.
    """
    rows = len(off) - 1
    if not len(data):
        return [np.empty(0, np.uint64) for _ in bases], np.zeros(rows + 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] |= inside[edge]
    start = np.flatnonzero(first)
    bounds = np.searchsorted(start, off)
    if not len(start):
        return [np.empty(0, np.uint64) for _ in bases], bounds
    number = np.cumsum(first) - 1
    number[number < 0] = 0
    place = np.arange(len(data)) - start[number]
    place[~inside] = 0
    place[: start[0]] = 0
    longest = int(place.max()) + 1
    value = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    value[~inside] = 0
    out = []
    for base in bases:
        power = np.full(longest, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        out.append(mixed(np.add.reduceat(value * power[place], start)))
    return out, bounds


def window_hashes(word: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries, the caller drops those that cross rows."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(base)
        out += word[j : j + n]
    return mixed(out)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        lo = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], lo)
        np.minimum.at(new, root[b], lo)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
