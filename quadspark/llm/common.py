"""What the training-data operators share: shared storage, row keys and text chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once (a single longer text is a step of its own).
CHUNK_BYTES = 1 << 20

#: The white space of all word and line contracts here: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that pass to Python at once: whole texts, so far fewer than Spark's default of 10,000.
BATCH_ROWS = "500"


def small_batches(spark: SparkSession) -> None:
    """Bounds what an Arrow batch holds, in the JVM and in the Python worker, unless the session asks for less."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine (tests)."""
    small_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quadspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask."""
    return F.translate(c, UPPER, LOWER)


def rotl(x: Column, n: int) -> Column:
    return x if n % 64 == 0 else F.shiftleft(x, n % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - n % 64))


def give_back() -> None:
    """Returns what this process has freed to the operating system: Arrow's pool, malloc's free lists, the tables of powers."""
    global _powers
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with give_back after each task: idle workers stay, several for each core of an executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each value of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [x or b"" for x in column.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


def in_chunks(values: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of values of about `most` bytes; every value is in one range."""
    at = held = 0
    for i, v in enumerate(values):
        if i > at and held + len(v) > most:
            yield at, i
            at, held = i, 0
        held += len(v)
    if at < len(values):
        yield at, len(values)


# --- words of many texts at once -------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        _powers = out[0], out[1]
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(values: list[bytes], fold: np.ndarray = _FOLD, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, A-Z lower-cased: (64-bit hash, text number, first byte, end byte) of each, in order.

    The hash is a polynomial over the word's bytes, from prefix sums, so the cost is a few array operations a byte.
    Byte positions count from the start of the word's own text.
    """
    joined = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    lens = np.fromiter(map(len, values), np.int64, len(values))
    starts = np.cumsum(lens + 1) - (lens + 1)
    blank = space[joined]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    first, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((fold[joined].astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=sums[1:])
    h = mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    of = np.searchsorted(starts, first, side="right") - 1
    return h, of, first - starts[of], end - starts[of]
