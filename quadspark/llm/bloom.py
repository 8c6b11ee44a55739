"""Bloom filters that tasks build apart and merge bit by bit: of hashes seen once, and of those seen twice.

twice = twice1 | twice2 | (once1 & once2), once = once1 | once2, so what two tasks hold, or one holds twice, has all its bits
in the merged `twice` filter: no false negatives. A filter has the size it is given (`bits`), which bounds what is broadcast; a fuller
filter lets more through to the exact step that follows and loses nothing. Hashes are longs; null hashes are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from .common import released

BITS = 1 << 26
SHARDS, PROBES = 64, 3


def _positions(h: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit in it) of the PROBES positions of each hash, by double hashing."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        at = (h + np.uint64(i) * step) & np.uint64(bits - 1)
        yield (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def _add(words: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at, bit in _positions(h, bits):
        np.bitwise_or.at(words, at, np.uint64(1) << bit)


def _packed(words: np.ndarray) -> bytes:
    return pa.compress(words.tobytes(), codec="lz4", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="lz4", asbytes=True), np.uint64)


def _rows(s: int, *data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["shard", "once", "twice"][: 1 + len(data)])


def _of_task(bits: int):
    n = bits // 64 // SHARDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            if once is None:
                once, twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
            h, times = np.unique(h, return_counts=True)
            before = np.ones(len(h), bool)
            for at, bit in _positions(h, bits):
                before &= (once[at] >> bit) & np.uint64(1) == 1
            _add(twice, h[(times > 1) | before], bits)
            _add(once, h, bits)
        if once is not None:
            for s in range(SHARDS):
                part = slice(s * n, s * n + n)
                if once[part].any():
                    yield _rows(s, _packed(once[part]), _packed(twice[part]))

    return run


def _merged(bits: int):
    n = bits // 64 // SHARDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = _unpacked(x, n), _unpacked(y, n)
                once, twice = held.get(s, (np.zeros(n, np.uint64),) * 2)
                held[s] = once | x, twice | y | (once & x)
        for s, (once, twice) in held.items():
            yield _rows(s, _packed(once), _packed(twice))

    return run


class Filter:
    """A merged filter, broadcast; `passes` is a column function."""

    def __init__(self, hashes: DataFrame, kind: str, bits: int = BITS):
        """hashes: a DataFrame of one long column; bits / 8 bytes at most come to the driver."""
        parts = hashes.mapInArrow(released(_of_task(bits)), "shard int, once binary, twice binary").repartition(SHARDS, "shard")
        self.words, self.bits, n = np.zeros(bits // 64, np.uint64), bits, bits // 64 // SHARDS
        for r in parts.mapInArrow(released(_merged(bits)), "shard int, once binary, twice binary").select("shard", kind).toLocalIterator():
            self.words[r["shard"] * n : r["shard"] * n + n] = _unpacked(bytes(r[kind]), n)
        held = hashes.sparkSession.sparkContext.broadcast(self.words)

        @pandas_udf("boolean")
        def passes(h: pd.Series) -> pd.Series:
            h, words, ok = h.to_numpy(np.int64), held.value, np.ones(len(h), bool)
            for at, bit in _positions(h, bits):
                ok &= (words[at] >> bit) & np.uint64(1) == 1
            return pd.Series(ok)

        self.passes = passes
