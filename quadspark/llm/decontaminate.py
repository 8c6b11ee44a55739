"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

1. Every K-word shingle of every text is looked up among the items' shingles. Similarity at least THRESHOLD asks that the
   shingles shared with an item weigh THRESHOLD of all that the window has, so a window whose shingles of any items weigh
   less is no candidate, whatever the item. This needs no more than running sums.
2. Each other window of as many words as some item has gets a SimHash fingerprint of BITS bits. Every shingle occurrence has
   BITS pseudorandom normal numbers, times the square root of its weight, and a bit is the sign of their sum over the window
   (a random hyperplane). Two bags of weighted similarity s have a cosine of at least 2 s / (1 + s) then, whatever the
   weights are: 8/9 at 0.8, so a bit differs with probability 0.1515 at most. Of 128 bits, more than RADIUS = 40 differ
   with probability 1e-6.
3. Fingerprints of windows and of items of the same size meet in a multi-index of RADIUS + 1 blocks of bits: two fingerprints
   at most RADIUS apart agree in one block at least, so all of them are found.
4. Each candidate is compared exactly: sum of min(counts) * weight over sum of max(counts) * weight.

Two weightings are used, with fingerprints each, and a window that reaches THRESHOLD in either is a leak. In the first a shingle
of the benchmark weighs 1 / (items of the whole benchmark that have it) and another 1, so that copies of an item's own words
count although its template was changed. In the second all weigh 1, so that near copies of items that repeat or share a
template are found. The similarity reported is the first where that reaches THRESHOLD, and otherwise the second.

The items that have a shingle are counted by a shuffle. The benchmark goes to the executors in blocks of about
ITEM_BYTES of text, with the counts of the block's own shingles; each block is a pass over the documents, and with more than
one block, passes are written to the shared folder, so one block is held at a time. Texts are worked off in pieces of
PIECE_WORDS words that overlap by the largest item, so memory depends on neither the text's nor the benchmark's size.

Nulls and ties: null or blank texts and items match nothing. An item of fewer than K words matches only documents of exactly
its words. A document shorter than the item is one window. Of windows equally like an item the
leftmost is reported. Rows of equal doc_id or item_id are handled one by one. A-Z are lower-cased; words are runs without
white space. A column `leaks` of the documents is replaced by leaks();
clean() keeps all columns as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, mix64, released, small_batches, stored, table, texts, word_hashes

K, THRESHOLD, RADIUS, BITS = 5, 0.8, 40, 128
ITEM_BYTES, PIECE_WORDS = 8 << 20, 1 << 14
#: Windows that are fingerprinted at once.
WINDOWS = 1 << 12
#: More than the running sums can be off.
_EPS = 1e-6
_U = np.uint64


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[j : j + len(out)] + _U(j))
    return out


# --- fingerprints ----------------------------------------------------------------------------------------------------

_normal: np.ndarray | None = None


def normals(shingles: np.ndarray) -> np.ndarray:
    """(shingles, BITS) standard normal numbers, from a table of 4,096 quantiles that hash bits point into."""
    global _normal
    if _normal is None:
        _normal = np.array([NormalDist().inv_cdf((i + 0.5) / 4096) for i in range(4096)], np.float32)
    out = np.empty((len(shingles), BITS), np.float32)
    for j in range(0, BITS, 4):
        x = mix64(shingles + _U((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        for i in range(4):
            out[:, j + i] = _normal[((x >> _U(16 * i + 4)) & _U(4095)).astype(np.int64)]
    return out


class Windows:
    """The windows of shingles x (uint64) with weights: bags that are equal have equal keys, and fingerprints are made on demand.

    Sums over windows are differences of running sums. A window that has a shingle twice is summed by itself, as the n-th
    occurrence of a shingle in a bag has numbers of its own: so bags are compared as bags, however often a shingle stands in them.
    """

    def __init__(self, x: np.ndarray, weights: np.ndarray):
        self.x, self.root = x, np.sqrt(weights)
        self.running: np.ndarray | None = None
        self.keys = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x + _U(0x5851F42D4C957F2D)), dtype=np.uint64)])
        order = np.argsort(x, kind="stable")
        again = np.full(len(x) + 1, len(x) + 1, np.int64)
        same = np.flatnonzero(x[order][1:] == x[order][:-1])
        again[order[same]] = order[same + 1]
        self.repeat = np.minimum.accumulate(again[::-1])[::-1]  # the first place from here on where a shingle stands again

    def distinct(self, begins: np.ndarray, m: int) -> np.ndarray:
        """The leftmost of the windows with equal bags, in order."""
        _, first = np.unique(self.keys[begins + m] - self.keys[begins], return_index=True)
        return begins[np.sort(first)]

    def fingerprints(self, begins: np.ndarray, m: int) -> np.ndarray:
        """(windows, BITS / 8) of the windows of m shingles from `begins` on."""
        if self.running is None:
            self.running = np.zeros((len(self.x) + 1, BITS))
            np.cumsum(normals(mix64(self.x)) * self.root[:, None], axis=0, out=self.running[1:])
        sums = self.running[begins + m] - self.running[begins]
        for i in np.flatnonzero(self.repeat[begins] < begins + m).tolist():
            part = slice(int(begins[i]), int(begins[i]) + m)
            order = np.argsort(self.x[part], kind="stable")
            s = self.x[part][order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            nth = np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))
            own = np.where(nth > 0, mix64(mix64(s) + nth.astype(np.uint64)), mix64(s))
            sums[i] = self.root[part][order] @ normals(own)
        return np.packbits(sums > 0, axis=1)


class MultiIndex:
    """Fingerprints (n, BITS / 8 bytes) under radius + 1 blocks of bits: all within the radius of a query agree in a block."""

    #: Pairs whose blocks are compared at once; of more, those that agree in a block are looked up in sorted values.
    AT_ONCE = 1 << 14

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.radius, self.cuts = radius, np.linspace(0, BITS, radius + 2).astype(int)[:-1]
        self.power = np.concatenate([1 << np.arange(n) for n in np.diff(np.append(self.cuts, BITS))])
        self.bits = np.unpackbits(fingerprints, axis=1)
        self.values, self.order = self._values(self.bits), None

    def _values(self, bits: np.ndarray) -> np.ndarray:
        """(fingerprints, blocks): each block's bits as a number."""
        return np.add.reduceat(bits * self.power, self.cuts, axis=1)

    def _sharing(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, fingerprint number) of all pairs that agree in a block."""
        n = len(self.values)
        if len(values) * n <= self.AT_ONCE:
            return np.nonzero((values[:, None] == self.values[None]).any(2))
        if self.order is None:
            self.order = np.argsort(self.values, axis=0, kind="stable")
        found = np.zeros(0, np.int64)
        for v, of, order in zip(values.T, self.values.T, self.order.T, strict=True):
            lo, hi = np.searchsorted(of[order], v, "left"), np.searchsorted(of[order], v, "right")
            many = hi - lo
            row = np.repeat(np.arange(len(v)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            found = np.union1d(found, row * n + order[at])
        return found // n, found % n

    def within(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, fingerprint number) of all pairs at most radius bits apart."""
        bits = np.unpackbits(fingerprints, axis=1)
        row, item = self._sharing(self._values(bits))
        ok = (bits[row] != self.bits[item]).sum(1) <= self.radius
        return row[ok], item[ok]


# --- a block of the benchmark ----------------------------------------------------------------------------------------


class Benchmark:
    """Items as (id, text), ready to be looked for; counts: (shingles, how many items of the whole benchmark have each)."""

    def __init__(self, items: list[tuple[int, str | None]], counts: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.bags, self.short = [], [], defaultdict(list)
        hashes = []
        for i, t in items:
            h = word_hashes([(t or "").encode()])[0]
            if len(h) >= K:
                self.ids.append(i)
                hashes.append(rolled(h, K))
                self.bags.append(Counter(hashes[-1].tolist()))
            elif len(h):
                self.short[tuple(h.tolist())].append(i)
        held = [np.unique(h) for h in hashes]
        self.sorted, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        if counts is not None and len(counts[0]) and len(self.sorted):
            place = np.minimum(np.searchsorted(counts[0], self.sorted), len(counts[0]) - 1)
            n = np.where(counts[0][place] == self.sorted, counts[1][place], 1)
        self.sorted_weight = 1.0 / n
        self.weight = dict(zip(self.sorted.tolist(), self.sorted_weight.tolist(), strict=True))
        self.total = np.array([sum(c * self.weight[s] for s, c in b.items()) for b in self.bags])
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.sorted >> _U(44)).astype(np.int64)] = True
        # items of a size, by number, and the fingerprints of both weightings under a multi-index
        self.of_size = {int(m): np.flatnonzero(self.size == m) for m in np.unique(self.size)}
        self.index, self.prints = {}, np.empty((2, len(self.ids), BITS // 8), np.uint8)
        for n, h in enumerate(hashes):
            w = self.sorted_weight[np.searchsorted(self.sorted, h)]
            for k, weights in enumerate((w, np.ones(len(h)))):
                self.prints[k, n] = Windows(h, weights).fingerprints(np.zeros(1, np.int64), len(h))[0]
        self.widest = max([*self.of_size, 0]) + K - 1

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the benchmark shingle) of all shingles of x that items have."""
        at = np.flatnonzero(self.maybe[(x >> _U(44)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        n = np.minimum(np.searchsorted(self.sorted, x[at]), len(self.sorted) - 1)
        ok = self.sorted[n] == x[at]
        return at[ok], n[ok]

    def similarity(self, window: np.ndarray, item: int) -> tuple[float, float]:
        """Weighted, and with all weights 1."""
        bag, same, both = self.bags[item], 0.0, 0
        mine, total = Counter(window.tolist()), 0.0
        for s, c in mine.items():
            w, m = self.weight.get(s, 1.0), min(c, bag.get(s, 0))
            total += c * w
            same += m * w
            both += m
        return float(same / (total + self.total[item] - same)), both / (len(window) + int(self.size[item]) - both)

    def _near(self, k: int, sizes: list[int], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of fingerprints near those of items of the sizes, in weighting k."""
        key = (k, *sizes)
        if key not in self.index:
            items = np.concatenate([self.of_size[m] for m in sizes])
            if len(sizes) > 1:  # only for texts shorter than items; not kept, as there are many such keys
                row, n = MultiIndex(self.prints[k][items], RADIUS).within(prints)
                return row, items[n]
            self.index[key] = MultiIndex(self.prints[k][items], RADIUS), items
        index, items = self.index[key]
        row, n = index.within(prints)
        return row, items[n]

    def matches(self, x: np.ndarray, at: np.ndarray, n: np.ndarray, whole: bool, best: tuple[dict, dict], offset: int = 0) -> None:
        """Puts (similarity, first word, words) of the best windows by item into best, for shingles x with hits n at positions at.
        whole: x is all the text has, so items longer than it are compared with all of it."""
        hit = np.zeros(len(x))
        weights = np.ones(len(x))
        hit[at], weights[at] = 1, self.sorted_weight[n]
        sums = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        hits, hit_weights, total = sums(hit), sums(hit * weights), sums(weights)
        most = len(at) / THRESHOLD + _EPS  # of more shingles than that a window hasn't THRESHOLD that hit, in either weighting
        tried = [(m, [m]) for m in self.of_size if m <= len(x) and m <= most]
        windows = [Windows(x, weights), Windows(x, np.ones(len(x)))] if tried or whole else []
        if whole and (longer := [m for m in self.of_size if len(x) < m <= len(x) / THRESHOLD + _EPS or len(x) < m and self._lighter(m, len(x))]):
            tried.append((len(x), longer))
        for m, sizes in tried:
            for k, (have, of) in enumerate(((hit_weights, total), (hits, np.arange(len(x) + 1.0)))):
                begins = windows[k].distinct(np.flatnonzero(have[m:] - have[:-m] >= THRESHOLD * (of[m:] - of[:-m]) - _EPS), m)
                for part in np.split(begins, range(WINDOWS, len(begins), WINDOWS)):
                    if not len(part):
                        continue
                    row, items = self._near(k, sizes, windows[k].fingerprints(part, m))
                    for a, i in zip(part[row].tolist(), items.tolist(), strict=True):
                        s = self.similarity(x[a : a + m], i)[k]
                        if s >= THRESHOLD and (s, -a - offset) > best[k].get(i, (0.0, 0))[:2]:
                            best[k][i] = (s, -a - offset, m + K - 1)

    def _lighter(self, m: int, n: int) -> bool:
        """Whether items of m shingles can have so light ones that n shingles weigh THRESHOLD of them."""
        return bool((self.total[self.of_size[m]] * THRESHOLD <= n + _EPS).any())


def _found(b: Benchmark, values: list[bytes]) -> list[list[tuple[int, float, int, int]]]:
    """(item id, similarity, first word, words) of the leaks of each text."""
    out: list[list] = []
    for a, z in in_chunks(values):
        h, of, _, _ = word_hashes(values[a:z])
        x = rolled(h, K)
        at, n = b.hits(x)
        ok = of[at] == of[np.minimum(at + K - 1, len(of) - 1)]
        at, n = at[ok], n[ok]
        ends = np.searchsorted(of, np.arange(z - a), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        lo, hi = np.searchsorted(at, begins), np.searchsorted(at, ends)
        for p, q, i, j in zip(begins, ends, lo, hi, strict=True):
            best: tuple[dict, dict] = ({}, {})
            if b.short and 0 < q - p < K:
                out.append([(i, 1.0, 0, int(q - p)) for i in b.short.get(tuple(h[p:q].tolist()), ())])
                continue
            if j > i:
                size, step = q - p - K + 1, PIECE_WORDS
                for c in range(0, size, step):
                    d = min(size, c + step + b.widest)
                    u, v = np.searchsorted(at[i:j], (p + c, p + d)) + i
                    if v > u:
                        for e, f, s, t in _regions(at[u:v] - p - c, d - c, b.widest):
                            b.matches(x[p + c + e : p + c + f], at[u + s : u + t] - p - c - e, n[u + s : u + t], size == f - e, best, int(c + e))
            found = best[1] | best[0]
            out.append([(b.ids[i], found[i][0], -found[i][1], found[i][2]) for i in sorted(found)])
    return out


def _regions(at: np.ndarray, size: int, wide: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first hit, end of hits): parts of a text around hits that no window spans two of."""
    cuts = np.flatnonzero(np.diff(at) > 2 * wide) + 1
    for s, t in zip([0, *cuts], [*cuts, len(at)], strict=True):
        yield max(0, int(at[s]) - wide), min(size, int(at[t - 1]) + wide), s, t


# --- tables ----------------------------------------------------------------------------------------------------------


def item_shingles(items: DataFrame) -> DataFrame:
    """(block, shingle), distinct for each item, of items (block, item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, t in zip(b.column("block").to_pylist(), texts(b.column("text")), strict=True):
                s = np.unique(rolled(word_hashes([t])[0], K)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), block, np.int32)), pa.array(s)], ["block", "shingle"])

    return items.select("block", "text").mapInArrow(released(run), "block int, shingle long")


def blocks_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Items with a block number, (block, shingle, n) of shingles that several items have, and how many blocks there are."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size, rows = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    many = max(1, min(-(-(size or 0) // ITEM_BYTES), rows))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)).cast("int"))
    if many > 1:
        items = stored(items, "items")
    shingles = item_shingles(items)
    often = shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    if many == 1:
        return items, often.withColumn("block", F.lit(0)), 1
    often = stored(shingles.distinct().join(often, "shingle"), "often")
    return items, often, many


def _block(items: DataFrame, often: DataFrame, i: int) -> Benchmark:
    """Block i, about ITEM_BYTES of text and the counts of its shingles."""
    rows = [(r["item_id"], r["text"]) for r in items.filter(F.col("block") == i).select("item_id", "text").collect()]
    found = sorted((r["shingle"] % (1 << 64), r["n"]) for r in often.filter(F.col("block") == i).select("shingle", "n").collect())
    return Benchmark(rows, (np.array([s for s, _ in found], np.uint64), np.array([n for _, n in found], np.int64)))


_KIND = "array<struct<item_id: bigint, similarity: double, first_word: bigint, words: bigint>>"
_FIELDS = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())]))


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def _rows(found: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("item_id", "similarity", "first_word", "words"), m, strict=True)) for m in f] for f in found], _FIELDS)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with `leaks`, an array of (item_id, similarity, first_word, words); docs must have a text column."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("leaks").withColumn("leaks", F.array().cast(_KIND))
    items, often, many = blocks_of(benchmark)

    def one_pass(docs: DataFrame, i: int) -> DataFrame:
        held, names = spark.sparkContext.broadcast(_block(items, often, i)), docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = _rows(_found(held.value, texts(b.column("text"))))
                yield pa.RecordBatch.from_arrays([*b.columns, rows], [*names, "_more"])

        out = docs.mapInArrow(released(run), f"{_schema(docs)}, `_more` {_KIND}")
        return out.withColumn("leaks", F.concat("leaks", "_more")).drop("_more")

    for i in range(many):
        docs = one_pass(docs, i) if many == 1 else stored(one_pass(docs, i), "leaks")
    return docs


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns; docs must have a text column."""
    spark = docs.sparkSession
    small_batches(spark)
    items, often, many = blocks_of(benchmark)
    schema = docs.schema

    def one_pass(docs: DataFrame, i: int) -> DataFrame:
        held = spark.sparkContext.broadcast(_block(items, often, i))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not f for f in _found(held.value, texts(b.column("text")))], pa.bool_()))

        return docs.mapInArrow(released(run), schema)

    for i in range(many):
        docs = one_pass(docs, i) if many == 1 else stored(one_pass(docs, i), "clean")
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "similarity", "first_word", "words")
