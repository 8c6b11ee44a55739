"""LM scoring by Brown's class-based bigrams: P(w | previous) = P(class of w | class of previous) * P(w | class of w).

A word is its 64-bit hash, and a class belongs to a bucket of words, the hash's last BUCKET_BITS bits, so the table of all
classes has a fixed size however many words there are; words that meet in a bucket share its class. All words of the training
documents are clustered, whatever their rank or count:

1. word counts, by a shuffle of each task's counts by word;
2. a start: the SEEDS most frequent words are dealt to CLASSES classes by exchange clustering on the driver, from the bigram
   counts among them, a matrix of bounded size;
3. exchange sweeps over all words, on the executors: the counts of the classes on either side of each bucket are summed by
   bucket (a shuffle), each bucket is taken out of its class and put where the class-bigram likelihood is largest, all others
   being held. The first sweep places all buckets that have no class yet; in the others one half of the buckets moves, in
   turn, so that neighbours don't chase each other. The driver gets five bytes a bucket, and broadcasts the table;
4. class-bigram counts of all training tokens, with additive smoothing towards the class frequencies.

Scoring needs a word's exact count too. Those of the HEAD most frequent words are broadcast; counts of others join the scored
documents by word. That changes where a count is looked up and no score. The head is all words with at least as many
occurrences as the least count that keeps it within HEAD, so ties are in or out together.

A class has one more, unknown word, as the base score has one for the whole vocabulary; a bucket without any training word is in
a class of its own, of that unknown word alone. So the probabilities of all words and one unknown word a class sum to 1.

Nulls and ties: null text is empty, so its only token is the end; rows of null doc_id are held out (the crc32 of an empty
string is 0); rows of equal doc_id are scored one by one. Without training documents every count is 0. Words are equal if
their UTF-8 bytes are after lowering A-Z. Of classes equally good a bucket keeps its own, or else takes the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, mix64, small_batches, stored, table, texts, word_hashes

HEAD, SEEDS, CLASSES, SWEEPS, BUCKET_BITS = 1 << 17, 1024, 48, 5, 24
#: Sweeps over all words: one that places them, and one for each half.
ALL_SWEEPS = 3
ADD, HELD = 0.1, 1 << 20
#: Class numbers after the exchange classes: buckets without a training word, and the end of a text (also its beginning).
NONE, END, SIZE = CLASSES, CLASSES + 1, CLASSES + 2
_MASK = np.uint64((1 << BUCKET_BITS) - 1)


def _hashed(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, number of words of each text) by runs of texts, all texts in order."""
    for b in batches:
        values = texts(b.column(at))
        for a, z in in_chunks(values):
            h, of, _, _ = word_hashes(values[a:z])
            yield h, np.bincount(of, minlength=z - a)


def _padded(values: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' values with an end before the first text and after each one; the places of the values among them."""
    places = np.arange(len(values)) + np.repeat(np.arange(len(lens)), lens) + 1
    out = np.full(len(values) + len(lens) + 1, end, np.int64)
    out[places] = values
    return out, places


class Tally:
    """Sums of counts by key; full ones are handed out."""

    def __init__(self, most: int = HELD):
        self.keys, self.n, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), most
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is full."""
        self.parts.append(keys)
        self.held += len(keys)
        if self.held > self.most:
            self._fold()
        return len(self.keys) > 2 * self.most

    def _fold(self) -> None:
        u, m = np.unique(np.concatenate(self.parts), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, u]), return_inverse=True)
        self.n = np.bincount(at, weights=np.concatenate([self.n, m]), minlength=len(keys)).astype(np.int64)
        self.keys, self.parts, self.held = keys, [], 0

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self._fold()
        got = self.keys, self.n
        self.keys, self.n = self.keys[:0], self.n[:0]
        return got


def tallied(docs: DataFrame, key: Callable[[np.ndarray, np.ndarray], np.ndarray], names: str, split: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """Each task's counts of key(word hashes, words of each text) over docs (text), with the columns split() makes of the keys, and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()

        def out() -> pa.RecordBatch:
            keys, n = held.out()
            return pa.RecordBatch.from_arrays([*map(pa.array, split(keys)), pa.array(n)], [c.split()[0] for c in names.split(", ")] + ["n"])

        for h, lens in _hashed(batches):
            if held.add(key(h, lens)):
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, f"{names}, n long")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    return tallied(docs, lambda h, lens: h.view(np.int64), "word long", lambda k: [k]).groupBy("word").agg(F.sum("n").alias("n"))


# --- clustering ------------------------------------------------------------------------------------------------------


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the first `words` rows of a square matrix of bigram counts; the other rows are classes of their own.

    Starts from classes dealt in turn. Each word is taken out and put where sum f(N[a, b]) - sum f(N[a]) - sum f(N[b]) is
    largest, f(x) = x log x; ties keep its class, or take the first.
    """
    b, n = bigrams.astype(np.float64), len(bigrams)
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(n - words)])
    c = classes + n - words
    one = np.zeros((n, c))
    one[np.arange(n), of] = 1
    right, left = b @ one, b.T @ one
    pairs = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, own = of[w], b[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            pairs[a] -= r
            pairs[:, a] -= l
            pairs[a, a] -= own
            m = pairs[:classes]
            gain = (_f(m + r) - _f(m)).sum(1) + (_f(pairs[:, :classes] + l[:, None]) - _f(pairs[:, :classes])).sum(0)
            d, k = np.diagonal(pairs)[:classes], np.arange(classes)
            gain += _f(d + r[k] + l[k] + own) - _f(d) - (_f(d + r[k]) - _f(d)) - (_f(d + l[k]) - _f(d))
            out, into = pairs.sum(1)[:classes], pairs.sum(0)[:classes]
            gain -= _f(out + r.sum() + own) - _f(out) + _f(into + l.sum() + own) - _f(into)
            to = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            pairs[to] += r
            pairs[:, to] += l
            pairs[to, to] += own
            if to != a:
                moved += 1
                of[w] = to
                right[:, a] -= b[:, w]
                right[:, to] += b[:, w]
                left[:, a] -= b[w]
                left[:, to] += b[w]
        if not moved:
            break
    return of[:words]


def seed_bigrams(docs: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Bigram counts among the seeds (hashes, sorted), all other words together, and the end."""
    size = len(seeds) + 2

    def key(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(seeds, h), max(0, len(seeds) - 1))
        x, _ = _padded(np.where(seeds[at] == h, at, size - 2) if len(seeds) else np.zeros(len(h)), lens, size - 1)
        return x[:-1] * size + x[1:]

    found = tallied(docs, key, "pair long", lambda k: [k]).groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def class_bigrams(docs: DataFrame, shared) -> np.ndarray:
    """(SIZE, SIZE) bigram counts of classes over all texts, for a broadcast table of the buckets' classes."""

    def key(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        x, _ = _padded(shared.value[(h & _MASK).astype(np.int64)], lens, END)
        return x[:-1] * SIZE + x[1:]

    found = tallied(docs, key, "pair long", lambda k: [k]).groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE * SIZE)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(SIZE, SIZE)


def moving(buckets: np.ndarray, classes: np.ndarray, sweep: int) -> np.ndarray:
    """Which buckets a sweep moves: first those without a class, then each half in turn."""
    return classes == NONE if sweep == 0 else (buckets + sweep) % 2 == 0


def neighbours(docs: DataFrame, shared, sweep: int) -> DataFrame:
    """(bucket, side, class, n): classes before (side 0) and after (1) the words of each moving bucket, each bucket in one task, in order."""

    def key(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        w = (h & _MASK).astype(np.int64)
        c = shared.value[w]
        x, places = _padded(c, lens, END)
        ok = moving(w, c, sweep)
        w, places = w[ok] * 2, places[ok]
        return np.concatenate([w * SIZE + x[places - 1], (w + 1) * SIZE + x[places + 1]])

    rows = tallied(docs, key, "bucket int, side int, class int", lambda k: [(k // (2 * SIZE)).astype(np.int32), (k // SIZE % 2).astype(np.int32), (k % SIZE).astype(np.int32)])
    return rows.repartition("bucket").groupBy("bucket", "side", "class").agg(F.sum("n").alias("n")).sortWithinPartitions("bucket")


def best_classes(bucket: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each bucket (numbers from 0, with their present classes `own`) by its neighbours' classes, for the present class
    bigrams: the sum of n * log P is largest, without the bucket's own counts in the class it is taken out of."""
    p, many = pairs + 0.1, len(own)
    row, col = p.sum(1), p.sum(0)
    comes = np.log(p / row[:, None] / col[None, :])[:, :CLASSES]  # of class k after class i, and a word of k being this one
    follows = np.log(p / row[:, None]).T[:, :CLASSES]  # of class j after class k
    score = np.zeros((many, CLASSES))
    for i, t in ((0, comes), (1, follows)):
        at = side == i
        by = np.zeros((many, SIZE))
        np.add.at(by, (bucket[at], cls[at]), n[at])
        score += by @ t
    total = np.bincount(bucket, np.where(side == 1, n, 0), many)
    a = own[bucket]
    placed = a < CLASSES
    k, c, m = a[placed], cls[placed], n[placed]
    rest = np.maximum(row[k] - total[bucket[placed]], 0.1), np.maximum(col[k] - total[bucket[placed]], 0.1)
    before = np.log(np.maximum(p[c, k] - m, 0.1) / row[c] / rest[1])
    after = np.log(np.maximum(p[k, c] - m, 0.1) / rest[0])
    mine = np.bincount(bucket[placed], m * np.where(side[placed] == 0, before, after), many)
    have = np.flatnonzero(own < CLASSES)
    score[have, own[have]] = mine[have]
    best = score.argmax(1)
    best[have] = np.where(score[have, own[have]] >= score[have].max(1) - 1e-9, own[have], best[have])
    return best


def _swept(shared, pairs: np.ndarray):
    """Rows (bucket, side, class, n), those of a bucket together: (buckets as i32, classes as u8) of runs of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, more = [], 0
        joined = lambda: [np.concatenate(x) for x in zip(*parts, strict=True)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            buckets, at = np.unique(rows[0], return_inverse=True)
            best = best_classes(at, *rows[1:], shared.value[buckets].astype(np.int64), pairs)
            return pa.RecordBatch.from_arrays([pa.array([buckets.astype("<i4").tobytes()], pa.binary()), pa.array([best.astype(np.uint8).tobytes()], pa.binary())], ["buckets", "classes"])

        for b in batches:
            parts.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            more += len(parts[-1][0])
            if more > 1 << 16:  # the last bucket may go on in the next batch
                held = joined()
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield out([x[:cut] for x in held])
                parts, more = [[x[cut:] for x in held]], 0
        if parts and len((held := joined())[0]):
            yield out(held)

    return run


def clustered(docs: DataFrame, seeds: np.ndarray, sweeps: int = ALL_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' classes, and the class bigrams, of docs (text); seeds: the hashes of the words to start from, sorted."""
    spark = docs.sparkSession
    classes = np.full(1 << BUCKET_BITS, NONE, np.uint8)
    of = exchange(seed_bigrams(docs, seeds), len(seeds), CLASSES)
    classes[(seeds & _MASK).astype(np.int64)] = of
    for sweep in range(sweeps + 1):
        shared = spark.sparkContext.broadcast(classes)
        pairs = class_bigrams(docs, shared)
        if sweep == sweeps:
            return classes, pairs
        found = neighbours(docs, shared, sweep).mapInArrow(_swept(shared, pairs), "buckets binary, classes binary")
        moved = classes.copy()
        for r in found.toLocalIterator():
            moved[np.frombuffer(r["buckets"], "<i4")] = np.frombuffer(r["classes"], np.uint8)
        classes = moved
        shared.unpersist()


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs."""

    head: np.ndarray  # hashes of the most frequent words, sorted
    count: np.ndarray  # of them
    classes: np.ndarray  # of a bucket
    transition: np.ndarray  # log10 P(second | first), by class
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    types: int
    documents: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.tokens + ADD * (self.types + 1)))

    def of_class(self) -> np.ndarray:
        """log10 of what counts are divided by, by class."""
        return np.log10(self.class_tokens + ADD * (self.class_words + 1))

    def emission(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.log10(c + ADD) - self.of_class()[k]


def class_sizes(counts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, words) of each class, from (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(SIZE), np.zeros(SIZE)
        for b in batches:
            k = shared.value[(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & _MASK).astype(np.int64)]
            n += np.bincount(k, b.column(1).to_numpy(zero_copy_only=False), SIZE)
            words += np.bincount(k, minlength=SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE)), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64))], ["class", "n", "words"])

    found = counts.select("word", "n").mapInArrow(run, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    n, words = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for r in found:
        n[r["class"]], words[r["class"]] = r["n"], r["words"]
    return n, words


def fit(docs: DataFrame, head: int = HEAD, seeds: int = SEEDS) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the stored counts (word, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = stored(word_counts(docs), "word-counts")
    documents = docs.count()
    often = counts.groupBy("n").agg(F.count("*").alias("types")).orderBy(F.desc("n"))
    least, held = None, 0
    for r in often.toLocalIterator():
        held += r["types"]
        if held > head:
            break
        least = r["n"]
    top = [] if least is None else [(-r["n"], r["word"] % (1 << 64)) for r in counts.filter(F.col("n") >= least).toLocalIterator()]
    top.sort()
    first = np.sort(np.array([w for _, w in top[:seeds]], np.uint64))
    names, n = np.array([w for _, w in top], np.uint64), np.array([-x for x, _ in top], np.int64)
    order = np.argsort(names)

    classes, pairs = clustered(docs, first)
    prior = (pairs.sum(0) + 1) / (pairs.sum() + SIZE)
    transition = np.log10((pairs + SIZE * prior) / (pairs.sum(1, keepdims=True) + SIZE))
    tokens, types = class_sizes(counts, spark.sparkContext.broadcast(classes))
    return Model(names[order], n[order], classes, transition, tokens, types, int(tokens.sum()) + documents, int(types.sum()) + (documents > 0), documents), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) scored: doc_id, held_out, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "key long, doc_id long, held_out boolean, word long, times long, n_tokens long, n_known long, base double, score double"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.float64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of_class, whole = m.of_class(), float(np.log10(m.tokens + ADD * (m.types + 1)))
        known_count = np.log10(m.count + ADD)
        end, end_known = float(m.base(np.array([m.documents]))[0]), int(m.documents > 0)
        for b in batches:
            values = texts(b.column(3))
            for lo, hi in in_chunks(values):
                h, of, _, _ = word_hashes(values[lo:hi])
                rows = hi - lo
                lens = np.bincount(of, minlength=rows)
                k = m.classes[(h & _MASK).astype(np.int64)]
                x, _ = _padded(k, lens, END)
                at = np.minimum(np.searchsorted(m.head, h), max(0, len(m.head) - 1))
                known = m.head[at] == h if len(m.head) else np.zeros(len(h), bool)
                logs = np.where(known, known_count[at], 0.0) if len(m.head) else np.zeros(len(h))
                steps = np.add.reduceat(m.transition[x[:-1], x[1:]], np.cumsum(lens + 1) - (lens + 1))
                base = np.bincount(of, np.where(known, logs - whole, 0.0), rows) + end
                full = np.bincount(of, np.where(known, logs - of_class[k], 0.0), rows) + steps
                key = b.column(0).slice(lo, rows).to_numpy(zero_copy_only=False)
                spread = mix64(key.astype(np.uint64)).view(np.int64)  # these rows join nothing, anywhere
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1).slice(lo, rows), b.column(2).slice(lo, rows), *(pa.array(v, t) for v, t in zip((spread, np.zeros(rows, np.int64), lens + 1, np.bincount(of, known, rows).astype(np.int64) + end_known, base, full), kinds[3:], strict=True))], names)
                if known.all():
                    continue
                order = np.lexsort((h[~known], of[~known]))
                row, word, c = of[~known][order], h[~known][order], k[~known][order]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
                times = np.diff(np.append(start, len(row)))
                none = pa.nulls(len(start))
                zero = np.zeros(len(start), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[row[start]]), none.cast(pa.int64()), none.cast(pa.bool_()), *(pa.array(v, t) for v, t in zip((word[start].view(np.int64), times, zero, zero, -times * whole, -times * of_class[c[start]]), kinds[3:], strict=True))], names)

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    both = keyed.mapInArrow(run, schema).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    own = F.when(F.col("times") > 0, F.col("times") * F.log10(c + F.lit(ADD))).otherwise(F.lit(0.0))
    known = F.when((F.col("times") > 0) & (c > 0), F.col("times")).otherwise(F.col("n_known"))
    out = both.select("key", "doc_id", "held_out", "n_tokens", known.alias("n_known"), (F.col("base") + own).alias("base"), (F.col("score") + own).alias("score"))
    out = out.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.drop("key")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out()).select("doc_id", "held_out", "text")
    model, counts = fit(docs.filter("not held_out").select("text"))
    out = score(docs, model, counts).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
