"""Document fingerprints by winnowing over code points.

A text is lower-cased and stripped of white space (\x20, \x09-\x0D). A gram of K code points has a rolling hash, a cyclic
polynomial: the rotated hashes of its code points, xored. Grams of 2 s code points come from those of s, so all positions cost
log2(K) array steps. Of every window of W grams the least is kept, the rightmost of equal ones, with its position in the
stripped text. So two texts that share K + W - 1 code points in a row (white space not counted) share a kept gram, in any
script and at any offset.

A gram's hash (34 bits) and reversed position (30 bits) are packed into one long, so that the least long of a window is the
least hash with the rightmost position. Texts are worked off in pieces that overlap by K + W - 2 code points, so that no more
than a piece's grams are held, however long the text is.

The query is of DataFrame functions only, and keeps the number of array steps small:

- Only grams under TAU can usually be least; of these, those that are greater than both neighbours and lie in no window without
  one of them are dropped in ROUNDS rounds (at first by the two neighbours on each side; the last rounds only where something still goes).
  What is left is the kept grams, unless a window had no gram under TAU or the rounds did not suffice: this is seen from the
  result, and such a piece takes the minima of all windows, in log2(W) steps.
- Arrays are shifted by nulls put before them, not by slices, which copy element by element.
- An edited text is the start of one text and the start of another. Its kept grams are those of the windows inside of either,
  which are known from the fingerprints of both, and those of the windows across the seam. Lower-casing looks at neighbours for
  a capital sigma only: edited texts with one are worked off as a whole.

`fingerprint` is the same in numpy, for one text at hand.

Nulls and ties: null text is empty; a text without other than white space has the empty fingerprint; one of fewer than K code
points is one gram. Two empty fingerprints have likeness 1, an empty and another one 0. Rows of null doc_id come last, by
descending hash of their texts; rows of equal doc_id follow each other by text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, mix64, rotl, table

K, W, POS_BITS = 16, 32, 30
#: Windows of a piece of the DataFrame form, and of a run of pieces; the second bounds the cost of finding a piece in a long text.
BLOCK, RUN = 1 << 12, 1 << 18
#: Grams of a packed value under this (of 2^64) are looked at first; under 2^63, where the last step of mix64 leaves the bits that are kept.
TAU, ROUNDS = 5 << 60, (2, 4, 12)
#: Code points whose hashes are looked up.
KNOWN = 0x600
_POS = (1 << POS_BITS) - 1
#: Windows of a piece.
PIECE = 1 << 16
_GONE = dict.fromkeys(map(ord, SPACES))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _kept(points: np.ndarray, before: int) -> np.ndarray:
    """The packed minima of a piece's windows, equal neighbours once; `before`: code points before the piece."""
    h, s = mix64(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    if len(h) < K:  # the whole text
        for i, x in enumerate(h[:-1].tolist()):
            h[-1] ^= _rotl(np.array([x], np.uint64), len(h) - 1 - i)[0]
        h = h[-1:]
    while s < K and len(points) >= K:
        h, s = _rotl(h[:-s], s) ^ h[s:], 2 * s
    place = np.uint64((1 << POS_BITS) - 1 - before) - np.arange(len(h), dtype=np.uint64)
    x, s = mix64(h) >> np.uint64(POS_BITS) << np.uint64(POS_BITS) | place, 1
    w = min(W, len(x))
    while s < w:  # minima of 2 * s grams, or of w
        step = min(s, w - s)
        x, s = np.minimum(x[:-step], x[step:]), s + step
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def fingerprint(text: str) -> np.ndarray:
    """A text's kept grams in order of position: each hash << 30 | reversed position."""
    points = np.frombuffer(text.lower().translate(_GONE).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64)
    size = PIECE + K + W - 2
    parts = [_kept(points[a : a + size], a) for a in range(0, max(1, len(points) - (K + W - 2)), PIECE)]
    x = np.concatenate(parts)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


# --- the same with DataFrame functions -------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_GOLDEN, _C1, _C2, _TOP = (_signed(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1 << 63))
#: Nulls before and after a piece's grams: the pairs of _paired that lack a part. They give room for a place before the first gram.
_PAD = K - 1


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _shifted(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def _nulls(n: int) -> Column:
    return F.array(*[F.lit(None).cast("long")] * n)


def _paired(x: Column, step: int, of: Callable[[Column, Column], Column]) -> Column:
    """of(a[i - step], a[i]) for all i and `step` more; null stands for what is before the first or after the last one.

    Nulls are put before the array, as slice copies element by element.
    """
    return _let(x, lambda a: F.zip_with(F.concat(_nulls(step), a), a, of))


def _bare(x: Column) -> Column:
    """x without the nulls around it."""
    return F.slice(x, F.lit(_PAD + 1), F.size(x) - 2 * _PAD)


def _grams(piece: Column) -> Column:
    """Rolling hashes of a piece's grams, before they are mixed; one of the whole piece if it is shorter. _PAD nulls are on either side."""
    hashed = mix64(np.arange(KNOWN, dtype=np.uint64) + np.uint64(_GOLDEN % (1 << 64)))
    known = [F.lit(x.view(np.int64).tolist()) for x in (hashed, _rotl(hashed, 1))]

    def h(c: Column, n: int) -> Column:
        """The hash of a code point, rotated by n."""
        other = _let(_let(_shifted(c + F.lit(_GOLDEN)) * F.lit(_C1), _shifted) * F.lit(_C2), lambda v: rotl(_shifted(v), n))
        return F.coalesce(F.get(known[n], c), F.when(c.isNotNull(), other))

    def rolled(n: int) -> Callable[[Column, Column], Column]:
        return lambda a, b: rotl(a, n).bitwiseXOR(b)

    def of(points: Column) -> Column:
        short = F.array(F.aggregate(points, F.lit(0).cast("long"), lambda x, c: rotl(x, 1).bitwiseXOR(h(c, 0))))
        x, step = _paired(points, 1, lambda a, b: h(a, 1).bitwiseXOR(h(b, 0))), 2
        while step < K:
            x, step = _paired(x, step, rolled(step)), 2 * step
        return F.when(F.size(points) < K, F.concat(_nulls(_PAD), short, _nulls(_PAD))).otherwise(x)

    return _let(F.transform(F.split(piece, ""), lambda c: F.ascii(c)), of)


def _candidates(grams: Column) -> Column:
    """Packed grams under TAU, between two that are less than any: the places before the first and after the last gram."""
    x = F.transform(grams, lambda v: _shifted(v) * F.lit(_C1))
    x = F.transform(x, lambda v, i: (_shifted(v) * F.lit(_C2)).bitwiseOR(F.lit(_POS)) - i)
    x = F.filter(x, lambda v: (v >= F.lit(0)) & (v < F.lit(TAU)))
    return F.concat(F.array(F.lit(_TOP + _POS - _PAD + 1)), x, F.array(F.lit(_TOP + _POS + _PAD) - F.size(grams)))


def _apart(a: Column, b: Column) -> Column:
    """How far b's place is behind a's."""
    return a.bitwiseAND(F.lit(_POS)) - b.bitwiseAND(F.lit(_POS))


def _thinned(a: Column, w: Column) -> Column:
    """a, a variable, without those that are greater than both neighbours and in no window without one of them."""
    return F.filter(a, lambda v, i: (F.get(a, i - 1) >= v) | (F.get(a, i + 1) >= v) | (_apart(F.get(a, i - 1), F.get(a, i + 1)) > w))


def _thinned_by_two(a: Column, w: Column) -> Column:
    """a, a variable, without those that are greater than one of the two before and one of the two after them, if no window fits between these four."""
    far = lambda i: F.coalesce(_apart(F.get(a, i - 2), F.get(a, i + 2)) > w, F.lit(True))
    return F.filter(a, lambda v, i: ((F.get(a, i - 1) >= v) & (F.get(a, i - 2) >= v)) | ((F.get(a, i + 1) >= v) & (F.get(a, i + 2) >= v)) | far(i))


def _rounds(x: Column, n: int, of: Callable[[Column, Column], Column], w: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, lambda a, _: of(a, w))


def _minima(grams: Column, before: Column) -> Column:
    """The packed minima of all windows, by pairs; in the order of unsigned values."""
    x = F.transform(_bare(grams), lambda v: _shifted(v) * F.lit(_C1))
    x = F.transform(x, lambda v: _shifted(v) * F.lit(_C2))
    x = F.transform(x, lambda v, i: _shifted(v).bitwiseAND(F.lit(~_POS)).bitwiseXOR(F.lit(_TOP + _POS) - before - i))

    def least(x: Column, step: int = 1) -> Column:
        return x if step == W else least(_paired(x, step, lambda a, b: F.least(a, b)), 2 * step)

    kept = _let(x, lambda a: F.when(F.size(a) <= W, F.array(F.array_min(a))).otherwise(F.slice(least(a), F.lit(W), F.size(a) - (W - 1))))
    return F.transform(F.array_distinct(kept), lambda v: v.bitwiseXOR(F.lit(_TOP)))


def _kept_grams(piece: Column, before: Column) -> Column:
    """The packed minima of a piece's windows; `before`: code points before the piece."""

    def of(grams: Column) -> Column:
        w = F.least(F.size(grams) - 2 * _PAD, F.lit(W))
        x = _rounds(_rounds(_candidates(grams), ROUNDS[0], _thinned_by_two, w), ROUNDS[1], _thinned, w)
        done = lambda a: F.size(_thinned(a, w)) == F.size(a)
        x = _let(x, lambda a: F.when(done(a), a).otherwise(_rounds(a, ROUNDS[2], _thinned, w)))
        gap = lambda a: F.exists(F.transform(a, lambda v, i: _apart(v, F.get(a, i + 1)) > w), lambda far: far)
        placed = lambda a: F.transform(F.slice(a, F.lit(2), F.size(a) - 2), lambda v: v + (F.lit(_PAD) - before))
        return _let(x, lambda a: F.when((F.size(a) > 2) & done(a) & ~F.coalesce(gap(a), F.lit(False)), placed(a)).otherwise(_minima(grams, before)))

    return _let(_grams(piece), of)


def _in_pieces(text: Column, size: int, of: Callable[[Column, Column], Column]) -> Column:
    """The results of all pieces of `size` windows, one after the other; of: (piece, code points before it)."""
    many = F.greatest(F.ceil((F.length(text) - (K + W - 2)) / size).cast("int"), F.lit(1))
    cut = lambda p: _let(F.substring(text, p * size + 1, F.lit(size + K + W - 2)), lambda piece: of(piece, (p * size).cast("long")))
    return F.flatten(F.transform(F.sequence(F.lit(0), many - 1), cut))


def _plain(text: Column) -> Column:
    """The text lower-cased and stripped of white space."""
    out = F.lower(text)
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _whole(plain: Column) -> Column:
    """The kept grams of a stripped text."""
    runs = lambda t: _in_pieces(t, RUN, lambda run, a: _in_pieces(run, BLOCK, lambda piece, b: _kept_grams(piece, a + b)))
    return _let(plain, lambda t: F.when(F.length(t) > 0, F.array_distinct(runs(t))).otherwise(_none()))


def _inside(fp: Column, n: Column) -> Column:
    """The kept grams, of a text's fp, of the windows in its first n code points."""
    place = lambda x: x.bitwiseAND(F.lit(_POS))
    high = F.lit(_POS) - (n - (K + W - 1))  # place of the last such window's first gram
    last = F.filter(fp, lambda x: (place(x) <= high) & (place(x) > high - W))
    least = F.array_min(F.transform(last, lambda x: x.bitwiseXOR(F.lit(_TOP))))
    return F.when(n < K + W - 1, _none()).otherwise(_let(least, lambda m: F.filter(fp, lambda x: place(x) >= place(m))))


@contextmanager
def _wrapping(spark: SparkSession) -> Iterator[None]:
    """Products of what is built inside wrap around, as they do in numpy, instead of failing."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<long> column `out`: the kept grams of column `text` (null: as empty)."""
    with _wrapping(df.sparkSession):
        return df.withColumn(out, _whole(_plain(F.coalesce(F.col(text), F.lit("")))))


def with_edited(df: DataFrame, head: str, tail: str, fp: str, next_fp: str, out: str) -> DataFrame:
    """df with array<long> column `out`: the kept grams of head and tail, the starts of the texts of fp and next_fp, joined."""
    side = K + W - 2
    with _wrapping(df.sparkSession):
        df = df.withColumns({"_head": _plain(F.col(head)), "_tail": _plain(F.col(tail))})
        df = df.withColumns({"_m": F.length("_head").cast("long"), "_n": F.length("_tail").cast("long"), "_across": F.concat(F.right("_head", F.lit(side)), F.left("_tail", F.lit(side)))})
        m, n = F.col("_m"), F.col("_n")
        short = m + n <= side
        seam = F.when((m + n > 0) & (short | ((m > 0) & (n > 0))), _kept_grams(F.col("_across"), F.greatest(m - side, F.lit(0)))).otherwise(_none())
        moved = F.transform(_inside(F.col(next_fp), n), lambda x: x - m)
        joined = F.array_distinct(F.concat(_inside(F.col(fp), m), seam, moved))
        sigma = F.contains(F.concat(head, tail), F.lit("\u03a3"))
        df = df.withColumn(out, F.when(sigma, _whole(_plain(F.concat(head, tail)))).otherwise(joined))
    return df.drop("_head", "_tail", "_m", "_n", "_across")


def as_text(fp: Column) -> Column:
    """hash@position of each kept gram, in order of position, joined by commas."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, POS_BITS)), F.lit("@"), (F.lit((1 << POS_BITS) - 1) - x.bitwiseAND(F.lit((1 << POS_BITS) - 1))).cast("string"))), ",")


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, POS_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next_<column> of the row that follows by descending doc_id (after the last: the first).

    Rows are dealt into ranges of doc_id (of their text's hash where that is null), several for each shuffle partition; each
    range also gets the rows of largest key of the range that follows it, so one exchange of the rows is enough and no window
    spans all of them. The bounds come from a quantile sketch; a row finds its range by binary search.
    """
    spark = docs.sparkSession
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumns({"_none": F.col("doc_id").isNull(), "_key": F.coalesce("doc_id", F.xxhash64("text"))})
    found = {r["_none"]: sorted(set(r["b"])) for r in keyed.groupBy("_none").agg(F.percentile_approx("_key", [i / many for i in range(1, many)], 10_000).alias("b")).collect()}

    def place(bounds: list[int]) -> Column:
        """How many of the bounds are under the key."""
        if not bounds:
            return F.lit(0)
        of = F.array(*map(F.lit, bounds)).cast("array<bigint>")
        steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.coalesce(F.get(of, i + s - 1) < F.col("_key"), F.lit(False)), i + s).otherwise(i))

    low = len(found.get(True, ())) + 1  # ranges of rows of null doc_id come first, as the order is descending
    ranged = keyed.withColumn("_range", F.when(F.col("_none"), place(found.get(True, []))).otherwise(place(found.get(False, [])) + low))
    tops = {r["_range"]: r["top"] for r in ranged.groupBy("_range").agg(F.max("_key").alias("top")).collect()}  # a row for each range
    order = sorted(tops, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range follows the last one
    pairs = spark.createDataFrame([(r, tops[r], before[r]) for r in order], "_range int, _top long, _before int")
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("halo"))
    edge = F.struct(F.col("_before").alias("at"), F.lit(1).alias("halo"))
    both = ranged.join(F.broadcast(pairs), "_range").withColumn("_to", F.explode(F.when(F.col("_key") == F.col("_top"), F.array(own, edge)).otherwise(F.array(own))))
    w = Window.partitionBy("_to.at").orderBy("_to.halo", F.col("_key").desc(), "text")
    out = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("_to.halo = 0")
    return out.drop("_none", "_key", "_range", "_top", "_before", "_to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts, of their edited texts and of the next documents, and their likeness."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_fingerprint(docs, "text", "fp"), ["text", "fp"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({"head": F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), "tail": F.substring("next_text", F.lit(1), half)})
    docs = with_edited(docs.drop("text", "next_text"), "head", "tail", "fp", "next_fp", "edited_fp")
    docs = docs.withColumn("edited", F.concat("head", "tail")).drop("head", "tail")
    return docs.withColumns({"_a": hashes(F.col("fp")), "_b": hashes(F.col("edited_fp")), "_c": hashes(F.col("next_fp"))})


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("_c")).alias("near_next"))
