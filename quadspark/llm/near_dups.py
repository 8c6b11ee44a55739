"""MinHash near-dedup with SuperMinHash signatures, banding, verification on whole sets and union-find grouping.

A document's set is its distinct K-word shingles (A-Z lower-cased; of fewer words the whole sequence). Documents of equal
sets are one class, a node of the graph with a number of its own, so copies are never paired and doc_ids play no part in linking.
A class is represented by its smallest (doc_id, text hash), as is a group of linked classes.

Signatures: every shingle has a pseudorandom permutation of the M slots (Fisher-Yates, step by step) and a fraction for each
step; slot i of the signature is the least rank + fraction that any shingle gives it. All shingles of a document take step j
at once, and a document stops as soon as each of its slots is filled: a later step can only give larger values. BANDS bands
of ROWS slots: two sets of similarity 0.8 share no band with probability (1 - 0.8^6)^48 = 5e-7.

Pairs: a bucket's member of least number is its hub, and every member is compared with its hubs; confirmed links are grouped; a hub
whose buckets still hold several groups goes on, with the rows outside the largest group against all. Rows are compared in
blocks of about BLOCK_ROWS rows (fewer, if they are long) of either side, inside one task, by products of incidence matrices; only links between different
groups leave it, so no pairs are emitted, a hot group is spread over its blocks, and no candidate pair that could join two groups
is left out. Similarity is counted on whole shingle sets made anew from the texts (64-bit hashes). Groups are found by union-find
in each task and large-star, small-star rounds over what is left.

Nulls and ties: null, empty and blank texts have empty sets, size 0, and are linked with nothing. A document is a (doc_id, text):
rows equal in both are kept or not together, rows of equal or null doc_id and other texts are documents of their own, of which the
smaller text hash goes first. A null doc_id counts as the largest id; component_id is null if all of its group have null ids.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Filter
from .common import in_chunks, mix64, released, stored, table, texts, word_hashes

ROWS, BANDS = 6, 48
PERCENT = 80
BLOCK_ROWS, BLOCK_SIZE, COLUMNS = 256, 1 << 18, 8192
_LAST = (1 << 63) - 1
_M = np.uint64


def shingles(values: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, of, _, _ = word_hashes(values)
    ends = np.searchsorted(of, np.arange(len(values)), side="right")
    begins = np.concatenate([[0], ends[:-1]])
    rolled = np.zeros(len(h), np.uint64)
    for j in range(k):
        rolled[: len(h) - j] = mix64(rolled[: len(h) - j] * _M(0x9E3779B97F4A7C15) + h[j:] + _M(j))
    out = []
    for a, b in zip(begins, ends, strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:  # one shingle of all words, told apart from longer ones by its length
            x = np.zeros(1, np.uint64)
            for w in h[a:b]:
                x = mix64(x * _M(0x9E3779B97F4A7C15) + w + _M(b - a + 1000))
            out.append(x)
        else:
            out.append(h[:0])
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(sets, m) signatures; rows of empty sets keep the largest value."""
    lens = np.array([len(s) for s in sets])
    e, of = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), lens)
    none = _M((1 << 64) - 1)
    sig = np.full((len(sets), m), none, np.uint64)
    flat = sig.reshape(-1)
    p = None
    for j in range(m):
        x = mix64(e + _M((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        at = j + ((x >> _M(40)) % _M(m - j)).astype(np.int64)
        if p is None:
            slot = at
        else:
            rows = np.arange(len(e))
            slot = p[rows, at].astype(np.int64)
            p[rows, at] = p[:, j]
        np.minimum.at(flat, of * m + slot, (_M(j) << _M(40)) | (x & _M((1 << 40) - 1)))
        open_rows = (sig == none).any(1)
        keep = open_rows[of]
        if not keep.any():
            break
        if p is None:  # from here on the permutations are needed: step 0 swapped slot 0 with `at`
            e, of, at = e[keep], of[keep], at[keep]
            p = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
            p[np.arange(len(e)), at] = 0
        elif not keep.all() and keep.mean() < 0.8:
            e, of, p = e[keep], of[keep], p[keep]
    return sig


def _sum64(x: np.ndarray) -> int:
    return int(np.add.reduce(x, dtype=np.uint64)) if len(x) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, k: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs (id, th, text) as (id, th, n, d1, d2, bands): size, 128-bit digest of the set, a hash for each band."""
    m = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            values = texts(b.column("text"))
            n, d1, d2, keys = [], [], [], []
            for a, z in in_chunks(values, 1 << 18):
                sets = shingles(values[a:z], k)
                sig = superminhash(sets, m).reshape(len(sets), bands, rows)
                x = np.zeros((len(sets), bands), np.uint64) + salt
                for i in range(rows):
                    x = mix64(x * _M(0x9E3779B97F4A7C15) + sig[:, :, i])
                n += [len(s) for s in sets]
                d1 += [_signed(_sum64(mix64(s + _M(0x5851F42D4C957F2D)))) for s in sets]
                d2 += [_signed(_sum64(mix64(s ^ _M(0x14057B7EF767814F)))) for s in sets]
                keys += [row if len(s) else [] for row, s in zip(x.view(np.int64).tolist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "th", "n", "d1", "d2", "bands"])

    return docs.select("id", "th", "text").mapInArrow(released(run), "id long, th long, n long, d1 long, d2 long, bands array<bigint>")


# --- groups ----------------------------------------------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: (node, root) for each node that isn't its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def out() -> pa.RecordBatch:
        nodes = [x for x in up if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in batches:
        for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, z = root(a), root(z)
            if a != z:
                up[max(a, z)] = min(a, z)
                up.setdefault(min(a, z), min(a, z))
        if len(up) > 500_000:
            yield out()
            up.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (u, v) reach, for each node that isn't that itself."""
    edges = stored(links.select("u", "v").filter("u <> v").mapInArrow(released(_forest), "u long, v long").distinct(), "forest")
    while True:
        # large-star: a node's larger neighbours go to the least of its neighbours and itself
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.filter("u <> v").distinct(), "stars")
        again = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").limit(1).count()
        many = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() if not again else 1
        if not again and not many:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- verification ----------------------------------------------------------------------------------------------------


def _similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """(a, b) booleans: 100 * intersection >= percent * union, from products of incidence matrices over shared hashes."""
    n = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    if len(a) * len(b) <= 4:
        both = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    else:
        one, two = np.concatenate(a), np.concatenate(b)
        shared = np.intersect1d(one, two)
        both = np.zeros(n.shape, np.float64)
        parts = []
        for x, sets in ((one, a), (two, b)):
            col = np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1))
            row = np.repeat(np.arange(len(sets)), [len(y) for y in sets])
            ok = shared[col] == x if len(shared) else np.zeros(len(x), bool)
            order = np.argsort(col[ok], kind="stable")
            parts.append((col[ok][order], row[ok][order]))
        for at in range(0, len(shared), COLUMNS):
            m = []
            for (col, row), sets in zip(parts, (a, b), strict=True):
                x, y = np.searchsorted(col, (at, at + COLUMNS))
                m.append(np.zeros((len(sets), min(COLUMNS, len(shared) - at)), np.float32))
                m[-1][row[x:y], col[x:y] - at] = 1
            both += m[0] @ m[1].T
    return (both > 0) & (100 * both >= percent * (n - both))


def _checked(k: int, percent: int):
    """Rows (h, i, j, side, node, g, text), those of a block together: links between its sides and different groups g,
    one at most for each row of side 0 and each group of side 1."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sides = [[r for r in rows if r[0] == s] for s in (0, 1)]
        if not all(sides):
            return
        names = list({r[1]: r[3] for r in rows}.items())
        sets = {}
        for x, y in in_chunks([t for _, t in names]):
            sets |= dict(zip([n for n, _ in names[x:y]], shingles([t for _, t in names[x:y]], k), strict=True))
        ok = _similar(*([sets[r[1]] for r in side] for side in sides), percent)
        for x, row in zip(sides[0], ok, strict=True):
            done = {x[2]}
            for at in np.flatnonzero(row):
                y = sides[1][at]
                if y[2] not in done:
                    done.add(y[2])
                    yield x[1], y[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for b in batches:
            keys = list(zip(*(b.column(n).to_pylist() for n in ("h", "i", "j")), strict=True))
            values = zip(*(b.column(n).to_pylist() for n in ("side", "node", "g")), texts(b.column("text")), strict=True)
            for x, row in zip(keys, values, strict=True):
                if x != key:
                    found += links(rows)
                    key, rows = x, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])
            found = []
        found += links(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    return run


def verified(blocks: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (u, v) of blocks (h, i, j, side, node, g); bodies: (node, text)."""
    rows = blocks.join(bodies, "node").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side")
    return rows.select("h", "i", "j", "side", "node", "g", "text").mapInArrow(released(_checked(k, percent)), "u long, v long")


def _many(rows, size):
    """How many blocks rows with so many shingles in all make: of about BLOCK_ROWS rows and BLOCK_SIZE shingles at most."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_SIZE)).cast("int")


def _blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every block of a with every block of b of the same h; both (h, node, g, na, nb), the numbers of a's and b's blocks."""
    (ai, a_last), (bj, b_last) = ((F.pmod(F.xxhash64("node"), F.col(n)).cast("int"), F.col(n) - 1) for n in ("na", "nb"))
    zero = F.lit(0)
    left = a.select("h", ai.alias("i"), F.explode(F.sequence(zero, b_last)).alias("j"), zero.alias("side"), "node", "g")
    right = b.select("h", F.explode(F.sequence(zero, a_last)).alias("i"), bj.alias("j"), F.lit(1).alias("side"), "node", "g")
    return left.unionByName(right)


def near_dups(docs: DataFrame, k: int, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of docs (doc_id, text); th is xxhash64 of the text (null: of '')."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sig = stored(signatures(docs, k, rows, bands), "signatures")
    full = sig.filter("n > 0")
    classes = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("bands").alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "bands"), "classes")
    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub < top")
    members = stored(entries.join(shared.drop("top"), "bucket"), "members")

    nodes = stored(classes.select("node", "id", "th").join(members.select("node").distinct(), "node", "left_semi"), "nodes")
    wanted = Filter(nodes.select(F.xxhash64("id", "th")), "once")
    bodies = docs.filter(wanted.passes(F.xxhash64("id", "th"))).join(nodes, ["id", "th"]).dropDuplicates(["node"])
    bodies = stored(bodies.select("node", "text"), "bodies")

    # tables that a hub's rows are joined with are written first: a join of two plain sides deals a hot hub over several tasks
    hubs = stored(members.select(F.col("hub").alias("h"), "node", "n").distinct(), "hubs")
    many = stored(hubs.groupBy("h").agg(_many(F.count("*"), F.sum("n")).alias("nb")), "many")
    alone = hubs.join(many, "h").select("h", "node", F.col("node").alias("g"), F.lit(1).alias("na"), "nb")
    first = _blocks(alone.filter("node = h"), alone.filter("node <> h"))
    links = stored(verified(first, bodies, k, percent), "links")
    groups = components(links)

    # hubs whose buckets still hold several groups: the rows outside the largest one against all
    named = hubs.join(groups, "node", "left").withColumn("g", F.coalesce("root", "node")).drop("root")
    named = stored(named, "named")
    sizes = named.groupBy("h", "g").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    mixed = sizes.groupBy("h").agg(F.count("*").alias("gs"), F.max(F.struct("c", "g", "size")).alias("most"), F.sum("c").alias("c"), F.sum("size").alias("size")).filter("gs > 1")
    mixed = mixed.select("h", F.col("most.g").alias("major"), _many(F.col("c") - F.col("most.c"), F.col("size") - F.col("most.size")).alias("na"), _many(F.col("c"), F.col("size")).alias("nb"))
    left = stored(named.join(stored(mixed, "mixed"), "h"), "mixed-rows")
    rest = _blocks(left.filter("g <> major"), left)
    more = stored(verified(rest, bodies, k, percent), "links")
    if more.limit(1).count():
        groups = components(links.unionByName(more))

    grouped = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    firsts = grouped.join(nodes, "node").groupBy("root").agg(F.min(F.struct("id", "th")).alias("first"))
    of_class = classes.select("node", "d1", "d2", "n", F.struct("id", "th").alias("rep")).join(grouped.join(firsts, "root").drop("root"), "node", "left")
    of_class = stored(of_class.select("d1", "d2", "n", F.coalesce("first", "rep").alias("first")), "of-class")
    sig = sig.select("id", "th", "n", "d1", "d2")
    own = F.struct("id", "th").alias("first")
    out = full.select("id", "th", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"]).select("id", "th", "n", "first").unionByName(sig.filter("n = 0").select("id", "th", "n", own))
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    kept = (F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))
    return out.select(real("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), real("first.id").alias("component_id"), kept.alias("kept"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"), 2).drop("th")
