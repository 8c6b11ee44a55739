"""Mixing sources to target weights, by fixed-length blocks and multinomial draws.

1. Each source's words, document after document, are packed into blocks of BLOCK words; a block is a list of pieces
   (document, first word, number of words). Documents are placed by prefix sums of sizes in groups of about GROUP_ROWS rows, so
   no source is ordered by one task.
2. Targets: the sources, by code point with null last, weigh WEIGHTS, repeating, and share all words; a target stops at
   MOST times its source's size and the excess is shared by weight again until none is above.
3. A source gets slots for its target, as many passes over its blocks as fit and a part of one; of the last slot only the first
   words are taken, so that a source gives its target to the word. The output has at least SHARDS shards of equally many slots
   (more, of SHARD_SLOTS, if there are that many), and each shard's counts are a multinomial draw by what the sources have
   left, never more than that, so the shards use up every slot.
4. Slot j of a source with n blocks takes block P(j mod n), where P is a pseudorandom permutation of the source's block
   numbers for pass j div n (a Feistel network, walked until it is inside). So no block is taken more than MOST times.
5. Slots join blocks by (source, block number).

All draws come from a seed, so reruns agree. To the driver come a row a source, and the plan: a row a shard and source.

Nulls and ties: null text has size 0; a document of size 0 is in no block and takes 0; null source is a source of its own,
the last; null doc_id sorts first in its group. Rows of equal doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import released, stored, table, texts, word_hashes

WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 64, 20240
SHARDS, SHARD_SLOTS, GROUP_ROWS, TASK_SLOTS = 256, 1 << 22, 100_000, 1 << 18

WORD = r"[^\x20\x09-\x0D]+"
_STEP = 4096
_LAST = (1 << 63) - 1


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: each row a multinomial draw by what is left, cut at that and filled up from the rest."""
    rnd, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for i in range(shards):
        need = int(left.sum()) // (shards - i)
        while need:
            got = np.minimum(rnd.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def _halves(n: np.ndarray) -> np.ndarray:
    """Bits of a half of the next even power of two."""
    return np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)) + 1) // 2).astype(np.uint64)


def _mixed(b: np.ndarray, r: int, key: np.ndarray) -> np.ndarray:
    f = (b + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9) ^ key
    return (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Element-wise pseudorandom permutation of range(n) under a key, or back: the place that goes to x. A 4-round Feistel network
    over the next even power of two, walked until the value is under n."""
    x, n, key = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = _halves(n)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = v >> h, v & m
        for r in range(4):
            if back:
                a, b = b ^ (_mixed(a, 3 - r, k) & m), a
            else:
                a, b = b, a ^ (_mixed(b, r, k) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def pass_key(src: np.ndarray, run: np.ndarray, seed: int) -> np.ndarray:
    """The permutation's key for a source and a pass over its blocks."""
    return ((np.uint64(seed * 1_000_003) + src.astype(np.uint64)) * np.uint64(64) + run.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def slots_for(src: int, due: int, size: int, block: int, seed: int) -> tuple[int, int]:
    """(slots, words of the last slot) with which a source of `size` words gives `due` words."""
    if not due:
        return 0, 0
    blocks, (full, rest) = -(-size // block), divmod(due, size)
    short = size - (blocks - 1) * block
    one = lambda x: np.array([x])
    if not rest:  # the last slot of a whole pass takes all of its block
        return full * blocks, block
    at = int(permuted(one(blocks - 1), one(blocks), pass_key(one(src), one(full), seed), back=True)[0])  # where the short block is taken
    many = -(-rest // block)
    if at < many and (many - 1) * block + short < rest:
        many += 1
    before = (many - 1) * block - (block - short if at < many - 1 else 0)
    return full * blocks + many, rest - before


@dataclass
class Mix:
    """docs: (doc_id, size, source, src, start, source_size, target); pieces: the taken pieces, a row for each time.

    pieces: (shard, slot, src, block, pass, doc_id, start, first, words): `words` words from word `first` of the document
    that begins at word `start` of source number `src`.
    """

    docs: DataFrame
    pieces: DataFrame


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", words_in("text"))


def placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, src, groups, size) with `start`: words of its source before it, for numbers of groups by source."""
    docs = docs.withColumn("group", F.pmod(F.xxhash64("doc_id", "size"), F.col("groups")).cast("int"))
    inside = Window.partitionBy("src", "group").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = stored(docs.withColumn("_in", F.sum("size").over(inside) - F.col("size")), "in-groups")
    groups = docs.groupBy("src", "group").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("src").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.select("src", "group", (F.sum("_sum").over(before) - F.col("_sum")).alias("_before"))
    return docs.join(groups, ["src", "group"]).withColumn("start", F.col("_in") + F.col("_before")).drop("_in", "_before", "group", "groups")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> Mix:
    """The mix of docs (doc_id, source, size, ...); of other columns only th, a text's hash, is kept."""
    spark = docs.sparkSession
    extra = ["th"] if "th" in docs.columns else []
    docs = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size", *extra), "sizes")
    found = docs.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    blocks = [-(-n // block) for n in sizes]
    slots = [slots_for(i, min(MOST * n, round(t)), n, block, seed) for i, (t, n) in enumerate(zip(aims, sizes, strict=True))]
    sources = spark.createDataFrame([(i, r["source"], r["n"], t, -(-r["rows"] // GROUP_ROWS)) for i, (r, t) in enumerate(zip(found, aims, strict=True))], "src int, _name string, source_size long, target double, groups long")
    docs = stored(placed(docs.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")), "placed")

    every = sum(n for n, _ in slots)
    counts, plan, at = draw([n for n, _ in slots], max(shards, -(-every // SHARD_SLOTS)), seed), [], [0] * len(found)
    for i, row in enumerate(counts.tolist()):
        for s, n in enumerate(row):
            if n:
                plan.append((i, s, at[s], n, blocks[s], slots[s][0] - 1, slots[s][1]))
                at[s] += n
    plan = spark.createDataFrame(plan, "shard int, src int, from long, many long, blocks long, last long, cut long")
    step = F.least(F.lit(_STEP).cast("long"), F.col("from") + F.col("many") - F.col("_at"))
    runs = plan.withColumn("_at", F.explode(F.sequence("from", F.col("from") + F.col("many") - 1, F.lit(_STEP).cast("long")))).withColumn("_to", F.col("_at") + step - 1)
    # as many tasks as the slots ask for: the plan itself is small, so its partitions would be joined into one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // TASK_SLOTS))
    each = runs.repartition(tasks, F.col("shard"), F.col("src"), F.col("_at")).withColumn("slot", F.explode(F.sequence("_at", "_to")))

    @pandas_udf("long")
    def taken_block(src: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        slot, n = slot.to_numpy(np.int64), blocks.to_numpy(np.int64)
        return pd.Series(permuted(slot % n, n, pass_key(src.to_numpy(np.uint64), slot // n, seed)))

    limit = F.when(F.col("slot") == F.col("last"), F.col("cut")).otherwise(F.lit(block).cast("long"))
    each = each.select("shard", "src", "slot", taken_block("src", "slot", "blocks").alias("block"), F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("pass"), limit.alias("limit"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = docs.filter("size > 0").select("src", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    # both sides grow with the corpus, though the plan that the slots are made from looks small to the optimizer
    both = each.hint("merge").join(pieces.hint("merge"), ["src", "block"])
    begin = F.greatest(F.col("block") * block, F.col("start"))
    end = F.least(F.col("block") * block + F.col("limit"), F.col("start") + F.col("size"))
    pieces = both.select("shard", "slot", "src", "block", "pass", "doc_id", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))
    return Mix(docs, pieces.filter("words > 0"))


def taken(m: Mix) -> DataFrame:
    """docs with the words taken of each, from the mixed pieces."""
    sums = m.pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    with_words = m.docs.filter("size > 0").join(sums, ["src", "start"], "left")
    return with_words.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(m.docs.filter("size = 0").select("doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, a row for each document and pass that took words of it, with the taken words as its text.

    The text of a run of words goes from its first word to the end of its last one as it stands; runs are joined by a line
    feed; a document taken whole keeps its whole text. A column n_chars, if there is one, is the new text's length. Rows that agree
    in doc_id and text are told apart by the mix only: each of their passes gives a row with the columns of one of them.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no name of theirs meets one of ours
    inner = plain.columns
    of_name = dict(zip(names, inner, strict=True))
    text, n_chars = of_name["text"], of_name.get("n_chars")
    rows = plain.withColumns({"size": words_in(text), "id": F.coalesce(F.col(of_name["doc_id"]).cast("long"), F.lit(_LAST)), "th": F.xxhash64(text)})
    m = mix(rows.select(F.col(of_name["doc_id"]).alias("doc_id"), F.col(of_name["source"]).alias("source"), "size", "th"), **how)
    runs = m.pieces.groupBy("src", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"))
    of = m.docs.filter("size > 0").select("src", "start", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "th")
    runs = runs.join(of, ["src", "start"]).select("id", "th", "runs")
    cut = rows.filter("size > 0").dropDuplicates(["id", "th"]).join(runs, ["id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, out = texts(b.column(text)), []
            for t, size, parts in zip(values, b.column("size").to_pylist(), b.column("runs").to_pylist(), strict=True):
                if sum(p["words"] for p in parts) == size:
                    out.append(t.decode())
                    continue
                _, _, a, z = word_hashes([t])
                held: list[list[int]] = []
                for p in parts:
                    if held and held[-1][1] == p["first"]:
                        held[-1][1] += p["words"]
                    else:
                        held.append([p["first"], p["first"] + p["words"]])
                out.append("\n".join(t[a[x] : z[y - 1]].decode() for x, y in held))
            new = {text: pa.array(out, pa.string())}
            if n_chars:
                new[n_chars] = pa.array(list(map(len, out)), pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in inner], inner)

    cut = cut.withColumn(n_chars, F.col(n_chars).cast("long")) if n_chars else cut
    cut = cut.select(*inner, "size", "runs")
    return cut.mapInArrow(released(run), cut.select(*inner).schema).toDF(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(sized(table(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken", "source")
