"""Language ID by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over hashed byte n-grams says which half of the
languages a text is from. The classifiers are Bernoulli-free (multinomial) naive Bayes: a bit's weight of an n-gram is the
log ratio of its mean frequency in the languages with the bit set and in those without, so all bits come from one table of
n-gram counts by language, which is counted over every labelled training document (no sample). Decoding takes the codeword
of least loss, each bit's logistic loss weighted by how well the bit separates its halves; a text whose second-best codeword
is nearly as near is flagged as ambiguous.

Nulls and ties: null text, and text without a letter, is `und` with score 0 and not ambiguous; documents without a label or
a letter are not learned from; with no label at all everything is `und`; with one label everything with a letter is
that language, score 1. Equal losses go to the first label by code point. Rows of equal doc_id are predicted one by one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, released, small_batches, table, texts

ORDERS, BUCKETS, STRENGTH = (1, 2, 3, 4), 1 << 12, 40.0
FEATURES = len(ORDERS) * BUCKETS
SMOOTH, AMBIGUOUS = 0.5, 0.6
MOST_DOCS = 128

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def features(values: list[bytes]) -> np.ndarray:
    """n-gram counts of each text, (texts, FEATURES): runs of letters, with one blank between, of whole texts."""
    joined = _CLASS[np.frombuffer(b" ".join(values) + b" ", np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)
    of = np.repeat(np.arange(len(values)), np.diff(ends, prepend=0))
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32) | (of[1:] != of[:-1])
    x, of = joined[keep].astype(np.uint32), of[keep]
    out = np.zeros((len(values), FEATURES), np.float32)
    code = np.zeros(len(x), np.uint32)
    for i, n in enumerate(ORDERS):
        size = len(x) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint32(256) + x[n - 1 :] if i else x.copy()
        h = (code * np.uint32(2654435761)) >> np.uint32(20)
        ok = of[:size] == of[n - 1 :]
        at = of[:size][ok] * BUCKETS + h[ok].astype(np.int64)
        out[:, i * BUCKETS : (i + 1) * BUCKETS] = np.bincount(at, minlength=len(values) * BUCKETS).reshape(len(values), BUCKETS)
    return out


def _blocks(values: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in in_chunks(values):
        for c in range(a, b, MOST_DOCS):
            yield c, min(b, c + MOST_DOCS)


def count_by_language(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows with a lang and a text; a task sends one array for each language it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs, values = b.column("lang").to_pylist(), texts(b.column("text"))
            some = [i for i, t in enumerate(values) if has_letter(t)]
            langs, values = [langs[i] for i in some], [values[i] for i in some]
            for at, to in _blocks(values):
                x = features(values[at:to])
                for lang in set(langs[at:to]):
                    mine = x[[i for i, v in enumerate(langs[at:to]) if v == lang]].sum(0, dtype=np.float64).astype(np.int64)
                    held[lang] = held[lang] + mine if lang in held else mine
        for lang, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.list_(pa.int64()))], ["lang", "n"])

    small_batches(docs.sparkSession)
    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(released(run), "lang string, n array<bigint>").select("lang", F.posexplode("n").alias("feature", "n"))
    return counts.filter("n > 0").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: exhaustive codes up to 7 languages, else the best of seeded random codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, np.float64).T.reshape(n, -1)
    rnd, best, most = np.random.default_rng(7), None, -1
    length = 15 * int(np.ceil(np.log2(n)))
    for _ in range(50):
        code = rnd.choice([1.0, -1.0], (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        near = (code.shape[1] - (code @ code.T)) / 2 + np.eye(n) * length
        if near.min() > most:
            best, most = code, near.min()
    return best


class Model:
    """langs; weights (FEATURES, bits); the bits' weights in the loss; codewords (langs, bits)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + SMOOTH) / (counts + SMOOTH).reshape(len(langs), len(ORDERS), BUCKETS).sum(2).repeat(BUCKETS, 1).reshape(counts.shape) if len(langs) else counts
        one = [p[self.code[:, j] > 0].mean(0) for j in range(self.code.shape[1])]
        two = [p[self.code[:, j] < 0].mean(0) for j in range(self.code.shape[1])]
        self.weights = np.array([np.log(a / b) for a, b in zip(one, two, strict=True)], np.float32).T.reshape(FEATURES, -1)
        apart = np.array([((a - b) * np.log(a / b)).sum() for a, b in zip(one, two, strict=True)])
        self.bit_weight = apart / apart.mean() if len(apart) and apart.mean() > 0 else np.ones(len(apart))

    def margins(self, values: list[bytes]) -> np.ndarray:
        """Mean log ratio of each bit, in units of STRENGTH n-grams; short texts count for what they have."""
        x = features(values)
        n = x.sum(1, dtype=np.float64)
        return (x @ self.weights).astype(np.float64) / np.maximum(n, 1)[:, None] * np.minimum(n, STRENGTH)[:, None]

    def predict(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of each text."""
        m = self.margins(values)
        loss = np.stack([(np.logaddexp(0, -m * c) * self.bit_weight).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        e = np.exp(loss.min(1, keepdims=True) - loss)
        score = e.max(1) / e.sum(1)
        return best, score, score < AMBIGUOUS


def fit(docs: DataFrame) -> Model:
    """docs (lang, text); a row for each language and feature comes to the driver."""
    found = count_by_language(docs).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), FEATURES))
    counts[found["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy(np.int64), found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; the other columns pass through."""
    names = [f.name for f in docs.schema.fields if f.name not in ("lang_pred", "score", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            values = texts(b.column("text"))
            known = np.fromiter(map(has_letter, values), bool, len(values))
            lang, score, unsure = np.full(len(values), "und", object), np.zeros(len(values)), np.zeros(len(values), bool)
            if model.langs:
                for at, to in _blocks(values):
                    which = at + np.flatnonzero(known[at:to])
                    if len(which):
                        best, score[which], unsure[which] = model.predict([values[i] for i in which])
                        lang[which] = np.array(model.langs, object)[best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(released(run), f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs.filter("not held_out").select("lang", "text"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
