"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans. The models add spans: a run of at least MIN_RUN characters of a key alphabet, outside
every base span, is a secret when the log-likelihood ratio of the two first-order character models, per character, is over
the threshold. Both models are trained from labelled samples: random strings of the usual key alphabets (generated from a
seed) against ordinary identifiers, which are words of the corpus (at most SAMPLE_WORDS distinct ones, those of least hash, from
about SAMPLE_DOCS documents, those whose hash is under a bound set by their number) alone and joined the way identifiers are. The threshold is the larger of
a fixed floor and the highest ratio of a held-out quarter of the ordinary sample. Scanning covers every whole text.

Nulls and ties: null text is empty and has no spans; without any corpus words the ordinary sample is a built-in one. Rows
of equal doc_id are scanned one by one. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
WORDS = ("passw", "secret", "token", "api")
LONG = 20
MIN_RUN, FLOOR = 20, 0.25
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_KEYS, SEED = 2000, 20_000, 6000, 11

#: The alphabets that keys are written in.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
#: Ordinary words for a corpus that has none.
ORDINARY = ("account", "address", "background", "configuration", "default", "document", "environment", "example", "function", "information", "language", "management", "message", "network", "parameter", "property", "reference", "request", "response", "resource", "service", "session", "template", "version")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and without overlap of its own."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for at, word in _long_words(text, 24):
        found += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(word) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _long_words(text: str, least: int) -> Iterator[tuple[int, str]]:
    """(start, word) of white-space separated words of at least so many characters; no pattern here spans white space."""
    at = 0
    for w in text.split():
        if len(w) >= least:
            at = text.index(w, at)
            yield at, w
            at += len(w)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of character pairs (random over ordinary), the ratio of a pair not seen, the threshold."""

    ratio: dict[tuple[str, str], float]
    unseen: float
    threshold: float

    def score(self, s: str) -> float:
        get, unseen = self.ratio.get, self.unseen
        return sum([get(p, unseen) for p in zip("^" + s, s, strict=False)]) / max(1, len(s))

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        found = []
        for at, word in _long_words(text, MIN_RUN):
            for m in RUN.finditer(word):
                a, b = at + m.start(), at + m.end()
                if not any(x < b and a < y for x, y, _ in base) and self.score(m[0]) > self.threshold:
                    found.append((a, b, "markov"))
        return found


def _pairs(samples: Iterable[str]) -> Counter:
    return Counter(p for s in samples for p in zip("^" + s, s, strict=False))


def train(keys: list[str], ordinary: list[str], held_out: list[str], smooth: float = 0.05) -> Models:
    """Two add-`smooth` Markov chains over the characters of all samples."""
    a, b = _pairs(keys), _pairs(ordinary)
    chars = {c for p in [*a, *b] for c in p} | set(ALPHABETS[-2] + "-_=+/")
    sums = {}
    for name, x in (("a", a), ("b", b)):
        sums[name] = Counter()
        for (p, _), n in x.items():
            sums[name][p] += n
    n = len(chars)

    def log(x: Counter, total: Counter, p: str, c: str) -> float:
        return math.log2((x[p, c] + smooth) / (total[p] + smooth * n))

    ratio = {(p, c): log(a, sums["a"], p, c) - log(b, sums["b"], p, c) for p in chars for c in chars}
    models = Models(ratio, 0.0, 0.0)
    return Models(ratio, 0.0, max([FLOOR, *map(models.score, held_out)]))


def labelled(words: list[str], seed: int = SEED) -> tuple[list[str], list[str], list[str]]:
    """Random strings, ordinary identifiers, and held-out ordinary identifiers long enough to be candidates."""
    rnd = random.Random(seed)
    keys = ["".join(rnd.choices(ALPHABETS[i % len(ALPHABETS)], k=rnd.randint(20, 64))) for i in range(SAMPLE_KEYS)]
    words = [w for w in sorted(set(words) | set(ORDINARY)) if re.fullmatch(r"[A-Za-z_/=+-]+", w)]
    rnd.shuffle(words)
    cut = max(1, len(words) // 4)
    test, fit = words[:cut], words[cut:] or words

    def made(source: list[str], n: int) -> list[str]:
        out = []
        for i in range(n):
            some = rnd.choices(source, k=rnd.randint(2, 5))
            out.append(("_".join(some), "-".join(some), "/".join(some), "".join(w.capitalize() for w in some), "".join(some), "_".join(some).upper(), some[0] + str(rnd.randint(0, 9999)) + "_" + some[1])[i % 7])
        return out

    return keys, fit + made(fit, len(fit) // 2 + 200), [w for w in test + made(test, len(test) // 2 + 50) if len(w) >= MIN_RUN]


def fit(docs: DataFrame) -> Models:
    """Models from the bounded sample of corpus words that stand outside base spans' alphabets (letters only)."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select("text")
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{3,40}"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS)
    return train(*labelled([r["w"] for r in words.collect()]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) by start, then kind."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                found = base_spans(t)
                base.append([{"kind": k, "start": x, "end": y} for x, y, k in found])
                every.append([{"kind": k, "start": x, "end": y} for x, y, k in sorted(found + models.spans(t, found), key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    count = {f"n_{k}": F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)") for k in KINDS[:3]}
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
