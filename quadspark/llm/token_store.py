"""Token-ID output: documents as token ids in blocks of interleaved range asymmetric numeral systems (rANS).

A store is a folder of two Parquet tables, so Spark's commit protocol writes it and any reader of Spark's can open it:

- `table`: one row, the shared frequency table of all blocks (`bits`, and `freqs` by token id, summing to 2^bits);
- `blocks`: part, seq, offset (ids of the part before the block), doc_ids, lens (ids of each document, end id included),
  n_tokens and the block's bytes.

A block holds whole documents, about BLOCK_TOKENS ids, and can be decoded alone. Its bytes (little-endian):
`QRNS`, u16 version, u16 bits, u32 lanes, u32 checkpoint steps, u64 ids, u32 crc32 of the table, u32 crc32 of the ids as
u32, u32 crc32 of all that follows, u32 checkpoints, u32 words; u64 state[lanes]; for each checkpoint u32 words read before
it and u64 state[lanes]; u32 word[words]. Id i belongs to lane i mod lanes; a step decodes one id of every lane; a lane whose
state is under 2^31 then takes the next word. A checkpoint stands before every `checkpoint steps`-th step, so parts of a
block can be decoded in parallel.

Documents are stored in ascending doc_id order: parts are ranges of doc_id, blocks of a part follow by seq.

Nulls and ties: null text is empty, so the document is its end id alone; null doc_id comes first; rows of equal doc_id follow
each other by the hash of their text. Other columns are ignored. An empty table makes a store without blocks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, shared_dir, stored, table, texts

END_ID, BLOCK_TOKENS, LANES, CHECKPOINT_STEPS = 1, 1 << 18, 1024, 128
HEAD, MAGIC, VERSION = struct.Struct("<4sHHIIQIIIII"), b"QRNS", 1
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


# --- tokens ----------------------------------------------------------------------------------------------------------


#: The normaliser and pre-tokenizer under which the short cuts below are exact.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Characters that normalisation maps one to one (by lower-casing alone), but for the apostrophe, which has patterns of its own.
_SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
#: What the pre-tokenizer makes of such characters: runs of letters, single digits, runs of others.
_PARTS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level letters of À to ÿ: a byte that is no printable Latin-1 character stands for one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder(dict):
    """Token ids of texts, the same as the tokenizer's, by words.

    With the plain normaliser and pre-tokenizer nothing is joined across ASCII white space, so texts are cut there and each
    word's ids are kept, as rare words take most of the time: two generations of at most `most` words of up to KEPT bytes,
    usually about 130 MB in all. A word of simple characters is cut into the pre-tokenizer's parts, kept on their own, and
    the model gets each as it stands. All else goes through the whole tokenizer. A-Z are
    lowered first, but not in texts with combining marks (normalisation comes before lowering there) nor in those that may
    hold special tokens. With any other tokenizer whole texts are encoded as they are.
    """

    KEPT = 64
    MARKS = bytes(range(0xCC, 0x100))
    LETTERS = _byte_letters()
    #: ASCII characters of which the pre-tokenizer makes one part after letters; not the apostrophe.
    POINTS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab().values(), default=0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.bytes_of = [i.to_bytes(self.dtype.itemsize, "little") for i in range(top + 1)]
        self.most, self.old, self.model = most, {}, self.tokenizer.model
        what = json.loads(self.tokenizer.to_str())
        steps = (what["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = {"type": "Split", "pattern": {"Regex": PLAIN_PATTERN}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        special = all(t["content"].startswith("<|") and not t["content"][2:].isspace() for t in what["added_tokens"])
        self.plain = what["normalizer"] == PLAIN_NORMALIZER and steps == [split, level] and what["model"]["type"] == "BPE" and what["post_processor"] is None and special

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isalpha():  # of bytes: ASCII letters only
                ids = self._modelled(piece.lower().decode())
            elif (word := piece.rstrip(self.POINTS)).isalpha() and b"<|" not in piece:
                ids = self[word] + self[piece[len(word) :]]
            else:
                ids = self._other(piece.decode("utf-8", "replace"))
        if len(piece) > self.KEPT:
            return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _other(self, s: str) -> bytes:
        if not _SIMPLE.fullmatch(s) or "<|" in s:
            return self._packed(self.tokenizer.encode(s, add_special_tokens=False).ids)
        parts = _PARTS.findall(s)
        if len(parts) > 1:
            return b"".join([self[p.encode()] for p in parts])
        return self._modelled(s.lower().translate(self.LETTERS))

    def _modelled(self, part: str) -> bytes:
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(part)])

    def forget(self) -> None:
        """Frees the kept words: the worker process goes on to other work."""
        self.clear()
        self.old = {}

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: bytes) -> bytes:
        if not self.plain:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()
        if b"<|" not in text and len(text.translate(None, self.MARKS)) == len(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """The worker process goes on to other work. A function of the module, as a task's own function gets a pickled copy of a global."""
    _encoders.clear()


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(part, seq, offset, doc_ids, lens, ids, counts): runs of whole documents in ascending doc_id order; ids as little-endian bytes.

    The last row of a part also has how often each id stands in all of the part, as little-endian i64; counts is null in the others.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("offset", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        end, wide = np.array([end_id], code.dtype).tobytes(), code.dtype.itemsize
        seq = offset = held = 0
        doc_ids, lens, parts = [], [], []
        counts = np.zeros(max(len(code.bytes_of), end_id + 1), "<i8")

        def row(last: bool = False) -> pa.RecordBatch:
            ids = b"".join(parts)
            counts[:] += np.bincount(np.frombuffer(ids, code.dtype), minlength=len(counts))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, seq, offset, doc_ids, lens, ids, counts.tobytes() if last else None), schema, strict=True)], schema=schema)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                if held >= block_tokens:
                    yield row()
                    seq, offset, held, doc_ids, lens, parts = seq + 1, offset + held, 0, [], [], []
                ids = code.encode(t) + end
                doc_ids.append(d)
                lens.append(len(ids) // wide)
                parts.append(ids)
                held += lens[-1]
        if doc_ids:
            yield row(last=True)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = docs.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return order.mapInArrow(released(run), "part int, seq int, offset long, doc_ids array<bigint>, lens array<bigint>, ids binary, counts binary")


def token_counts(tokens: DataFrame, dtype: str = "<i8") -> np.ndarray:
    """How often each id stands in all of tokens, from the parts' counts; a row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        n = np.zeros(0, np.int64)
        for b in batches:
            for counts in b.column(0).drop_null().to_pylist():
                x = np.frombuffer(counts, dtype).astype(np.int64)
                n = n + x if len(n) else x
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["id", "n"])

    found = tokens.select("counts").mapInArrow(released(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


# --- the coder -------------------------------------------------------------------------------------------------------


def quantised(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, frequencies that sum to 2^bits): every id that occurs has at least 1."""
    used, total = int((counts > 0).sum()), int(counts.sum())
    bits = max(14, int(np.ceil(np.log2(max(used, 1)))) + 2)
    size = 1 << bits
    if not total:
        return bits, np.eye(1, len(counts), dtype=np.int64)[0] * size
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size // total), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    extra, i = size - int(f.sum()), 0
    if extra > 0:
        f[order[0]] += extra
    while extra < 0:  # too many rare ids were raised to 1: the common ones give
        take = min(-extra, int(f[order[i]]) // 2)
        f[order[i]] -= take
        extra += take
        i = (i + 1) % used
    return bits, f


class Coder:
    """Encodes and decodes blocks of ids with one frequency table."""

    def __init__(self, bits: int, freqs: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS):
        self.bits, self.lanes, self.every = bits, lanes, every
        self.freqs = freqs.astype(np.uint64)
        self.begins = np.cumsum(self.freqs) - self.freqs
        self.crc = zlib.crc32(struct.pack("<H", bits) + freqs.astype("<u4").tobytes())
        self._symbols = self._slot_freqs = self._slot_adds = None

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(self.lanes, -(-n // 64)))
        f, c = self.freqs[ids], self.begins[ids]
        gaps = np.uint64(1 << self.bits) - f
        if (f == 0).any():
            raise ValueError("an id that the table doesn't have")
        most = f << np.uint64(63 - self.bits)
        state, words, marks = np.full(lanes, _LOW, np.uint64), [], []
        steps = -(-n // lanes)
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, t * lanes + lanes)
            x = state[: b - a]
            over = np.flatnonzero(x >= most[a:b])
            full = x[over]
            words.append(full.astype("<u4"))  # the low half
            x[over] = full >> _32
            q = x // f[a:b]  # the new state: (q << bits) + x - q * f + c
            q *= gaps[a:b]
            x += q
            x += c[a:b]
            if t and t % self.every == 0:
                marks.append((t, state.copy()))
        counts = np.cumsum([0, *(len(w) for w in reversed(words))])
        points = b"".join(struct.pack("<I", counts[t]) + s.astype("<u8").tobytes() for t, s in reversed(marks))
        body = state.astype("<u8").tobytes() + points + b"".join(w.tobytes() for w in reversed(words))
        return HEAD.pack(MAGIC, VERSION, self.bits, lanes, self.every, n, self.crc, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body), len(marks), int(counts[-1])) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The block's ids as u32; with first and last, those between two checkpoints (numbers from 0, the start)."""
        magic, version, bits, lanes, every, n, table_crc, ids_crc, body_crc, points, n_words = HEAD.unpack_from(block)
        body = memoryview(block)[HEAD.size :]
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        if table_crc != self.crc or bits != self.bits:
            raise ValueError("the block belongs to another frequency table")
        if zlib.crc32(body) != body_crc:
            raise ValueError("the block is damaged")
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs.astype(np.int64))
            self._slot_freqs = self.freqs[self._symbols]
            self._slot_adds = np.arange(1 << bits, dtype=np.uint64) - self.begins[self._symbols]
        size = 4 + 8 * lanes
        words = np.frombuffer(body, "<u4", n_words, 8 * lanes + points * size)
        at, begin, end = 0, first * every, -(-n // lanes) if last is None else min(last * every, -(-n // lanes))
        state = np.frombuffer(body, "<u8", lanes).copy()
        if first:
            p = 8 * lanes + (first - 1) * size
            at, state = struct.unpack_from("<I", body, p)[0], np.frombuffer(body, "<u8", lanes, p + 4).copy()
        out, mask, bits = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32), np.uint64((1 << bits) - 1), np.uint64(bits)
        for t in range(begin, end):
            a, b = t * lanes, min(n, t * lanes + lanes)
            x = state[: b - a]
            slot = (x & mask).view(np.int64)
            out[a - begin * lanes : b - begin * lanes] = slot
            x >>= bits
            x *= self._slot_freqs[slot]
            x += self._slot_adds[slot]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _32) | words[at : at + len(low)]
            at += len(low)
        out = self._symbols[out]
        if first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("the decoded ids don't match their checksum")
        return out


_coders: dict[int, Coder] = {}


def _coder(bits: int, freqs: bytes) -> Coder:
    key = zlib.crc32(freqs, bits)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(bits, np.frombuffer(freqs, "<u4"))
    return _coders[key]


# --- stores ----------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenises docs (doc_id, text) with the vocabulary file and writes a store to path."""
    spark = docs.sparkSession
    code = encoder(vocabulary)
    tokens = stored(tokenised(docs, vocabulary, end_id, block_tokens), "tokens", "snappy")
    dtype = code.dtype.str
    bits, freqs = quantised(token_counts(tokens))
    packed = freqs.astype("<u4").tobytes()
    shared = spark.sparkContext.broadcast(packed)
    names = ["part", "seq", "offset", "doc_ids", "lens", "n_tokens", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(bits, shared.value)
        for b in batches:
            ids = [np.frombuffer(x, dtype) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:5]), pa.array([len(x) for x in ids], pa.int64()), pa.array([coder.encode(x) for x in ids], pa.binary())], names)

    spark.createDataFrame([(bits, bytearray(packed))], "bits int, freqs binary").coalesce(1).write.parquet(f"{path}/table")
    tokens.drop("counts").mapInArrow(released(run), "part int, seq int, offset long, doc_ids array<bigint>, lens array<bigint>, n_tokens long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as little-endian u32, and how many ids stand before it."""
    head = spark.read.parquet(f"{path}/table").first()
    bits, shared = head["bits"], spark.sparkContext.broadcast(bytes(head["freqs"]))
    blocks = spark.read.parquet(f"{path}/blocks")
    before, total = [], 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():  # a row a part
        before.append((r["part"], total))
        total += r["n"]
    before = spark.createDataFrame(before, "part int, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(bits, shared.value)
        for b in batches:
            for part, offset, doc_ids, lens, block in zip(*(b.column(n).to_pylist() for n in ("part", "offset", "doc_ids", "lens", "block")), strict=True):
                ids, ends = coder.decode(block).astype("<u4"), np.cumsum(lens)
                at = np.concatenate([[0], ends]) * 4  # of a block's bytes
                if at[-1] < 1 << 31:
                    each = pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
                else:
                    each = pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lens, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(lens), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(offset + ends - lens), pa.array(lens, pa.int64()), each], ["part", "doc_id", "at", "n_tokens", "ids"])

    docs = blocks.select("part", "offset", "doc_ids", "lens", "block").mapInArrow(released(run), "part int, doc_id long, at long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stored_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The contract's columns, from a store that was written to the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary or vocabulary_path())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(table(spark, sf_dir, "documents"))
