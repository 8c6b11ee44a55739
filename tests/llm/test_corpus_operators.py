"""Token stores, mixing, near-dedup, chat collapse, decontamination and the pipeline against brute-force versions."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import BODY
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quadspark.llm import chat, common, decontaminate, mixing, near_dups, queries, token_store

LAST = (1 << 63) - 1

# --- words -----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\x0b\x1cé", max_size=20), min_size=1, max_size=5))
def test_word_hashes(texts):
    values = [t.encode() for t in texts]
    h, of, a, z = common.word_hashes(values)
    expected = [(i, w) for i, t in enumerate(values) for w in t.lower().split()]
    assert [(i, values[i][x:y].lower()) for i, x, y in zip(of, a, z, strict=True)] == expected
    names = {}
    for x, (_, w) in zip(h.tolist(), expected, strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


# --- token ids -------------------------------------------------------------------------------------------------------


def check_tokens(rows, docs):
    t = token_store.encoder(token_store.vocabulary_path()).tokenizer
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in docs]
    sums = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sums
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_query(spark, sf_dir, plain):
    check_tokens(queries.QUERIES["op1_token_ids"](spark, sf_dir).collect(), plain)


def test_token_edges(edge, empty):
    check_tokens(token_store.stored_tokens(edge).collect(), [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert token_store.stored_tokens(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("aAbé .,'!<|>0\n\t\x0b\x1c\xa0İΣς̌K")) | st.sampled_from(["<|endoftext|>", "<|STARTOFTEXT|>", "'s"]), max_size=30).map("".join))
def test_cached_encoding_is_the_tokenizers(text):
    e = token_store.encoder(token_store.vocabulary_path())
    assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_all_letters():
    """Random strings over all of Unicode, and letters whose lower case is longer before a point."""
    e, r = token_store.encoder(token_store.vocabulary_path()), random.Random(3)
    assert e.plain
    near = [*"abzAZ .,'!<|>09\n\t\x0b\x1c\xa0İıßſKÅÉé×÷ªº\xadΣςŉǰΐẖ", "\u0301", "\u0307", "I\u0307", "'ll", "<|endoftext|>"]

    def some():
        x = r.random()
        c = r.randrange(0x110000) if x > 0.85 else r.randrange(0x20, 0x600)
        return r.choice(near) if x < 0.6 else "" if 0xD800 <= c < 0xE000 else chr(c)

    texts = ["TBMMİ.", "TBMMİ, x", "É.Ç!!", "don't.", "a<|b", *("".join(some() for _ in range(r.randint(1, 25))) for _ in range(12_000)), *(f"a{chr(c)}. {chr(c)}, x{chr(c)}y." for c in range(0x20, 0x2100))]
    for t in texts:
        assert np.frombuffer(e.encode(t.encode()), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_encoder_agrees_on_words_with_points_and_long_ones():
    e = token_store.WordEncoder(token_store.vocabulary_path(), most=5)
    words = ["word,", "Word!!", "a<|", "a<|endoftext|>", "end<||>", "don't.", "x'", "a'!", "ABC.", "été!", "x_", "a.b.", "7,", "a1!", "...", "a\x7f!", "a\x00.", "q" * 70, "q" * 70 + "!", "é" * 40 + ".", "ΑΒ!", "İ."]
    for w in [*words, *words]:
        assert np.frombuffer(e.encode(w.encode()), e.dtype).tolist() == e.tokenizer.encode(w, add_special_tokens=False).ids, w
    assert not any(len(w) > e.KEPT for w in (*e, *e.old))
    e.forget()
    assert not e and not e.old


def test_word_encoder_keeps_the_words_of_a_large_text():
    """300,000 words pass the model once; with 240,000 kept at most, a second reading passed it again with all of them."""
    e, calls = token_store.WordEncoder(token_store.vocabulary_path()), []
    text = " ".join(("a" + np.base_repr(i, 26).translate({48 + d: 81 + d for d in range(10)})).lower() for i in range(300_000)).encode()
    first, model = e.encode(text), e.model

    class Counted:
        def tokenize(self, part):
            calls.append(part)
            return model.tokenize(part)

    e.model = Counted()
    assert e.encode(text) == first
    assert not calls



@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(1, 20))
def test_rans_roundtrip(ids, lanes):
    ids = np.array(ids, np.uint16)
    coder = token_store.Coder(*token_store.quantised(np.bincount(ids, minlength=41)), lanes=lanes, every=3)
    block = coder.encode(ids)
    assert coder.decode(block).tolist() == ids.tolist()
    n = -(-len(ids) // max(1, min(lanes, -(-len(ids) // 64))))
    parts = [coder.decode(block, i, i + 1) for i in range(-(-n // 3))]
    assert [x for p in parts for x in p.tolist()] == ids.tolist()


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint16) % 7
    coder = token_store.Coder(*token_store.quantised(np.bincount(ids)))
    block = bytearray(coder.encode(ids))
    block[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(bytes(block))
    other = token_store.Coder(*token_store.quantised(np.arange(1, 8)))
    with pytest.raises(ValueError, match="another frequency table"):
        other.decode(coder.encode(ids))


def test_quantised_sums():
    for counts in ([0], [5], [1] * 50_000, [10**9, *[1] * 3000], [0, 3, 0]):
        bits, f = token_store.quantised(np.array(counts))
        assert f.sum() == 1 << bits and all((f > 0) | (np.array(counts) == 0))


def test_parts_carry_their_counts(edge):
    """Counting reads a row of counts for each part, not all ids again; blocks are cut as before."""
    rows = token_store.tokenised(edge, token_store.vocabulary_path(), block_tokens=50).collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows])
    assert len(rows) > len({r["part"] for r in rows}) and max(len(r["ids"]) for r in rows) > 100
    last = {r["part"]: r["seq"] for r in rows if r["counts"] is not None}
    assert last == {p: max(r["seq"] for r in rows if r["part"] == p) for p in {r["part"] for r in rows}}
    counts = token_store.token_counts(token_store.tokenised(edge, token_store.vocabulary_path(), block_tokens=50))
    assert counts.tolist() == np.bincount(ids).tolist()


def test_the_coder_gathers_once_an_id():
    """A decoding step looks tables up by slot; symbols are looked up once for all steps."""
    ids = np.arange(5000, dtype=np.uint16) % 7
    coder = token_store.Coder(*token_store.quantised(np.bincount(ids)))
    assert coder.decode(coder.encode(ids)).tolist() == ids.tolist()
    assert (coder._slot_freqs == coder.freqs[coder._symbols]).all() and len(coder._slot_adds) == 1 << coder.bits


# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    weights, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)
    fixed = {i: 0.0 for i, s in enumerate(sizes) if not s}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: 3.0 * sizes[i] for i in over}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    got = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert got == pytest.approx(brute_targets(sizes)) and sum(got) == pytest.approx(sum(sizes))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 60))
def test_permutation(n, key):
    x = np.arange(n)
    assert sorted(mixing.permuted(x, np.full(n, n), np.full(n, key))) == x.tolist()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 5), st.integers(1, 2000), st.floats(0, 3), st.integers(1, 70))
def test_slots_give_the_words_due(src, size, share, block):
    """All blocks of a source, taken slot by slot: as often as each other up to one, and the due words together."""
    due, blocks = round(size * share), -(-size // block)
    many, cut = mixing.slots_for(src, due, size, block, 7)
    slot, n = np.arange(many), np.full(many, blocks)
    took = mixing.permuted(slot % blocks, n, mixing.pass_key(np.full(many, src), slot // blocks, 7))
    words = np.minimum((took + 1) * block, size) - took * block
    if many:
        words[-1] = min(words[-1], cut)
        assert cut > 0 and mixing.permuted(took, n, mixing.pass_key(np.full(many, src), slot // blocks, 7), back=True).tolist() == (slot % blocks).tolist()
    assert words.sum() == due and (not many or np.ptp(np.bincount(took, minlength=blocks)) <= 1)


def test_draw():
    out = mixing.draw([100, 0, 7, 900], 16, 1)
    assert out.sum(0).tolist() == [100, 0, 7, 900] and out.sum(1).max() - out.sum(1).min() <= 1


def check_mix(rows):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, n, t in zip(names, sizes, brute_targets(sizes), strict=True):
        assert {r["source_size"] for r in by[s]} == {n} and {round(r["target"], 6) for r in by[s]} == {round(t, 6)}
        assert abs(sum(r["taken"] for r in by[s]) - t) <= 0.5


def test_mixing_query(spark, sf_dir, plain):
    rows = queries.QUERIES["op2_mixing"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((i, len((t or "").encode().split())) for i, t in plain)
    check_mix(rows)
    assert sorted(map(tuple, queries.QUERIES["op2_mixing"](spark, sf_dir).collect())) == sorted(map(tuple, rows))


def test_mixing_edges(edge, empty):
    rows = mixing.taken(mixing.mix(mixing.sized(edge))).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in edge.collect())
    check_mix(rows)
    assert mixing.taken(mixing.mix(mixing.sized(empty))).count() == 0


def test_small_sources_give_their_targets(spark):
    """Sources of a few words, of one word, of less than a block: each gives its target to the word, no document over three times."""
    docs = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(70, "a"), (3, "b"), (1, "c"), (65, "d"), (20, "a"), (30, None), (0, "e"), (2000, "f"), (500, "b")])]
    rows = mixing.taken(mixing.mix(mixing.sized(spark.createDataFrame(docs, "doc_id long, text string, source string")))).collect()
    check_mix(rows)


def test_clashing_names_survive_the_mix(spark):
    names = ["size", "src", "start", "th", "id", "runs", "c0", "block", "words", "pass", "a.b"]
    docs = spark.createDataFrame([(i, f"one two three number {i}", "a", *range(len(names))) for i in range(20)], ["doc_id", "text", "source", *names])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}


def test_mixed_documents_have_the_taken_words(edge, documents):
    for docs in (edge, documents):
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        words = defaultdict(int)
        for r in out.collect():
            words[r["doc_id"]] += len(r["text"].encode().split())
            assert r["n_chars"] == len(r["text"])
        taken = defaultdict(int)
        for r in mixing.taken(mixing.mix(mixing.sized(docs).withColumn("th", F.xxhash64("text")))).collect():
            taken[r["doc_id"]] += r["taken"]
        dup = {7} if docs is edge else set()
        assert {k: v for k, v in words.items() if k not in dup} == {k: v for k, v in taken.items() if v and k not in dup}


# --- near duplicates -------------------------------------------------------------------------------------------------


def dups_brute(docs, k):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((LAST if i is None else i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, p), (b, q) in combinations(sets, 2):
        if p and q and 100 * len(p & q) >= 80 * len(p | q):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    null = lambda i: None if i == LAST else i
    return sorted(((null(i), len(s), null(root(i)), root(i) == i) for i, s in sets), key=repr)


def dups(docs, k):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_dups(docs, k).collect()), key=repr)


def test_near_dups_query(spark, sf_dir, plain):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.QUERIES["op3_near_dups"](spark, sf_dir).collect()), key=repr)
    assert got == dups_brute(plain, 2)


def test_near_dups_edges(edge, empty):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert dups(edge, 2) == dups_brute(docs, 2)
    assert dups(empty, 2) == []


def test_chains_and_clusters_of_near_copies(spark):
    """Chains whose ends are unlike, many copies of one text with edits around the threshold, exact copies."""
    r = random.Random(6)
    docs, base = [], [f"w{r.randint(0, 400)}" for _ in range(60)]
    chain = list(base)
    for i in range(12):
        docs.append((1000 - i, " ".join(chain)))
        at = r.randrange(50)
        chain[at : at + 2] = [f"c{i}", f"d{i}"]
    for i in range(120):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(60)] = f"x{r.randint(0, 30)}"
        docs.append((i, " ".join(t)))
    docs += [(2000 + i, docs[30][1].upper()) for i in range(20)] + [(3000 + i, f"short {i % 3}") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert dups(df, 2) == dups_brute(docs, 2)


def test_superminhash_is_that_of_one_shingle_at_a_time():
    """The breadth-first signature equals the sequential one without early stopping."""
    e, m = np.random.default_rng(8).integers(0, 1 << 63, 9).astype(np.uint64), 48
    sig = [(1 << 64) - 1] * m
    for x in e:
        p = list(range(m))
        for j in range(m):
            h = int(common.mix64(np.array([x]) + np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))[0])
            k = j + (h >> 40) % (m - j)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], j << 40 | h & (1 << 40) - 1)
    assert near_dups.superminhash([e], m)[0].tolist() == sig


def test_similarity_estimates():
    u = np.random.default_rng(3).integers(0, 1 << 63, 900).astype(np.uint64)
    errors = []
    for i in range(30):
        a, b = np.unique(u[i : i + 200]), np.unique(u[i + 40 : i + 240])
        s = near_dups.superminhash([a, b], 288)
        errors.append((s[0] == s[1]).mean() - 160 / 240)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


# --- chat ------------------------------------------------------------------------------------------------------------


def test_chat_edges(spark):
    x = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (3, 2, "u", None), (4, 0, "u", "hi"), (4, 1, "a", "yo"), (4, 2, "u", ""), (5, 0, None, "hi"), (None, 0, "z", "z"), (None, 1, "z", "z"), (6, 0, "z", "z"), (6, 0, "z", "z"), (7, None, "q", ""), (8, 0, "u", "hi"), (8, 1, "a", "yo"), (8, 2, "u", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in x], "conv_id long, turn long, role string, text string, n long, h0 string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.collapse(df).collect()}
    assert got == {3: (3, 1), 4: (3, 2), 5: (1, 1), 6: (2, 2), 7: (1, 1)}
    assert chat.collapse(df.filter("false")).count() == 0
    text = chat.collapse(df.filter("conv_id = 1")).select(chat.render(F.col("turns"))).first()[0]
    assert text == "<|u|>\nhi<|end|>\n<|a|>\nyo<|end|>\n"


# --- decontamination -------------------------------------------------------------------------------------------------


def leaks_brute(docs, items, k=decontaminate.K):
    """Every window of every item, compared exactly."""
    split = lambda t: (t or "").encode().lower().split()
    bag = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    bags = {i: bag(split(t)) for i, t in items}
    n = Counter(s for _, t in items for s in bag(split(t)))
    weight = lambda s: 1 / n[s] if n[s] else 1.0
    out = set()
    for d, t in docs:
        w = split(t)
        for i, u in items:
            x = split(u)
            if not x or not w:
                continue
            if len(x) < k or len(w) < k:
                if x == w and len(x) < k:
                    out.add((d, i, 1.0, 0))
                continue
            best, size = (0.0, 0), min(len(x), len(w))
            for a in range(len(w) - size + 1):
                b = bag(w[a : a + size])
                if not b.keys() & bags[i].keys():
                    continue
                both = sum(min(b[s], bags[i][s]) * weight(s) for s in b)
                s = both / (sum(c * weight(s) for s, c in b.items()) + sum(c * weight(s) for s, c in bags[i].items()) - both)
                best = max(best, (s, -a))
            if best[0] >= decontaminate.THRESHOLD:
                out.add((d, i, round(best[0], 9), -best[1]))
    return out


def found(docs, items):
    rows = decontaminate.leaks(docs, items).select("doc_id", F.inline("leaks")).collect()
    return {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in rows}


def test_decontaminate_query(spark, sf_dir, plain):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = queries.QUERIES["op6_decontaminate"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in rows} == leaks_brute(plain, items)


def test_decontaminate_edges(spark, edge, empty):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    items = [(1, BODY), (2, None), (3, " "), (4, "ONE"), (5, "x a shared"), (6, long.strip()), (6, long.strip()), (7, "a shared line of text here")]
    near = long.split()
    near[39] = "changed"
    docs = [(100, "before " + " ".join(near) + " after"), (101, long.upper() + long), (102, "nothing like it at all but words"), (103, " ".join(long.split()[:30]))]
    df = edge.unionByName(spark.createDataFrame(docs, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = found(df, bench)
    assert got == leaks_brute(every, items)
    assert {d for d, *_ in got} >= {5, 6, 7, 11, 100, 101} and not {d for d, *_ in got} & {102, 2, 3, 10}
    assert found(empty, bench) == set() and found(edge, bench.filter("false")) == set()


@pytest.mark.parametrize("at_once", [1 << 14, 0])
def test_multi_index_finds_all_within_the_radius(at_once, monkeypatch):
    monkeypatch.setattr(decontaminate.MultiIndex, "AT_ONCE", at_once)
    r = np.random.default_rng(1)
    a, b = r.integers(0, 256, (40, 16), np.uint8), r.integers(0, 256, (30, 16), np.uint8)
    b[:10] = a[:10]
    b[:10, :4] ^= r.integers(0, 256, (10, 4), np.uint8)
    index = decontaminate.MultiIndex(a, decontaminate.RADIUS)
    d = (np.unpackbits(b, 1)[:, None] != np.unpackbits(a, 1)[None]).sum(2)
    assert set(zip(*index.within(b), strict=True)) == set(zip(*np.nonzero(d <= decontaminate.RADIUS), strict=True))


def test_items_in_several_blocks(spark, documents, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {(d, i) for d, i, *_ in found(documents, bench)}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    assert {(d, i) for d, i, *_ in found(documents, bench)} == one


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, documents):
    docs = documents.unionByName(spark.createDataFrame([(10**6, "1234 !", "en", "z", 6), (10**6 + 1, None, None, None, None)], documents.schema))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        rows = out.collect()
        if name != "token_ids":
            assert out.columns == documents.columns
            clash = ["score", "lang_pred", "ambiguous", "leaks", "id", "th", "row", "_id", "_size", "size"]
            wide = stage(spark, docs.withColumns({n: F.lit(77) for n in clash}), sf_dir)
            assert wide.columns == [*documents.columns, *clash] and {tuple(r) for r in wide.select(*clash).distinct().collect()} == {(77,) * len(clash)}
        ids = {r["doc_id"] for r in rows}
        if name == "language_id":
            assert ids == {i for i, _ in before} - {10**6, 10**6 + 1}
        elif name == "near_dups":
            assert ids == {i for i, _, _, kept in dups_brute(before, 5) if kept}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert ids == {i for i, _ in before} - {d for d, *_ in leaks_brute(before, items)}
        elif name == "token_ids":
            check_tokens(rows, before)
        docs = out


def test_pipeline_run(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and df.count() > 100
