"""Cases in which the training-data operators once did less than the whole job."""

import random
from collections import Counter

import corpus_pipeline
from quadspark.llm import decontaminate, near_dups

# --- decontamination -------------------------------------------------------------------------------------------------


def leaked(docs, items):
    b = decontaminate.Benchmark(items)
    return [{i: round(s, 9) for i, s, _, _ in found} for found in decontaminate._found(b, [t.encode() for t in docs])]


def test_near_copies_of_repeated_items():
    """One word of 100 changed: plain similarity 91 / 101, however often the item stands in the benchmark."""
    words = [f"w{i}" for i in range(100)]
    near = [*words[:50], "changed", *words[51:]]
    for copies in (1, 4, 40):
        (found,) = leaked(["before it " + " ".join(near) + " and after"], [(i, " ".join(words)) for i in range(copies)])
        assert found == dict.fromkeys(range(copies), round(91 / 101, 9))


def test_near_copies_of_items_with_a_template():
    """304 words of template and an own one in each of 10 items; a word of the template is changed: weighted similarity 30.5 / 36."""
    template = [f"t{i}" for i in range(304)]
    items = [(n, " ".join([*template, f"i{n}"])) for n in range(10)]
    words = items[3][1].split()
    for at in range(5, 300, 20):
        (found,) = leaked([" ".join([*words[:at], "changed", *words[at + 1 :]])], items)
        assert 3 in found


def test_weights_count_the_whole_benchmark(spark, monkeypatch):
    """A copy whose template was replaced: its own words are most of the weight only if all items are counted."""
    template = [f"t{i}" for i in range(30)]
    items = [(n, " ".join([*template, *(f"i{n}x{j}" for j in range(40))])) for n in range(12)]
    doc = " ".join(items[5][1].split()[26:])
    docs, bench = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    whole = decontaminate.leaks(docs, bench).first()["leaks"]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 10)
    assert [r["item_id"] for r in whole] == [5] and decontaminate.leaks(docs, bench).first()["leaks"] == whole


# --- near duplicates -------------------------------------------------------------------------------------------------


def test_rows_of_equal_or_null_id_are_documents_of_their_own(spark):
    """Only near copies go: an id says nothing about another row's text."""

    def text(name, changed=None):
        return " ".join(f"{name}{i}" if i != changed else "changed" for i in range(120))

    docs = [(3, text("a")), (7, text("a", 60)), (7, text("b")), (9, text("b", 50)), (5, text("c")), (None, text("c", 40)), (None, text("d")), (None, text("e"))]
    docs += [(None, text("f")), (None, text("f", 70)), (8, text("g")), (8, text("g", 30)), (None, "  "), (None, None), (8, text("h"))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    of = {r["th"]: (r["component_id"], r["kept"]) for r in near_dups.near_dups(df, 5).collect()}
    th = {t: h for t, h in df.selectExpr("text", "xxhash64(coalesce(text, ''))").collect()}
    got = [of[th[t]] for _, t in docs]
    assert got[:8] == [(3, True), (3, False), (7, True), (7, False), (5, True), (5, False), (None, True), (None, True)]
    assert sorted(got[8:10]) == [(None, False), (None, True)] and sorted(got[10:12]) == [(8, False), (8, True)]
    assert got[12:] == [(None, True), (None, True), (8, True)]
    left = sorted(r["text"] or "" for r in corpus_pipeline.one_of_each(spark, df, "").collect())
    assert left == sorted(t or "" for (_, t), (_, kept) in zip(docs, got, strict=True) if kept)


def test_recall_on_templates_and_repeated_items():
    """Items that share a template of any length or stand several times; copies with changed words and template words: every pair at
    0.8 or more in either weighting is found, against a comparison with all windows."""
    r = random.Random(1)
    shingles = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    wanted = got = 0
    for copies, template, own in ((10, 50, 4), (10, 44, 10), (4, 90, 0), (12, 100, 0), (6, 150, 1), (1, 60, 0)):
        items = [(n, " ".join([*(f"t{i}" for i in range(template)), *(f"i{n}x{j}" for j in range(own))])) for n in range(copies)]
        b, n = decontaminate.Benchmark(items), Counter(x for _, t in items for x in set(shingles(t.split())))
        for _ in range(40):
            w = items[r.randrange(copies)][1].split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            w = [*(f"p{r.randrange(9999)}" for _ in range(40)), *w, *(f"p{r.randrange(9999)}" for _ in range(40))]
            found = {i for i, *_ in decontaminate._found(b, [" ".join(w).encode()])[0]}
            s = shingles(w)
            for i, t in items:
                bag, best = Counter(shingles(t.split())), 0.0
                m = sum(bag.values())
                for a in range(len(s) - m + 1):
                    mine = Counter(s[a : a + m])
                    for weight in (lambda x: 1 / n[x] if n[x] else 1.0, lambda x: 1.0):
                        both = sum(min(c, bag[x]) * weight(x) for x, c in mine.items())
                        best = max(best, both / (sum(c * weight(x) for x, c in mine.items()) + sum(c * weight(x) for x, c in bag.items()) - both))
                wanted += best >= 0.8
                got += best >= 0.8 and i in found
                assert best >= 0.8 or i not in found
    assert wanted > 300 and got == wanted


def test_long_repetitive_texts_in_pieces(monkeypatch):
    """A text that repeats an item, over many pieces; passages around the pieces' ends; repeated shingles inside windows."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 64)
    item = " ".join(f"a{i % 13}" for i in range(50))
    other = " ".join(f"b{i}" for i in range(30))
    filler = [f"f{i}" for i in range(400)]
    b = decontaminate.Benchmark([(1, item), (2, other)])
    assert [(i, s) for i, s, _, _ in decontaminate._found(b, [(f"{item} " * 200).encode()])[0]] == [(1, 1.0)]
    for at in range(20, 140, 3):
        text = " ".join([*filler[:at], other, *filler[at:]])
        assert decontaminate._found(b, [text.encode()])[0] == [(2, 1.0, at, 30)]
