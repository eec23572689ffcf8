from __future__ import annotations

import random

import numpy as np
import pytest

from vitaline.llm import decontaminate as d
from vitaline.llm.queries import QUERIES


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = [rng.randint(-1, 6) for _ in range(rng.randint(0, 60))]
        expected = brute_common(a, [x if x >= 0 else None for x in b])
        assert d.common_words(np.array(a, np.int32), np.array(b, np.int32)) == expected


def test_whole_table_finds_every_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: d.words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: d.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    join = lambda words: b" " + b" ".join(words) + b" "
    copies = {(i, j) for i, t in docs.items() for j, w in items.items() if join(w) in join(t)}
    out = QUERIES["op5_latent_decontamination"](spark, sf).collect()
    assert copies and copies <= {(r.doc_id, r.item_id) for r in out}
    for r in out:  # and nothing that has not most of the words in their order
        assert brute_common(items[r.item_id], docs[r.doc_id][r.start_word : r.end_word]) >= 0.6 * len(items[r.item_id])


def test_basis_is_that_of_a_dense_decomposition(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    items = d.Items([(i, " ".join(rng.sample(words, 12))) for i in range(6)])
    docs = [(i, " ".join(rng.choice(words + ["x"]) for _ in range(150))) for i in range(20)]
    encoded = d.encode(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), items)
    counts = {r.word: r.passages for r in encoded.where("word >= 0").groupBy("word").sum("passages").withColumnRenamed("sum(passages)", "passages").collect()}
    items.weight = np.linspace(0.5, 2, len(items.vocabulary))
    rows, seen = [], np.zeros(len(items.vocabulary), int)
    for _, text in docs:
        ids = [items.vocabulary.get(w, -1) for w in d.words_of(text)]
        for start in range(0, len(ids), d.PASSAGE):
            tf = np.bincount([i for i in ids[start : start + d.PASSAGE] if i >= 0], minlength=len(items.vocabulary))
            seen += tf > 0
            rows.append(tf * items.weight)
    assert counts == {i: n for i, n in enumerate(seen.tolist()) if n}
    own = np.array([np.bincount(w, minlength=len(items.vocabulary)) * items.weight for w in items.words])
    inside = encoded.where("words IS NOT NULL")
    vectors = np.random.default_rng(0).standard_normal((len(items.vocabulary), 5))
    a = np.array(rows)
    assert np.allclose(d._sums(inside, items, vectors, False), a.T @ (a @ vectors), rtol=1e-4)
    assert np.allclose(d._sums(inside, items, vectors, True), (a @ vectors).T @ (a @ vectors), rtol=1e-4)
    basis = d.latent_basis(inside, items, 6, extra=40)
    full = np.vstack([a, own * np.sqrt((a**2).sum() / (own**2).sum())])
    best = np.linalg.svd(full, full_matrices=False)[2][:6]
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-6)
    assert np.linalg.norm(full @ basis) > 0.97 * np.linalg.norm(full @ best.T)


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"q{rng.randint(0, 3000)}" for _ in range(n))
    questions = [[f"a{i}b{k}" for k in range(24)] for i in range(5)]
    benchmark = [(i, " ".join(q), 1) for i, q in enumerate(questions)] + [(7, None, 1), (8, "", 1), (9, "ab", 1), (None, "x y z", 1)]
    rephrased = [w if k % 4 else filler(1) for k, w in enumerate(questions[1])]  # three words of four, the answer too
    answerless = [w if k < 15 else filler(1) for k, w in enumerate(questions[2])]  # 15 words, but not the answer
    shuffled = rng.sample(questions[3], 24)
    rows = [
        (1, f"{filler(200)} {' '.join(questions[0]).upper()}! {filler(100)}"),
        (2, f"{filler(70)} {' '.join(rephrased)} {filler(70)}"),
        (3, f"{filler(70)} {' '.join(answerless)} {filler(70)}"),
        (4, f"{filler(70)} {' '.join(shuffled)} {filler(70)}"),
        (5, " ".join(questions[4])),
        (5, " ".join(questions[4])),
        (6, None),
        (7, ""),
        (8, filler(3000)),
    ]
    rows += [(100 + i, filler(100)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(benchmark, "item_id long, text string, doc_id int")
    out = d.contaminated(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(1, 0), (2, 1), (5, 4)]
    kept = sorted(r.doc_id for r in d.drop_contaminated(docs, items).collect() if r.doc_id < 100)
    assert kept == [3, 4, 6, 7, 8]
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0


def test_copies_in_many_documents_and_in_small_tables(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"q{rng.randint(0, 3000)}" for _ in range(n))
    hot, plain = [f"a{k}" for k in range(24)], [f"p{k}" for k in range(12)]
    benchmark = [(0, " ".join(hot)), (1, " ".join(plain)), (2, " ".join(f"n{k}" for k in range(20))), (3, "p1 p2")]
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    rephrased = " ".join(w if k % 4 else "q1" for k, w in enumerate(hot))
    answerless = " ".join(w if k < 15 else "q1" for k, w in enumerate(hot))

    def found(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        return sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect())

    # a third of the documents hold one item, as it is or rephrased; the words of another are everywhere
    texts = []
    for i in range(300):
        middle = (" ".join(hot) if i % 2 else rephrased) if i % 3 == 0 else " ".join(plain[::-1])
        texts.append(f"{filler(60)} {middle} {filler(40)}")
    texts += [f"{filler(70)} {' '.join(plain)} {filler(30)}", f"{filler(70)} {answerless} {filler(30)}"]
    assert found(texts) == [(i, 0) for i in range(0, 300, 3)] + [(300, 1)]
    small = [f"{filler(90)} {' '.join(hot)} {filler(90)}", " ".join(hot), filler(50), rephrased, answerless]
    assert found(small) == [(0, 0), (1, 0), (3, 0)]


def test_whole_stretch_is_looked_at_before_its_windows(monkeypatch):
    """Words of a plain item in reverse order: no common subsequence is long enough, so no windows are laid."""
    text = "one two three four five six seven eight nine ten"
    items = d.Items([("a", text)])
    items.share += 0.5  # no weighted words: searched without the cosine
    items.basis = np.zeros((len(items.vocabulary), 1))
    limits = {"min_words": 3, "cosine": 0.5, "copied": 0.8, "rephrased": 0.6}
    places, near = d.Places(items, limits), np.zeros((1, 1))
    same = items.words[0]
    assert d._hits(same, items, near, places, limits)[0][0] == 10
    for tail in ([], [-1, -1, 3]):
        mixed = np.array([*same[::-2].tolist(), *tail], np.int32)
        assert places.common(places.words[0], mixed) == d.common_words(same, mixed)
    monkeypatch.setattr(d.Places, "rich", lambda *_: pytest.fail("windows were laid"))
    assert d._hits(same[::-1].copy(), items, near, places, limits) == {}


def test_stretches_equal_brute_force_and_bounds_lose_nothing(monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = d.Items([(i, " ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 20])))) for i in range(12)])
    items.weight = np.array([rng.choice([0, 1.0]) for _ in items.vocabulary])
    items.share = np.array([rng.random() for _ in items.vocabulary])
    places = d.Places(items, {"min_words": 3, "cosine": 0.5, "copied": 0.8, "rephrased": 0.6})
    looked, common_bits = [], d.common_bits
    monkeypatch.setattr(d, "common_bits", lambda *a: looked.append(a) or common_bits(*a))
    calls = 0
    for _ in range(30):
        ids = np.array([rng.choice([-1, -1, -1, rng.randrange(len(items.vocabulary))]) for _ in range(rng.choice([0, 30, 400]))], np.int32)
        expected = set()
        for i, own in enumerate(places.anchors):
            width = int(places.widths[i])
            times = [int(np.isin(ids[at : at + 2 * width], own).sum()) for at in range(0, len(ids), 2 * width)]
            for at, n in enumerate(times):
                around = max(times[at - 1 : at] or [0]), max(times[at + 1 : at + 2] or [0])
                if n and n + max(around) >= places.needs[i]:
                    expected.add((width, max((at - 1) * 2 * width, 0), min((at + 2) * 2 * width, len(ids)), i))
        found = [(width, low, high, i) for width, low, high, some in places.stretches(ids) for i in some]
        assert sorted(found) == sorted(expected)
        for i, whole in enumerate(places.words):
            calls += 1
            common, least = brute_common(items.words[i].tolist(), ids.tolist()), int(places.least[i])
            assert places.common(whole, ids) == common
            calls += 1
            assert places.common(whole, ids, least) in ({common} if common >= least else {common, 0})
    assert len(looked) < 0.9 * calls  # texts with too few different words of an item are told without the subsequence


def test_words_of_texts_together_are_those_of_each_alone():
    rng = random.Random(8)
    vocabulary = sorted({b"a", b"b", b"ab", b"abcdefgh", b"abcdefghi", b"z" * 70, "é".encode()})
    numbers = d.Numbers(vocabulary)
    words = ["a", "B", "ab", "abcdefgh", "abcdefghi", "Z" * 70, "É", "x", "abcdefg", "z" * 71]
    texts = [None, "", "...", "a", *(" .\n,"[rng.randint(0, 3)].join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(40)), ""]
    ids, counts = numbers.of([d._plain(t) for t in texts])
    expected = [[vocabulary.index(w) if w in vocabulary else -1 for w in d.words_of(t)] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected
    passages = [0] * len(vocabulary)
    for own in expected:
        for start in range(0, len(own), d.PASSAGE):
            for word in set(own[start : start + d.PASSAGE]) - {-1}:
                passages[word] += 1
    assert d.passages_of(ids, counts, len(vocabulary)).tolist() == passages
    assert (d.Numbers([]).of([b"a b", b""])[0] == -1).all()


def test_items_whose_words_a_text_lacks_are_left_aside(monkeypatch):
    """Such an item's anchors alone, however often, lead to no stretch, and to no subsequence."""
    items = d.Items([("one", " ".join(f"w{i}" for i in range(30))), ("two", " ".join(f"w{i}" for i in range(10, 25)))])
    limits = {"min_words": 3, "copied": 0.8, "rephrased": 0.6, "cosine": 0.5}
    items.share = np.full(len(items.vocabulary), 0.1)  # no weighted words: both are searched without the cosine
    items.basis = np.zeros((len(items.vocabulary), 1))
    places, near = d.Places(items, limits), np.zeros((2, 1))
    number = items.vocabulary
    calls = []
    common = d.Places.common
    monkeypatch.setattr(d.Places, "common", lambda self, *a: calls.append(1) or common(self, *a))
    few = np.array([number[f"w{i}".encode()] for i in [*range(12)] * 5], np.int32)  # 12 of 18 words, 2 of 9
    assert list(places.stretches(few)) and not list(places.stretches(few, held=True)) and not d._hits(few, items, near, places, limits) and not calls
    whole = np.array([number[f"w{i}".encode()] for i in range(10, 25)], np.int32)
    assert set(d._hits(whole, items, near, places, limits)) == {1} and calls
