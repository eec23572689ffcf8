from __future__ import annotations

import random

import numpy as np
import pytest
from test_jaccard import brute, edited

from vitaline.llm import minhash
from vitaline.llm.queries import QUERIES


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def families(seed):
    """Texts around the threshold: chains of edits, passages in common, copies, short texts."""
    rng = random.Random(seed)
    passage, texts = [f"p{i}" for i in range(40)], []
    for family in range(12):
        words = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(12):
            texts.append(words if rng.random() < 0.2 else (passage if rng.random() < 0.3 else []) + words)
            words = edited(words, rng, rng.choice([0.005, 0.02, 0.04, 0.2]))
    base = [f"b{i}" for i in range(150)]
    texts += [edited(base, rng, rng.choice([0, 0.01, 0.02, 0.05, 0.1])) for _ in range(80)]
    texts += [["one"], ["one"], ["one", "two"], ["ONE"], [], passage, passage[:-1], passage[3:]]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("block", "weight", "followers"), [(512, 10**6, 200), (4, 10**6, 2), (512, 900, 3)])
def test_edits_of_every_strength(spark, monkeypatch, block, weight, followers):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)
    monkeypatch.setattr(minhash, "FOLLOWERS", followers)
    rows = families(block + followers)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    expected = brute(rows, size=4)
    out = minhash.near_duplicates(docs)
    assert answer(out) == expected
    assert {r.doc_id for r in out.where("kept").collect()} == {i for i, (_, c) in expected.items() if c == i}
    assert len({c for _, c in expected.values()}) < len(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A b\tc"), (5, "A b\tc"), (5, "x y z"), (6, "x y z")]
    rows += [(None, "a b c"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, b"") for i, t in rows], "doc_id long, text string, component_id int, digest binary")
    out = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False)]
    expected += [(5, 1, 5, True), (6, 1, 5, False), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_and_invalid_texts(spark):
    long = " ".join(str(i * i % 99_991) for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")
    bad = spark.range(10, 12).selectExpr("id AS doc_id", "cast(unhex('FF20C3') AS string) AS text")
    found = answer(minhash.near_duplicates(docs.unionAll(bad)))
    assert {i: c for i, (_, c) in found.items()} == {1: 1, 2: 1, 3: 3, 10: 10, 11: 10}


def test_agreement_is_the_similarity_with_less_spread():
    """Places agree as often as sets do, and vary less than independent ones would."""
    rng = np.random.default_rng(4)
    for n, shared in [(9, 8), (90, 80), (3000, 2000)]:
        similarity = shared / (2 * n - shared)
        agreed = []
        for _ in range(300):
            draw = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            one, two = minhash.signatures([np.sort(draw[:n]), np.sort(draw[n - shared :])])
            agreed.append((one == two).mean())
        independent = (similarity * (1 - similarity) / minhash.VALUES) ** 0.5
        assert abs(np.mean(agreed) - similarity) < 4 * independent / 300**0.5
        assert np.std(agreed) < (0.9 if n < 500 else 1.1) * independent


def test_signatures_do_not_depend_on_their_company():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 150, 4000, 3, 40_000, 70_000)]
    together = minhash.signatures(sets)
    for s, row in zip(sets, together, strict=True):
        assert (minhash.signatures([s])[0] == row).all()
    assert len(set(together[0].tolist())) == minhash.VALUES
    assert minhash.signatures([]).shape == (0, minhash.VALUES)


def test_near_misses_are_found(spark):
    """Pairs at 0.8 exactly, 36 shingles of 45 shared."""
    rows = []
    for k in range(150):
        words = [f"{k}x{i}" for i in range(39)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + [f"{k}y{i}" for i in range(9)]))]
    expected = brute(rows, size=4)
    assert all(c == i - i % 2 for i, (_, c) in expected.items())
    assert answer(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(QUERIES["op11_superminhash"](spark, sf)) == brute(rows, size=4)
