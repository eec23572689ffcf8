from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitaline.llm import jaccard
from vitaline.llm.graph import components
from vitaline.llm.queries import QUERIES


def brute(rows, size=5, percent=80):
    """doc_id -> (set size, smallest id reachable), all pairs that share a shingle compared as sets of strings."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    by_shingle, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(words, rng, share):
    return [rng.choice("uvwxyz") * rng.randint(1, 9) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_edits_of_every_strength(spark, monkeypatch, frequent):
    """Families of texts around the threshold: chains, passages in common, short and equal texts."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LOCAL", 2)
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for family in range(12):
        words = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(12):
            texts.append(words if rng.random() < 0.2 else (passage if rng.random() < 0.3 else []) + words)
            words = edited(words, rng, rng.choice([0.005, 0.02, 0.04, 0.2]))
    texts += [["one"], ["one"], ["one", "two"], ["ONE"], [], passage, passage[:-1], passage[3:]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    expected = brute(rows)
    assert answer(jaccard.near_duplicates(docs)) == expected
    assert len({c for _, c in expected.values()}) < len(rows)
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in expected.items() if c == i}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(QUERIES["op3_shingle_jaccard"](spark, sf)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A b\tc"), (5, "A b\tc"), (None, "a b c"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int")
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()]
    assert sorted(out, key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (None, 0, None)], key=str
    )
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(docs).collect()) == ["1", "2", "3", "4", "None", "None"]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(249, 300), (500, 400), (7, 7)]
    out = components(spark.createDataFrame(links, "a long, b long")).select("node", F.col("component")).collect()
    expected = {i: 0 for i in range(51)} | {100: 100, 300: 100} | {200 + i: 100 for i in range(50)} | {400: 400, 500: 400}
    assert {r.node: r.component for r in out} == expected
    assert len(out) == len(expected)


def test_sets_of_texts_together_are_those_of_each_alone(monkeypatch):
    """Texts are hashed together; no shingle may reach over a text's end, and no word be mistaken for a longer one."""
    rng = random.Random(3)
    words = ["a", "A", "a\0", "\0", "é", "abcdefgh", "abcdefghi", "abcdefgh\0", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", "y" * 5000]
    blanks = [" ", "\n", "\t \r", "\x0b", "\x0c", "  "]
    texts = [None, "", " ", "\n a", "a b", "a b c d e", "a b c d e f a b c d e f"]
    for n in [*range(9), 50, 400]:
        texts += [rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice(blanks) for _ in range(n)) for _ in range(4)]
    texts = [None if t is None else t.encode() for t in texts]
    for size in (1, 4, 5):
        shingles = [brute([(0, None if t is None else t.decode())], size)[0][0] for t in texts]
        together = jaccard.shingle_sets(texts, size)
        assert [len(s) for s in together] == shingles
        monkeypatch.setattr(jaccard, "PORTION", 300)
        for own, text in zip(jaccard.shingle_sets(texts, size), texts, strict=True):
            assert own.tolist() == jaccard.shingle_sets([text], size)[0].tolist() == sorted(set(own.tolist()))
        monkeypatch.undo()
        for one, other in zip(together, jaccard.shingle_sets(texts[::-1], size)[::-1], strict=True):
            assert one.tolist() == other.tolist()
    starts, hashes = jaccard.word_hashes(" ".join(dict.fromkeys(w.lower() for w in words)).encode())
    assert len(set(hashes.tolist())) == len(starts) == len(set(w.lower() for w in words))
