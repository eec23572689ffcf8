from __future__ import annotations

import math
from collections import Counter

import numpy as np

from vitaline.llm import quality
from vitaline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def test_base_counts_equal_brute_force():
    for text in (None, "", " \n\x1c", "a a a a", "a b c d\na b c e\n\na b c d", "é # é | é", "x y z x y z", "\x0b x"):
        assert quality.base_counts(text) == brute(text), text


def test_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op10_divergence_rules"](spark, SF).collect()
    assert {r.doc_id for r in out} == set(rows)
    for r in out:
        b = brute(rows[r.doc_id])
        assert {k: r[k] for k in b} == b
        assert r.base_failed == (b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"])
        assert not (r.base_failed and r.kept)


def test_distance_is_jensen_shannon():
    share = np.array([0.5, 0.5, 0.0])
    p = [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, share, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    counts = np.array([[1.0, 1, 2], [1, 1, 0], [0, 0, 3], [0, 0, 0]])
    expected = [math.sqrt((kl(p) + kl(share)) / 2), 0, 1, 1]
    assert np.allclose(quality.distance(counts, share), expected)


def test_labels_are_separated(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    out = QUERIES["op10_divergence_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    bad = [r for r in out if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.05


def test_odd_rows(spark):
    long = " ".join(f"w{i} the" for i in range(40))
    rows = [(1, None, None, 1), (2, "", "en", 2), (3, long, "en", 3), (3, long, "en", 4), (None, "a", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    out = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judge(docs, min_reference=10).collect())
    assert out == [(0, 1, False), (1, 0, False), (2, 0, False), (3, 80, True), (3, 80, True)]
    assert quality.judge(docs.limit(0)).count() == 0
    assert quality.judge(docs).where("kept").count() == 2  # no reference is long enough: base rules alone
