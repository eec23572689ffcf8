from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitaline.llm import langid
from vitaline.llm.common import fold
from vitaline.llm.queries import QUERIES

WORDS = {"aa": Counter({b"abab": 3, b"ba": 1, b"aab": 2}), "bb": Counter({b"abc": 2, b"c": 5, b"cab": 1})}


def brute(counts, order, uniform):
    """Interpolated Kneser-Ney on padded words with dictionaries of strings."""
    grams = [Counter() for _ in range(order + 1)]
    left = defaultdict(set)
    for word, n in counts.items():
        padded = " " + word.decode() + " "
        for i in range(1, len(padded)):
            for k in range(1, min(order, i + 1) + 1):
                gram = padded[i - k + 1 : i + 1]
                grams[k][gram] += n
                if i - k >= 0:
                    left[gram].add(padded[i - k])
    for k in range(1, order):
        for gram in grams[k]:
            if left[gram]:
                grams[k][gram] = len(left[gram])
    discounts = [0.0]
    for k in range(1, order + 1):
        once, twice = (sum(v == x for v in grams[k].values()) for x in (1, 2))
        discounts.append(min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9))

    def bits(word):
        padded, total = " " + word.decode() + " ", 0.0
        for i in range(1, len(padded)):
            p = uniform
            for k in range(1, min(order, i + 1) + 1):
                gram = padded[i - k + 1 : i + 1]
                same = {g: c for g, c in grams[k].items() if g[:-1] == gram[:-1]}
                if same:
                    d, n = discounts[k], sum(same.values())
                    p = max(same.get(gram, 0) - d, 0) / n + d * len(same) / n * p
            total -= math.log2(p)
        return total

    return bits


def test_model_equals_brute_force(spark):
    rows = [(lang, word, n) for lang, counts in WORDS.items() for word, n in counts.items()]
    model = langid.train(spark.createDataFrame(rows, "lang string, word binary, n long"), 3)
    asked = [b"abab", b"c", b"zzz", b"cabab", b"a", b"abcabcabc"]
    got, chars = model.score(asked)
    assert chars.tolist() == [len(w) + 1 for w in asked]
    for column, lang in enumerate(model.langs):
        expected = brute(WORDS[lang], 3, model.uniform)
        for row, word in enumerate(asked):
            assert got[row, column] == pytest.approx(expected(word), rel=1e-4), (lang, word)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op4_kneser_ney_language"](spark, sf).join(docs, "doc_id").collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) / len(out) < 0.005


def test_odd_rows(spark):
    english, german = "the thing of the other thing ", "der die ung und keit ein "
    learn = [(i, (english if i % 2 else german) * (3 + i % 5), "en" if i % 2 else "de", i) for i in range(300)]
    learn += [(1000, None, "en", 0), (1001, "x", None, 0)]
    kinds = "doc_id long, text string, lang string, score int"
    found = langid.fit(spark.createDataFrame(learn, kinds))
    rows = [(1, None), (2, ""), (3, "12 - %"), (4, english), (4, english), (5, "ung " * 50_000), (6, "zxqwvkj " * 20)]
    asked = spark.createDataFrame([(i, t, "xx", 1) for i, t in rows], kinds)
    out = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(asked, found).collect())
    assert out[:6] == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (5, "de", False)]
    assert out[6][2]  # letters of no language
    assert langid.identify(asked.limit(0), found).count() == 0
    none = langid.fit(asked.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(asked, none).collect()} == {("und", 0.0)}


def test_sample_is_bounded(spark):
    rows = [(i, f"L{i % 5}", "ab " * (1 + i % 3)) for i in range(1000)] + [(7, "L2", "ab " * 9)] * 50 + [(1, "L0", "x" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid._sample(docs, 40, 10_000, 2).collect()
    assert Counter(r.lang for r in got) == {"L2": 40, "L0": 40}  # the most frequent languages, ties by name
    few = langid._sample(docs, 40, 300, 10).collect()
    sizes = Counter()
    for r in few:
        sizes[r.lang] += len(r.text)
    assert len(sizes) == 5 and max(sizes.values()) <= 300
    assert max(len(r.text) for r in few) <= 3


def test_folds_are_of_the_id_as_text(spark):
    got = {r.id: r.f for r in spark.range(200).withColumn("f", fold(F.col("id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(200)}
