from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from vitaline.llm import periodic
from vitaline.llm.queries import QUERIES


def brute_runs(words, shortest=24, times=3):
    """Every lag at every place; a stretch found with several lags has the smallest."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text or b"")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shortest", [24, 6])
def test_runs_of_all_kinds(shortest):
    """Repeats of repeats, runs that overlap, few and many words, rare words between."""
    rng = random.Random(shortest)
    total = 0
    for _ in range(400):
        kinds, words = rng.choice([1, 2, 2, 3, 5, 20, 200]), []
        for _ in range(rng.randint(1, 8)):
            base = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
            many = base * rng.choice([1, 1, 2, 3, 4, 9])
            words += many[: rng.randint(1, len(many))] + [b"u%d" % rng.randrange(10**6)] * (rng.random() < 0.3)
        words *= rng.choice([1, 1, 2, 3])
        expected = brute_runs(words, shortest)
        assert periodic.runs(words, shortest) == expected
        total += len(expected)
    assert total > 500


def test_segments_are_split_again_and_again():
    """A word frequent in the text but rare in each of its parts splits them."""
    words = [b"a"] * 30 + [b"x"] + [b"b"] * 10 + [b"c"] + [b"b"] * 10 + [b"y"] + [b"a", b"c"] * 15 + [b"c"] * 2
    ids = periodic.numbered(words)
    assert periodic.segments(ids) == [(0, 30), (53, 85)]
    words = [b"k", b"l"] * 20 + [b"m", b"u1"] + [b"m", b"n"] * 13 + [b"k"] + [b"u2"] + [b"m"]
    assert periodic.segments(periodic.numbered(words)) == [(0, 40), (42, 68)]


def test_very_long_texts():
    rng = random.Random(3)
    noise = [b"%d" % rng.randrange(3000) for _ in range(300_000)]
    base = noise[:20_000]
    words = noise + base * 4 + base[:100]
    assert (300_000, 80_100, 20_000) in periodic.runs(words)
    assert periodic.runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs([b"%d" % (i % 7) for i in range(100_000)]) == [(0, 100_000, 7)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = [brute(r.doc_id, None if r.text is None else r.text.encode()) for r in rows]
    assert answer(QUERIES["op12_frequency_splitting"](spark, sf)) == sorted(expected, key=str)


def test_odd_rows(spark):
    again = "tick tock " * 20
    rows = [(i, again + f"end {i}") for i in range(60)] + [(1, None), (2, ""), (3, " \n\t"), (4, again), (4, again), (None, again)]
    rows += [(None, None), (70, "one"), (71, "Ünï code " * 30), (72, "a\x1cb c  " * 24), (73, "x " * 24), (74, "x " * 23)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    out = periodic.digests(periodic.collapse(docs, rewrite=periodic.planted))
    assert answer(out) == sorted((brute(i, None if t is None else t.encode()) for i, t in rows), key=str)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text_are_kept(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "cast(unhex(repeat('FF20C320', 12)) AS string) AS text")
    row = periodic.collapse(docs).selectExpr("runs", "hex(collapsed) AS kept").first()
    assert [tuple(r) for r in row.runs] == [(0, 24, 2)]
    assert row.kept == "FF20C3"
