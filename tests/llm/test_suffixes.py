from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from vitaline.llm import suffixes as s
from vitaline.llm.queries import QUERIES

W = s.WINDOW


def brute(rows):
    """doc_id, n_bytes, n_removed, n_spans, sha256 of every row, by a dictionary of all strings."""
    least = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - W + 1):
            part = data[i : i + W]
            if doc_id is not None and doc_id < least.get(part, 1 << 60):
                least[part] = doc_id
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - W + 1):
            if doc_id is not None and least[data[i : i + W]] < doc_id:
                gone[i : i + W] = b"\1" * W
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def answer(docs):
    out = s.drop_repeated_bytes(docs).collect()
    return sorted(
        [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out],
        key=str,
    )


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "a"])
def test_order_is_that_of_the_strings(letters):
    rng = random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(600))
    text += text[100:300] + "".join(rng.choice(letters) for _ in range(50)) + text[20:400]
    data = np.frombuffer(text.encode() + bytes(W + 2), np.uint8)
    starts = np.arange(len(text) - W + 1)
    order = s.suffix_order(data, starts)
    strings = [text[i : i + W] for i in order]
    assert sorted(order.tolist()) == starts.tolist()
    assert strings == sorted(strings)
    assert s.same_as_before(data, order).tolist() == [False, *[a == b for a, b in zip(strings, strings[1:], strict=False)]]


def test_order_of_bytes_of_all_values_and_of_numbers_too_wide_for_places():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    starts = np.flatnonzero(rng.random(len(data) - W - 1) < 0.7)
    order = s.suffix_order(np.concatenate([data, np.zeros(W + 2, np.uint8)]), starts)
    strings = [data[i : i + W].tobytes() for i in order]
    assert sorted(order.tolist()) == starts.tolist() and strings == sorted(strings)
    values = rng.integers(0, 50, 1000).astype(np.uint64) << np.uint64(55)
    values[7] = np.uint64((1 << 64) - 1)
    for wide, bits in ((values, 64), (values >> np.uint64(55), 9)):  # with places apart and behind the numbers
        order, new = s._ranks(wide, bits)
        assert (order == np.argsort(wide, kind="stable")).all()
        assert new.sum() == len(np.unique(wide))


def test_anchors_cover_every_string_once(monkeypatch):
    monkeypatch.setattr(s, "STRIDE", 97)
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(1000))
    grams, first, last = s.anchors(data)
    starts = [i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)]
    assert starts == list(range(len(data) - W + 1))
    by_start = np.repeat(grams, last - first + 1)
    again = s.anchors(b"x" * 30 + data[200:500])
    again_by_start = np.repeat(again[0], again[2] - again[1] + 1)
    assert (again_by_start[30:] == by_start[200 : 500 - W + 1]).all()


@pytest.mark.parametrize("hot", [10**6, 2])
def test_edits_copies_and_overlaps(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "SORTED", 2000)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    sources = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(None, sources[0]), (900, None), (901, ""), (902, "x" * 49), (903, "x" * 300), (904, "x" * 60), (3, "x" * 51)]
    for i in rng.sample(range(10, 500), 60):
        text = sources[rng.randrange(6)]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + word() + text[at + 3 :], text[at:] + text[:at], text + text[at : at + 80], text])
        rows.append((i, text))
    rows += [rows[10], rows[11], (rows[12][0], "another " + rows[13][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, data string").repartition(3)
    assert answer(docs) == brute(rows)
    assert answer(docs.limit(0)) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op6_difference_cover"](spark, sf).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out], key=str) == brute(rows)
