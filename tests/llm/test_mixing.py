from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vitaline.llm import mixing as m
from vitaline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def small_model(texts):
    keys, numbers = m.keyed([m.tokens_of(t) for t in texts])
    times = np.bincount(np.concatenate(numbers), minlength=len(keys))
    counts = np.zeros(256, int)
    for key, n in zip(keys, times.tolist(), strict=True):
        for byte in key[1:] if key[1:] == m.END else key[1:] + b" ":
            counts[byte] += n
    code = m.Code(counts)
    tables = [np.zeros((2, 1 << bits), np.int64) for *_, bits in m.PREDICTORS]
    d = m.Decisions(keys, code)
    for table, slots in zip(tables, d.slots, strict=True):
        np.add.at(table.reshape(-1), slots + d.branch * table.shape[1], np.repeat(times, d.counts))
    return m.Model(code, [m.scaled(t) for t in tables], np.full((m.GATES, m.K), 0.3))


def bits(model, tokens):
    keys, (numbers,) = m.keyed([tokens])
    return m.document_bits(numbers, *model.inputs(keys))


def test_large_counts_keep_their_odds():
    table = np.array([[0, 5, 70_000, 1 << 40], [3, 65_535, 35_000, 1 << 39]])
    assert m.scaled(table).tolist() == [[0, 5, 35_000, 1 << 15], [3, 65_535, 17_500, 1 << 14]]


def test_code_is_prefix_free():
    code = m.Code(np.random.default_rng(0).integers(0, 1000, 256))
    assert sum(2.0**-n for n in code.length.tolist()) == pytest.approx(1)
    ways = {tuple(zip(code.nodes[b, :n].tolist(), code.branches[b, :n].tolist(), strict=True)) for b, n in enumerate(code.length)}
    assert len(ways) == 256


@pytest.mark.parametrize("before", [[], [b"aab"] * 300, [b"a", "é".encode()] * 200])
def test_probabilities_of_the_next_byte_sum_to_one(before):
    """After any text, and any start of a word, the 256 bytes share a probability of one."""
    model = small_model(["aab abb ab a", "b ab abc é aé", "aab " * 9])
    for start in (b"", b"aa", b"zq"):
        base = None
        total = 0.0
        for byte in range(256):
            # a word is followed by a blank; cutting the decisions after `byte` leaves its own share
            word = start + bytes([byte])
            keys, (numbers,) = m.keyed([[*before, word]])
            first, rows, ways = model.inputs(keys)
            whole = m.document_bits(numbers, first, rows, ways)
            last = int(numbers[-1])
            n = int(sum(model.code.length[b] for b in word))
            # the same document with the last word's later decisions made certain
            short = rows[first[last] : first[last] + n]
            shorter = np.concatenate([rows[: first[last]], short, rows[first[last + 1] :]])
            moved = first.copy()
            moved[last + 1 :] -= first[last + 1] - first[last] - n
            if (numbers[:-1] == last).any():
                continue
            total += 2.0 ** -(m.document_bits(numbers, moved, shorter, ways) - (base or 0))
            assert whole >= m.document_bits(numbers, moved, shorter, ways) - 1e-3
        known = m.document_bits(*_prefix(model, before, start))
        assert total == pytest.approx(2.0**-known, rel=0.02)


def _prefix(model, before, start):
    keys, (numbers,) = m.keyed([[*before, start + b"!"]])
    first, rows, ways = model.inputs(keys)
    last = int(numbers[-1])
    n = int(sum(model.code.length[b] for b in start))
    moved = first.copy()
    moved[last + 1 :] -= first[last + 1] - first[last] - n
    return numbers, moved, np.concatenate([rows[: first[last] + n], rows[first[last + 1] :]]), ways


def test_scripts_and_tokens():
    keys, numbers = m.keyed([["a".encode(), "é".encode(), b"a", b"a", m.END], [m.END]])
    assert [keys[i] for i in numbers[0]] == [b"\0a", b"\0\xc3\xa9", b"\x2aa", b"\x2aa", b"\x2a\n"]
    assert [keys[i] for i in numbers[1]] == [b"\0\n"]
    assert m.tokens_of(" A\x0bB\x1cÉ ") == [b"a", "b\x1cÉ".encode(), m.END]


def test_repeats_cost_little():
    model = small_model(["some words of a text", "other words of it"])
    once, often = bits(model, [b"words", m.END]), bits(model, [b"words"] * 400 + [m.END])
    assert often < 0.5 * 400 * once


def test_base_score_of_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr(m, "COMMON", 50)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    train = Counter(t for i, text in rows.items() if not held[i] for t in m.tokens_of(text))
    n, v = sum(train.values()), len(train)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op2_context_mixing"](spark, SF).collect()}
    counts = m.count_keys(docs.where("doc_id % 2 = 0"))
    assert {bytes(r.key)[1:] for r in counts.collect()} == {t for i, x in rows.items() if i % 2 == 0 for t in m.tokens_of(x)}
    assert out.keys() == rows.keys()
    for i, text in rows.items():
        tokens = m.tokens_of(text)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens), n)
        assert r.n_known == sum(t in train for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score < 0
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / sum(len(t) + (t != m.END) for t in tokens))


def test_held_out_scores_beat_the_base(spark):
    out = [r for r in QUERIES["op2_context_mixing"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    kinds = "doc_id long, text string, score string, n int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "a b a", "x", 1), (3, "a b a", "x", 1), (None, "z" * 50_000, "x", 1)]
    docs = spark.createDataFrame(rows, kinds)
    out = m.learn_and_score(docs, docs["doc_id"] == 2).orderBy("doc_id", "n_tokens").collect()
    assert [(r.doc_id, r.n_tokens) for r in out] == [(None, 2), (1, 1), (2, 1), (3, 4), (3, 4)]
    assert out[3] == out[4] and out[1].score == out[2].score
    assert m.learn_and_score(docs.limit(0), docs["doc_id"] == 2).count() == 0
    none = m.learn_and_score(docs, docs["n"] == 1).collect()  # nothing to learn from
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_gates_are_fitted_to_all_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(m, "_tables", lambda *_: [np.zeros((2, 1), np.uint16) for _ in m.PREDICTORS])
    monkeypatch.setattr(m, "_fit_gates", lambda counts, *_: seen.append(counts.agg({"n": "sum"}).first()[0]))
    m.fit(spark.sql("SELECT concat(x'00', cast(cast(id AS string) AS binary)) AS key, id AS n FROM range(300000)"))
    assert seen == [300_000 * 299_999 // 2]


def test_tables_of_several_tasks_come_one_by_one(spark, monkeypatch):
    keys = [bytes((i % 3,)) + b"w%d" % (i % 400) for i in range(600)] + [b"\0\n"]
    times = [1 + 40_000 * (i % 7 == 0) for i in range(len(keys))]
    code = m.Code(np.bincount(np.frombuffer(b"".join(keys), np.uint8), minlength=256))
    expected = [np.zeros((2, 1 << bits), np.int64) for *_, bits in m.PREDICTORS]
    d = m.Decisions(keys, code)
    for table, slots in zip(expected, d.slots, strict=True):
        np.add.at(table, (d.branch.astype(int), slots), np.repeat(times, d.counts))
    counts = spark.createDataFrame(list(zip(keys, times, strict=True)), "key binary, n long").repartition(4)
    taken, collect = [], type(counts).collect
    monkeypatch.setattr(type(counts), "collect", lambda df: taken.append(collect(df)) or taken[-1])
    tables = m._tables(counts, code, len(keys))
    assert [t.dtype for t in tables] == [np.uint16] * m.K
    assert all((t == m.scaled(e)).all() for t, e in zip(tables, expected, strict=True))
    assert [{r.k for r in rows} for rows in taken] == [{k} for k in range(m.K)]  # the driver holds one table's pieces
    assert all(len(r.data) % 4 == 0 and len(r.data) <= 8 * m._PIECE for rows in taken for r in rows)
