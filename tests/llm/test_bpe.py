from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vitaline.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


TEXTS = ["", " ", "hello  world\n\n x", "aaaa" * 5000, "don't I'll 12345", "été 日本語 ​﻿ 🙂👍🏽", "<|endoftext|>", "\x00\x1c\x85 a"]


def test_same_ids_as_the_public_library(codec, reference):
    assert [ids(e) for e in codec.encode(TEXTS)] == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_any_text_round_trips(text):
    codec = bpe._codec(PATH, P.PATTERN)
    (packed,) = codec.encode([text])
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert ids(packed) == reference.encode_ordinary(text)
    assert codec.decode(packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_trees_in_step_equal_one_tree(piece):
    codec = bpe._codec(PATH, P.PATTERN)
    (many,) = bpe.merge_many([piece], codec.byte_ids, codec.pairs, 64)
    if piece not in codec.ranks:
        assert ids(many) == bpe.merge(piece, codec.ranks)


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "a b", "y"), (3, "a b", "y"), (None, "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", "a b", "c")}
    assert out == {(1, 0, digest[""]), (2, 0, digest[""]), (3, 2, digest["a b"]), (None, 1, digest["c"])}
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
    decoded = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert [bytes(r.data) for r in decoded.orderBy("doc_id").collect()] == [b"c", b"", b"", b"a b", b"a b"]
