from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import duck
from test_jaccard import brute as brute_components

import corpus_pipeline
from vitaline.llm import bpe, decontaminate, line_templates

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows of documents and of each stage, every stage written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    assert all(sorted(df.columns) == sorted(docs.columns) for df in out[:-1])
    return [df.collect() for df in out]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_language_keeps_clean_documents_whole(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert after.items() <= before.items()
    assert len(after) > 0.995 * len(before)


def test_lines_equal_sql(steps):
    con = duck(SF)
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts(steps[1]).items()))
    expected = {r[0]: r[3] for r in con.execute(line_templates.SQL).fetchall()}
    assert {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts(steps[2]).items()} == expected
    assert all(r.n_chars == len(r.text) for r in steps[2])
    assert sum(r.n_chars for r in steps[2]) < sum(r.n_chars for r in steps[1])


def test_one_document_of_each_group_stays(steps):
    groups = brute_components(list(texts(steps[2]).items()))
    kept = {i for i, (_, component) in groups.items() if component == i}
    assert set(texts(steps[3])) == kept
    assert len(kept) < len(groups)


def test_no_benchmark_passage_stays(spark, steps):
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda text: any(b" " + b" ".join(i) + b" " in b" " + b" ".join(decontaminate.words_of(text)) + b" " for i in items)
    before, after = texts(steps[3]), texts(steps[4])
    assert not any(map(holds, after.values()))
    gone = before.keys() - after.keys()
    assert gone and sum(holds(before[i]) for i in gone) >= 0.9 * len(gone)


def test_tokens_are_those_of_the_public_library(steps):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = texts(steps[4])
    assert {r.doc_id for r in steps[5]} == set(kept)
    for r in steps[5]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(kept[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, steps):
    ids = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert ids == {r.doc_id: r.ids_sha256 for r in steps[5]}


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the thing of the day " * 9, "en", "s", 1)]
    rows += [rows[2], (4, rows[2][1], "en", None, 1), (None, "the other thing of it", "en", "s", 3)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, kinds).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted(str(r.doc_id) for r in out) == ([] if not data else ["3", "3", "None"])


def test_columns_named_like_results_go_along(spark):
    """Every name that an operator adds or overwrites, with values of other types."""
    names = ["score", "rejected", "lang_pred", "bits_per_char", "n_lines", "n_dropped", "component_id", "line", "digest"]
    columns = [f"concat('{n}', id) AS {n}" for n in names]
    text = "concat('the answer to question ', id, ' of the long list is given on page ', id * 7)"
    docs = spark.range(12).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars", *columns)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
