"""A corpus from raw documents to token ids, in stages that are each written and read again.

Each stage takes the documents its predecessor kept and applies one operator of `vitaline.llm` with its
defaults. All but the last return the columns of documents. What a stage does with nulls, empty texts, ties
and repeated rows is that of its operator: texts without a letter leave with the first stage. Columns besides
those of documents go along under neutral names inside a stage, so they may be named like what operators add.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline.llm import bpe, decontaminate, jaccard, langid, line_templates
from vitaline.llm.common import documents, fold
from vitaline.session import cut


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _neutral(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with other columns renamed, and what gives them their names back."""
    names = {c: c if c in DOCUMENT else f"column_{i}" for i, c in enumerate(docs.columns)}
    inside = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inside, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages labelled in four fifths of them; rejected ones go."""
    inside, named = _neutral(docs)
    identifier = langid.fit(inside.where(fold(F.col("doc_id")) != 0))
    found = langid.identify(inside, identifier, keep=inside.columns)
    return named(found.where(~F.col("rejected")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars follows the text."""
    inside, named = _neutral(docs)
    cleaned = line_templates.drop_recurring_lines(inside).withColumn("n_chars", F.length("text").cast("long"))
    return named(cleaned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    inside, named = _neutral(docs)
    return named(jaccard.keep_one(inside))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, copied or rephrased."""
    inside, named = _neutral(docs)
    return named(decontaminate.drop_contaminated(inside, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("token_ids", token_ids),
]

ORACLE_SQL = None  # models and tokenisation are beyond SQL; tests/llm/test_pipeline.py has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
