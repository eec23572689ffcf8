"""The registered queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline.llm import (
    bpe,
    decontaminate,
    html_text,
    jaccard,
    langid,
    line_templates,
    merkle,
    minhash,
    mixing,
    periodic,
    quality,
    suffixes,
    units,
)
from vitaline.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query
def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query
def op4_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id")) == 0
    found = langid.identify(docs, langid.fit(docs.where(~held_out)))
    return found.withColumn("held_out", held_out)


@query
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


ORACLES["op8_line_templates"] = line_templates.SQL


@query
def op9_line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = units.drop_repeated_units(documents(spark, sf_dir))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    starts = F.array_join(F.col("starts").cast("array<string>"), ",")
    return kept.select("doc_id", "n_units_removed", starts.alias("starts"), F.md5("text").alias("text_md5"), size.alias("n_removed"))


ORACLES["op9_line_hashes"] = units.SQL


@query
def op1_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op3_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


ORACLES["op3_shingle_jaccard"] = minhash.sql(5)


@query
def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id")) == 1
    return mixing.learn_and_score(documents(spark, sf_dir), held_out).withColumn("held_out", held_out)


@query
def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.drop_repeated_bytes(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.length("kept")
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


ORACLES["op11_superminhash"] = minhash.SQL


@query
def op12_frequency_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse(documents(spark, sf_dir), rewrite=periodic.planted))


@query
def op13_checkpoint_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


ORACLES["op13_checkpoint_merkle"] = merkle.SQL
