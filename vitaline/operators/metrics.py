"""Quality of predictions held in a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.operators.skew import running_total


def binary_metrics(
    predictions: DataFrame, score: str = "score", truth: str = "truth", threshold: float = 0.5
) -> DataFrame:
    """One row: counts, accuracy, F1 and score range; scores are clamped to [0, 1] before the threshold."""
    clamped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    said, true = clamped >= threshold, F.col(truth) == 1
    tp, tn = F.count_if(said & true), F.count_if(~said & ~true)
    fp, fn = F.count_if(said & ~true), F.count_if(~said & true)
    counts = predictions.agg(
        tp.alias("tp"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.select(
        "tp",
        "tn",
        "fp",
        "fn",
        (F.col("tp") + F.col("tn")).alias("n_correct"),
        (F.col("fp") + F.col("fn")).alias("n_wrong"),
        total.alias("n_total"),
        F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        F.try_divide(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        "min_score",
        "max_score",
    )


def argmax_accuracy(predictions: DataFrame, scores: Sequence[str], truth: str = "truth") -> DataFrame:
    """Share of rows whose largest score stands at the place of the true class; the first of equals wins."""
    values = F.array(*scores)
    guess = F.array_position(values, F.array_max(values)) - 1
    return predictions.agg(F.avg((guess == F.col(truth)).cast("double")).alias("accuracy"))


def auc(
    predictions: DataFrame, score: str = "score", truth: str = "truth", by: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve: chance that a positive outranks a negative, ties counting half.

    Scores are counted per value before they are put in order, block by block.
    """
    counts = predictions.groupBy(*by, score).agg(
        F.count_if(F.col(truth) == 1).alias("n_pos"), F.count_if(F.col(truth) == 0).alias("n_neg")
    )
    upto = running_total(counts, [score], F.col("n_neg"), by, out="neg_to")
    wins = F.sum(F.col("n_pos") * (F.col("neg_to") - F.col("n_neg") / 2))
    pairs = F.sum("n_pos").cast("double") * F.sum("n_neg")
    return upto.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def auc_micro_macro(predictions: DataFrame, classes: Mapping[str, str]) -> DataFrame:
    """AUC over several classes, `classes` naming the truth column of each score column.

    macro: mean over classes; micro: all (score, truth) pairs as one class.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("class"), F.col(s).alias("score"), F.col(t).alias("truth"))
            for s, t in classes.items()
        ]
    )
    tall = predictions.select(F.explode(pairs).alias("p")).select("p.class", "p.score", "p.truth")
    macro = auc(tall, by=["class"]).agg(F.avg("auc").alias("auc_macro"))
    micro = auc(tall).select(F.col("auc").alias("auc_micro"))
    return micro.select("auc_micro", macro.scalar().alias("auc_macro"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
