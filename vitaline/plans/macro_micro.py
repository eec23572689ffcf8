"""Balanced tables to the macro/micro feature table of each split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vitaline.config import KEY, SEED
from vitaline.operators.features import in_patient_order, macro_micro_features
from vitaline.session import cut
from vitaline.sources.tables import Tables


def split_features(tables: Tables, seed: int = SEED) -> dict[str, DataFrame]:
    """Features by split, in patient and date order, without ids."""
    features = cut(macro_micro_features(tables, seed=seed, ordered=False))
    return {
        split: in_patient_order(features.filter(features["split"] == split)).drop("split", *KEY)
        for split in ("test", "train")
    }
