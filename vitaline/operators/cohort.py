"""Choosing patients by code, and keeping only their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import CARDIO_CODES, KEY
from vitaline.operators.skew import join_on_key
from vitaline.session import cut
from vitaline.sources.tables import Tables


def with_codes(df: DataFrame, codes: Sequence[str] = CARDIO_CODES, column: str = "codiceamd") -> DataFrame:
    return df.filter(F.col(column).isin(list(codes)))


def distinct_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.select(*key).distinct()


def cohort_keys(diagnosi: DataFrame, codes: Sequence[str] = CARDIO_CODES) -> DataFrame:
    """Patients with at least one diagnosis in `codes`, dated or not."""
    return distinct_keys(with_codes(diagnosi, codes))


def keep_patients(df: DataFrame, keys: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the patients in `keys`, which holds a patient once."""
    return join_on_key(df, keys.select(*key), key, "left_semi")


def keep_tables(tables: Tables, keys: DataFrame) -> Tables:
    """All eight tables cut down to the patients in `keys`, which are written once for the eight joins."""
    keys = cut(keys)
    kept = tables.map_events(lambda df: keep_patients(df, keys))
    return kept.replace(registry=tables.registry.join(keys, KEY, "left_semi"))


def cohort_by_codes(tables: Tables, codes: Sequence[str] = CARDIO_CODES) -> Tables:
    return keep_tables(tables, cohort_keys(tables.diagnosi, codes))


def first_patients(registry: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """The first `n` patients in key order."""
    return registry.orderBy(*key).limit(n)


def key_overlap(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Number of keys found in both tables."""
    both = left.select(*key).intersect(right.select(*key))
    return both.agg(F.count(F.lit(1)).alias("n_keys"))
