"""Counts that tell what a cleaning step did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import STITCH_WITHOUT_AMD
from vitaline.operators.timeline import union_all
from vitaline.sources.tables import Tables


def null_profile(frames: Mapping[str, DataFrame], stage: str) -> DataFrame:
    """(table, stage, column, nulls) of every column; one pass per table."""
    profiles = []
    for name, df in frames.items():
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        tall = counts.unpivot([], df.columns, "column", "nulls")
        profiles.append(tall.select(F.lit(name).alias("table"), F.lit(stage).alias("stage"), "column", "nulls"))
    return union_all(profiles)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def code_null_report(
    df: DataFrame, code: str = "codiceamd", value: str = "valore", alias: str = "n_null"
) -> DataFrame:
    """Rows without a value per code, most first."""
    rows = df.filter(F.col(value).isNull() & F.col(code).isNotNull())
    counts = rows.groupBy(code).agg(F.count(F.lit(1)).alias(alias))
    return counts.orderBy(F.desc(alias), code)


def code_pair_counts(df: DataFrame, first: str, second: str | None = None) -> DataFrame:
    """Rows per code, or per pair of codes; rows without a code are left out."""
    columns = [first] if second is None else [first, second]
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


def null_code_in_set(
    df: DataFrame,
    code: str = "codiceamd",
    other: str = "codicestitch",
    values: Sequence[str] = tuple(STITCH_WITHOUT_AMD),
) -> DataFrame:
    """Rows without a code, and how many of them have their other code in `values`."""
    missing = F.col(code).isNull()
    return df.agg(
        F.count_if(missing).alias("n_missing"),
        F.count_if(missing & F.col(other).isin(list(values))).alias("n_in_set"),
    )


def table_rows(tables: Tables, step: str) -> DataFrame:
    """(step, table, rows) of each of the eight tables."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(step).alias("step"), F.lit(name).alias("table"), "n_rows"
            )
            for name, df in tables.items()
        ]
    )


def funnel_report(steps: Mapping[str, Tables]) -> DataFrame:
    return union_all([table_rows(tables, step) for step, tables in steps.items()])


def recorded_rows(records: Mapping[str, DataFrame]) -> DataFrame:
    """(step, table, rows) as the commit records of the steps tell them; no table is read."""
    return union_all([record.select(F.lit(step).alias("step"), "table", "n_rows") for step, record in records.items()])
