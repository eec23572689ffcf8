"""Count tables that describe raw and clean data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import AGE_EDGES, AGE_LABELS, KEY, REFERENCE_YEAR, VALUE_EDGES, VALUE_LABELS
from vitaline.functions.bins import bin_index
from vitaline.functions.dates import age_in_years


def value_counts(df: DataFrame, column: str, alias: str = "n_rows") -> DataFrame:
    """Rows per value, most first; missing values are left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(alias))
    return counts.orderBy(F.desc(alias), column)


def patients_per(df: DataFrame, *columns: str, ordered: bool = True) -> DataFrame:
    """Distinct patients per value of the columns."""
    counts = (
        df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count_distinct(*KEY).alias("n_patients"))
    )
    return counts.orderBy(F.desc("n_patients"), *columns) if ordered else counts


def patients_per_code(df: DataFrame, code: str = "codiceamd") -> DataFrame:
    return patients_per(df, code)


def pick_codes(counts: DataFrame, codes: Sequence[str], code: str = "codiceamd") -> DataFrame:
    return counts.filter(F.col(code).isin(list(codes)))


def values_per_code(df: DataFrame, code: str = "codiceamd", value: str = "valore") -> DataFrame:
    """Rows per value inside each code."""
    return df.dropna(subset=[code, value]).groupBy(code, value).agg(F.count(F.lit(1)).alias("n_rows"))


def binned_counts(df: DataFrame, index: Column, labels: Sequence[str], *by: str) -> DataFrame:
    """Rows per bin, empty bins included: one counter per bin in a single aggregation."""
    counters = [F.count_if(index == i).alias(str(i)) for i in range(len(labels))]
    counts = df.groupBy(*by).agg(*counters)
    tall = counts.unpivot(list(by), [str(i) for i in range(len(labels))], "_bin", "n_rows")
    bin_no = F.col("_bin").cast("int")
    names = F.array(*[F.lit(label) for label in labels])
    return tall.select(*by, bin_no.alias("bin_no"), F.get(names, bin_no).alias("bin"), "n_rows")


def histogram_per_code(
    df: DataFrame,
    code: str = "codiceamd",
    value: str = "valore",
    edges: Sequence[float] = VALUE_EDGES,
    labels: Sequence[str] = VALUE_LABELS,
) -> DataFrame:
    return binned_counts(df.filter(F.col(code).isNotNull()), bin_index(F.col(value), edges), labels, code)


def with_age(registry: DataFrame, reference_year: int = REFERENCE_YEAR) -> DataFrame:
    """`age` from the year columns, or from the years of the date columns of a clean registry."""
    years = {
        c: F.year(c) if dict(registry.dtypes)[c] == "date" else F.col(c) for c in ("annonascita", "annodecesso")
    }
    return registry.withColumn("age", age_in_years(years["annonascita"], years["annodecesso"], reference_year))


def age_groups(registry: DataFrame, reference_year: int = REFERENCE_YEAR) -> DataFrame:
    aged = with_age(registry, reference_year)
    return binned_counts(aged, bin_index(F.col("age"), AGE_EDGES), AGE_LABELS)


def age_pyramid(
    registry: DataFrame, sexes: Sequence[str] = ("F", "M"), reference_year: int = REFERENCE_YEAR
) -> DataFrame:
    """Patients per age group, one column per sex."""
    aged = with_age(registry, reference_year).filter(F.col("sesso").isin(list(sexes)))
    counts = binned_counts(aged, bin_index(F.col("age"), AGE_EDGES), AGE_LABELS, "sesso")
    wide = counts.groupBy("bin_no", "bin").pivot("sesso", list(sexes)).agg(F.sum("n_rows"))
    return wide.fillna(0, subset=list(sexes))


def share_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their percentage of all rows that have one."""
    present = df.filter(F.col(column).isNotNull())
    total = present.agg(F.count(F.lit(1))).scalar()
    counts = present.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("percent", F.col("n_rows") / total * 100)
