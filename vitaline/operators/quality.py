"""Values: clipping, overriding, filling and dropping by code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import (
    DIAGNOSIS_OVERRIDES,
    HEIGHT_CODE,
    INSTRUMENTAL_FILLS,
    KEY,
    LAB_RANGES,
    NULL_DROP_CODE,
    SEED,
    WEIGHTED_FILL_CODE,
)
from vitaline.functions.hashing import hash_uniform
from vitaline.operators.skew import collapse_copies, expand_copies, join_on_key, running_total

Ranges = Mapping[str, tuple[float, float]]


def clip_by_code(
    df: DataFrame, ranges: Ranges = LAB_RANGES, code: str = "codiceamd", value: str = "valore"
) -> DataFrame:
    """Values of the listed codes moved to the nearest bound; missing values stay missing."""
    clipped = F.col(value)
    for name, (low, high) in ranges.items():
        mine = F.col(code) == name
        clipped = (
            F.when(mine & (F.col(value) < low), F.lit(low))
            .when(mine & (F.col(value) > high), F.lit(high))
            .otherwise(clipped)
        )
    return df.withColumn(value, clipped)


def out_of_range_report(
    df: DataFrame, ranges: Ranges = LAB_RANGES, code: str = "codiceamd", value: str = "valore"
) -> DataFrame:
    """Per listed code, the number of values outside its range."""
    outside = F.lit(False)
    for name, (low, high) in ranges.items():
        outside = outside | ((F.col(code) == name) & ((F.col(value) < low) | (F.col(value) > high)))
    listed = df.filter(F.col(code).isin(list(ranges)))
    return listed.groupBy(F.col(code).alias("code")).agg(F.count_if(outside).alias("n_outside"))


def override_values(
    df: DataFrame,
    constants: Mapping[str, str] = DIAGNOSIS_OVERRIDES,
    code: str = "codiceamd",
    value: str = "valore",
) -> DataFrame:
    """Every value of a listed code becomes its constant."""
    return df.withColumn(value, _constant_by_code(constants, code, F.col(value), F.lit(True)))


def fill_by_code(
    df: DataFrame,
    constants: Mapping[str, str] = INSTRUMENTAL_FILLS,
    code: str = "codiceamd",
    value: str = "valore",
) -> DataFrame:
    """Missing values of a listed code become its constant."""
    return df.withColumn(value, _constant_by_code(constants, code, F.col(value), F.col(value).isNull()))


def _constant_by_code(constants: Mapping[str, str], code: str, current: Column, where: Column) -> Column:
    filled = current
    for name, constant in constants.items():
        filled = F.when((F.col(code) == name) & where, F.lit(constant)).otherwise(filled)
    return filled


def drop_null_by_code(
    df: DataFrame, name: str = NULL_DROP_CODE, code: str = "codiceamd", value: str = "valore"
) -> DataFrame:
    """Rows of the code without a value go; all others stay, also where code or value is null."""
    doomed = (F.col(code) == name) & F.col(value).isNull()
    return df.filter(~F.coalesce(doomed, F.lit(False)))


def fill_group_mean(
    labs: DataFrame,
    registry: DataFrame,
    name: str = HEIGHT_CODE,
    groups: Sequence[str] = ("M", "F"),
    same_code_only: bool = True,
) -> DataFrame:
    """Missing values of one code become the mean by sex.

    The mean is over the values of the same code, or over all values of that sex with
    `same_code_only=False`. The two means are one row of an aggregate, read as scalars.
    """
    sexes = registry.select(*KEY, "sesso")
    counted = labs.filter(F.col("codiceamd") == name) if same_code_only else labs
    means = join_on_key(counted.filter(F.col("valore").isNotNull()), sexes, KEY).agg(
        F.struct(*[F.avg(F.when(F.col("sesso") == g, F.col("valore"))).alias(g) for g in groups])
    ).scalar()
    missing = (F.col("codiceamd") == name) & F.col("valore").isNull()
    filled = F.col("valore")
    for g in groups:
        filled = F.when(missing & (F.col("sesso") == g), means.getField(g)).otherwise(filled)
    return join_on_key(labs, sexes, KEY).withColumn("valore", filled).drop("sesso")


def value_distribution(
    df: DataFrame, name: str = WEIGHTED_FILL_CODE, code: str = "codiceamd", value: str = "valore"
) -> DataFrame:
    """Values of one code with count, probability and the cumulative counts around them, in value order."""
    present = df.filter((F.col(code) == name) & F.col(value).isNotNull())
    counts = present.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, [value], F.col("n"), out="count_to")
    total = upto.agg(F.max("count_to")).scalar()
    return upto.select(
        value,
        "n",
        (F.col("n") / total).alias("probability"),
        (F.col("count_to") - F.col("n")).alias("count_from"),
        "count_to",
    )


def fill_weighted(
    df: DataFrame,
    name: str = WEIGHTED_FILL_CODE,
    seed: int = SEED,
    code: str = "codiceamd",
    value: str = "valore",
    min_buckets: int = 8192,
) -> DataFrame:
    """Missing values of one code are drawn from the values the code has elsewhere, by their frequency.

    Each missing row draws a position among the known values; the value at that position is found by an
    equi-join on a bucket of positions plus a range check. There are at least twice as many buckets as
    values, so a draw meets one or two of them, and draws spread evenly over the buckets.
    """
    missing = F.coalesce((F.col(code) == name) & F.col(value).isNull(), F.lit(False))
    known = value_distribution(df, name, code, value)
    total = known.agg(F.max("count_to")).scalar()
    n_values = known.agg(F.count(F.lit(1))).scalar()
    width = F.ceil(total / F.greatest(F.lit(min_buckets), n_values * 2)).cast("long")
    intervals = known.select(
        F.col(value).alias("_drawn"),
        "count_from",
        "count_to",
        F.explode(
            F.sequence(_div(F.col("count_from"), width), _div(F.col("count_to") - 1, width))
        ).alias("_bucket"),
    )
    others = [c for c in df.columns if c != value]
    rows = expand_copies(collapse_copies(df.filter(missing).select(*others)))
    draw = F.floor(hash_uniform(seed, "fill", *[F.col(c) for c in others], F.col("copy")) * total)
    drawn = (
        rows.withColumn("_draw", draw)
        .withColumn("_bucket", _div(F.col("_draw"), width))
        .join(intervals, "_bucket", "left")
        # a left join keeps rows when there is nothing to draw from; a bucket may hold several values
        .filter(
            F.col("_drawn").isNull()
            | ((F.col("_draw") >= F.col("count_from")) & (F.col("_draw") < F.col("count_to")))
        )
        .select(*others, F.col("_drawn").alias(value))
        .select(*df.columns)
    )
    return df.filter(~missing).unionByName(drawn)


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def require_numeric(df: DataFrame, columns: Sequence[str] = ("valore",)) -> DataFrame:
    """The columns as doubles; a text that is no number fails in the task that meets it, missing values stay."""

    def number(name: str) -> Column:
        value = F.col(name).try_cast("double")
        told = F.concat(F.lit(f"{name} is not numeric: "), F.col(name).cast("string"))
        return F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(told).cast("double")).otherwise(value)

    return df.withColumns({name: number(name) for name in columns})
