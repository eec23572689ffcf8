"""Class balance and patient splits, reproducible on any partitioning."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaline.config import COPY_ID_OFFSET, JITTER_SIGMA_DAYS, KEEP_FRACTION, KEY, SEED, SPLIT_60_30_10
from vitaline.functions.hashing import gaussian_days, hash_uniform
from vitaline.operators.cohort import keep_patients
from vitaline.operators.skew import collapse_copies, expand_copies, running_total
from vitaline.session import cut
from vitaline.sources.tables import Tables

SAMPLE_BUCKETS = 1 << 14


def class_sizes(registry: DataFrame) -> DataFrame:
    """Patients per class and their whole-number ratio."""
    negatives, positives = F.count_if(~F.col("label")), F.count_if("label")
    return registry.agg(
        negatives.alias("n_negative"),
        positives.alias("n_positive"),
        F.floor(F.try_divide(negatives, positives)).alias("ratio"),
    )


def require_two_labels(registry: DataFrame) -> DataFrame:
    """The registry, with a label that fails in the task that meets a third value (a missing one counts)."""
    text = F.coalesce(F.col("label").cast("string"), F.lit("null"))
    ends = registry.agg(F.struct(F.min(text).alias("low"), F.max(text).alias("high")).alias("ends")).scalar()
    third = (text != ends["low"]) & (text != ends["high"])
    told = F.concat(F.lit("label has a third value: "), text)
    return registry.withColumn("label", F.when(third, F.raise_error(told).cast("boolean")).otherwise(F.col("label")))


def exact_sample(df: DataFrame, size: Column, seed: int, purpose: str, by: list[str]) -> DataFrame:
    """The `size` rows with the smallest hash uniform of `by`, which tells rows apart; ties in order of `by`.

    Rows are counted by bucket of the uniform. Buckets below the limit are kept whole; only the rows of the
    bucket in which the limit lies are ranked.
    """
    dealt = df.withColumn("_u", hash_uniform(seed, purpose, *[F.col(c) for c in by]))
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_u") * SAMPLE_BUCKETS))
    upto = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_left", size - F.col("_before"))
    rows = dealt.join(F.broadcast(counts.filter("_left > 0")), "_bucket")  # SAMPLE_BUCKETS rows at most
    edge = rows.filter("_n > _left").withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("_u", *by)))
    kept = rows.filter("_n <= _left").select(*df.columns)
    return kept.unionAll(edge.filter("_rank <= _left").select(*df.columns))


def undersample_registry(registry: DataFrame, seed: int = SEED) -> DataFrame:
    """Both classes cut to the size of the smaller one."""
    sizes = registry.agg(F.least(F.count_if(~F.col("label")), F.count_if("label"))).scalar()
    ordered = registry.filter(F.col("label").isNotNull()).withColumn(
        "_u", hash_uniform(seed, "undersample", *[F.col(c) for c in KEY])
    )
    ranked = running_total(ordered, ["_u", *KEY], by=["label"], out="_rank")
    return ranked.filter(F.col("_rank") <= sizes).drop("_u", "_rank").select(*registry.columns)


def undersample(tables: Tables, seed: int = SEED) -> Tables:
    """The registry cut by class, and the events of the patients left."""
    registry = undersample_registry(tables.registry, seed)
    return tables.map_events(lambda df: keep_patients(df, registry)).replace(registry=registry)


@dataclasses.dataclass(frozen=True)
class Copies:
    """What all tables need to know to copy the positive patients."""

    count: int  # of a positive patient
    offset: int  # between the ids of two copies
    positives: DataFrame  # their keys


def copies_of(registry: DataFrame, offset: int | None = None) -> Copies:
    """One pass over the registry for the class sizes and the largest id, and the keys of the positives, written."""
    found = class_sizes(registry).join(registry.agg(F.max(F.abs("idana").cast("long")).alias("largest"))).head()
    digits = len(str(found.largest or 0))
    if offset is not None and found.largest is not None and found.largest >= offset:
        raise ValueError(f"idana {found.largest} needs a copy offset above {offset}")
    apart = max(COPY_ID_OFFSET, 10**digits) if offset is None else offset
    return Copies(max((found.ratio or 0) - 1, 0), apart, cut(registry.filter("label").select(*KEY)))


def copy_plan(registry: DataFrame) -> DataFrame:
    """(patient, copy_id) of the synthetic copies: class ratio - 1 of them per positive patient."""
    ratio = class_sizes(registry).select("ratio").scalar()
    copies = F.coalesce(ratio, F.lit(0)) - F.lit(1)
    ids = F.when(copies >= 1, F.sequence(F.lit(1).cast("long"), copies))
    return registry.filter("label").select(*KEY, F.explode(ids).alias("copy_id"))


def copy_offset(registry: DataFrame, offset: int | None = None) -> Column:
    """How far apart the ids of a patient's copies are: the smallest power of ten above every id, at least
    100000. An `offset` given by the caller is checked against the ids."""
    largest = registry.agg(F.max(F.abs("idana").cast("long")))
    if offset is None:
        digits = largest.select(F.length(F.coalesce(F.col(largest.columns[0]), F.lit(0)).cast("string"))).scalar()
        return F.greatest(F.lit(COPY_ID_OFFSET), F.pow(F.lit(10.0), digits)).cast("long")
    found = largest.head()[0]
    if found is not None and found >= offset:
        raise ValueError(f"idana {found} needs a copy offset above {offset}")
    return F.lit(offset).cast("long")


def synthetic_id(copy_id: Column, offset: Column) -> Column:
    """The id of a copy: negative, so that it is told from the original."""
    return -(F.col("idana") + offset * copy_id)


def oversample_registry(registry: DataFrame, offset: int | None = None) -> DataFrame:
    """The registry with the copies of its positive patients."""
    copies = (
        registry.join(copy_plan(registry), KEY)
        .withColumn("idana", synthetic_id(F.col("copy_id"), copy_offset(registry, offset)))
        .select(*registry.columns)
    )
    return registry.unionByName(copies)


def synthetic_events(
    events: DataFrame,
    registry: DataFrame,
    name: str,
    keep: float = KEEP_FRACTION,
    sigma: float = JITTER_SIGMA_DAYS,
    seed: int = SEED,
    offset: int | None = None,
    exact: bool = False,
    copies: Copies | None = None,
) -> DataFrame:
    """Events of the synthetic copies: a share `keep` of the original's, their dates moved by some days.

    Rows have no id: a row is told apart by its values and, among equal rows, by its number. `keep` is
    the chance of each event, or with `exact` the exact share of all copied events. `copies` hands in what
    several tables share.
    """
    copies = copies or copies_of(registry, offset)
    positives = keep_patients(events, copies.positives)
    numbered = expand_copies(collapse_copies(positives), index="_nth")
    ids = F.sequence(F.lit(1).cast("long"), F.lit(copies.count).cast("long"))
    copied = numbered.withColumn("copy_id", F.explode(ids if copies.count else F.array().cast("array<long>")))
    identity = [F.col(c) for c in [*events.columns, "copy_id", "_nth"]]
    if exact:
        size = F.bround(copied.agg(F.count(F.lit(1))).scalar() * F.lit(keep)).cast("long")
        by = [*events.columns, "copy_id", "_nth"]
        kept = exact_sample(copied, size, seed, f"keep-{name}", by)
    else:
        kept = copied.filter(hash_uniform(seed, f"keep-{name}", *identity) < keep)
    jitter = gaussian_days(
        hash_uniform(seed, f"jitter-{name}", *identity),
        hash_uniform(seed, f"jitter-{name}", *identity, second=True),
        sigma,
    )
    return (
        kept.withColumn("_data", F.date_add("data", jitter))
        .withColumn("idana", synthetic_id(F.col("copy_id"), F.lit(copies.offset).cast("long")))
        .withColumn("data", F.col("_data"))
        .select(*events.columns)
    )


def oversample(
    tables: Tables,
    keep: float = KEEP_FRACTION,
    sigma: float = JITTER_SIGMA_DAYS,
    seed: int = SEED,
    offset: int | None = None,
    exact: bool = False,
    with_rx: bool = True,
) -> Tables:
    """Synthetic copies of the positive patients, in the registry and in every event table."""
    copies = copies_of(tables.registry, offset)
    grown = {
        name: df.unionByName(
            synthetic_events(df, tables.registry, name, keep, sigma, seed, offset, exact, copies)
        )
        for name, df in tables.events(with_rx).items()
    }
    return tables.replace(registry=oversample_registry(tables.registry, offset), **grown)


def split_patients(
    registry: DataFrame, fractions: Mapping[str, float] = SPLIT_60_30_10, seed: int = SEED
) -> DataFrame:
    """The registry with `split`, drawn by patient; the same patient always lands in the same split."""
    u = hash_uniform(seed, "split", *[F.col(c) for c in KEY])
    names = list(fractions)
    split = F.lit(names[-1])
    upto = 1.0
    for name in reversed(names[:-1]):
        upto = round(sum(fractions[n] for n in names[: names.index(name) + 1]), 12)
        split = F.when(u < upto, name).otherwise(split)
    return registry.withColumn("split", split)


def split_exactly(
    registry: DataFrame, fractions: Mapping[str, float] = SPLIT_60_30_10, seed: int = SEED
) -> DataFrame:
    """The registry with `split`: disjoint parts of exactly round(f n) patients, the last one having the rest.

    Patients are dealt in order of the same uniform as in `split_patients`. They are counted by bucket of the uniform
    once; only in the few buckets in which a part ends are they ranked.
    """
    dealt = registry.withColumn("_u", hash_uniform(seed, "split", *[F.col(c) for c in KEY]))
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_u") * SAMPLE_BUCKETS))
    upto = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    names = list(fractions)
    ends, last = [], F.lit(0).cast("long")
    for name in names[:-1]:
        last = last + F.round(F.col("_all") * F.lit(fractions[name])).cast("long")
        ends.append(last)
    inside = F.lit(False)
    for end in ends:
        inside = inside | ((end > F.col("_before")) & (end < F.col("_before") + F.col("_n")))
    rows = dealt.join(F.broadcast(counts.withColumn("_edge", inside)), "_bucket")  # SAMPLE_BUCKETS rows at most
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("_u", *KEY))
    ranked = rows.filter("_edge").withColumn("_place", F.col("_before") + place)
    placed = ranked.unionByName(rows.filter("NOT _edge").withColumn("_place", F.col("_before") + 1))
    split = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends, strict=True))):
        split = F.when(F.col("_place") <= end, name).otherwise(split)
    return placed.withColumn("split", split).select(*registry.columns, "split")


def complement(df: DataFrame, sample: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of `df` whose key is not in `sample`; both hold a key once."""
    return df.join(sample.select(*key), key, "left_anti")
