"""Registry dates: typing, filling, consistency; and events outside a patient's life."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import AS_OF, KEY
from vitaline.functions.dates import open_end, year_start
from vitaline.operators.skew import join_on_key
from vitaline.operators.timeline import first_event
from vitaline.schemas import YEAR_COLUMNS
from vitaline.session import cut


def type_registry_years(registry: DataFrame) -> DataFrame:
    """Year numbers to dates; 1 January stands for the year."""
    return registry.withColumns({c: year_start(F.col(c)) for c in YEAR_COLUMNS})


def fill_first_access(registry: DataFrame, firsts: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Missing first access from the first event, if strictly inside the life; else the patient goes."""
    inside = (F.col("first_event") > F.col("annonascita")) & (
        F.col("first_event") < open_end(F.col("annodecesso"), as_of)
    )
    filled = F.coalesce(F.col("annoprimoaccesso"), F.when(inside, F.col("first_event")))
    return (
        registry.join(firsts, KEY, "left")
        .withColumn("annoprimoaccesso", filled)
        .drop("first_event")
        .filter(F.col("annoprimoaccesso").isNotNull())
    )


def fill_diabetes_year(registry: DataFrame) -> DataFrame:
    """A missing diabetes diagnosis is dated by the first access."""
    return registry.withColumn(
        "annodiagnosidiabete", F.coalesce("annodiagnosidiabete", "annoprimoaccesso")
    )


def consistent_registry(registry: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Patients who were first seen and diagnosed no later than the end of their life."""
    end = open_end(F.col("annodecesso"), as_of)
    return registry.filter((F.col("annoprimoaccesso") <= end) & (F.col("annodiagnosidiabete") <= end))


def repair_from_firsts(registry: DataFrame, firsts: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    filled = fill_first_access(type_registry_years(registry), firsts, as_of)
    return consistent_registry(fill_diabetes_year(filled), as_of)


def repair_registry_dates(registry: DataFrame, timeline: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Typed, filled and consistent registry dates, written once for the joins of the event tables to them."""
    return cut(repair_from_firsts(registry, first_event(timeline), as_of))


def registry_probes(registry: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Number of patients breaking each rule, for a registry with typed dates; all in one pass."""
    birth, death = F.col("annonascita"), F.col("annodecesso")
    access, diagnosis = F.col("annoprimoaccesso"), F.col("annodiagnosidiabete")
    end = open_end(death, as_of)
    probes = {
        "birth_before_1900": birth < F.lit(dt.date(1900, 1, 1)),
        "death_after_2023": death > F.lit(dt.date(2023, 1, 1)),
        "diagnosis_before_birth": diagnosis < birth,
        "access_before_birth": access < birth,
        "death_before_birth": end < birth,
        "access_after_death": access > end,
        "diagnosis_after_death": diagnosis > end,
    }
    return registry.agg(*[F.count_if(rule).alias(name) for name, rule in probes.items()])


def life_years(registry: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """First and last year of each patient's life."""
    return registry.select(
        *KEY,
        F.year("annonascita").alias("birth_year"),
        F.year(open_end(F.col("annodecesso"), as_of)).alias("end_year"),
    )


def plausible_events(events: DataFrame, registry: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Events of registered patients dated no earlier than the birth year and no later than the last."""
    joined = join_on_key(events, life_years(registry, as_of), KEY)
    year = F.year("data")
    return joined.filter((year >= F.col("birth_year")) & (year <= F.col("end_year"))).drop(
        "birth_year", "end_year"
    )
