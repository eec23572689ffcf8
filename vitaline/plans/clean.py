"""Raw tables to clean, labelled tables.

All decisions about patients are taken on one daily rollup of the events, so the event tables are read
twice in all: once, narrow, for the rollup and once to be cleaned.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import AS_OF, KEY, LAB_RANGES, MIN_SPAN_DAYS, SEED, STITCH_RANGES
from vitaline.operators.cohort import keep_tables
from vitaline.operators.label import histories_of, label_from_histories
from vitaline.operators.quality import (
    clip_by_code,
    drop_null_by_code,
    fill_by_code,
    fill_group_mean,
    fill_weighted,
    override_values,
)
from vitaline.operators.repair import life_years, plausible_events, repair_from_firsts
from vitaline.operators.timeline import daily_rollup, union_all
from vitaline.session import cut
from vitaline.sources.commits import check_committed, write_committed
from vitaline.sources.tables import Tables


@dataclasses.dataclass(frozen=True)
class Patients:
    """The registry after each step."""

    cohort: DataFrame
    repaired: DataFrame
    spanned: DataFrame
    labelled: DataFrame


def choose_patients(tables: Tables, as_of: dt.date = AS_OF, with_rx: bool = True) -> Patients:
    """Cohort, date repair, span filter and label, from the daily rollup alone."""
    # A rollup row without a date keeps a patient whose only target diagnosis is undated in the cohort.
    rollup = cut(daily_rollup(tables, with_rx=with_rx, keep_undated=True))
    per_patient = rollup.groupBy(*KEY).agg(
        F.min("data").alias("first_event"), F.sum("n_target").alias("n_target")
    )
    # Written, as it is joined twice: otherwise the rollup would be shuffled by patient for each join.
    chosen = cut(per_patient.filter(F.col("n_target") > 0).select(*KEY, "first_event"))
    cohort = tables.registry.join(chosen, KEY, "left_semi")
    repaired = cut(repair_from_firsts(cohort, chosen, as_of))

    lives = life_years(repaired, as_of)
    year = F.year("data")
    days = (
        rollup.join(lives, KEY)
        .filter((year >= F.col("birth_year")) & (year <= F.col("end_year")))
        .drop("birth_year", "end_year")
    )
    histories = cut(histories_of(days))
    spanned = repaired.join(histories.filter(F.col("span_days") > MIN_SPAN_DAYS), KEY, "left_semi")
    labelled = cut(label_from_histories(spanned, histories))
    return Patients(cohort, repaired, spanned, labelled)


def clean_values(tables: Tables, seed: int = SEED) -> Tables:
    """Clip, override, fill and drop values; two registry columns go."""
    labs = clip_by_code(tables.labs, LAB_RANGES)
    return tables.replace(
        registry=tables.registry.drop("tipodiabete", "origine"),
        diagnosi=override_values(tables.diagnosi),
        labs=fill_group_mean(labs, tables.registry),
        labs_calc=clip_by_code(tables.labs_calc, STITCH_RANGES, code="codicestitch"),
        instrumental=fill_by_code(tables.instrumental),
        rx_other=fill_weighted(drop_null_by_code(tables.rx_other), seed=seed),
    )


def clean_and_label(
    tables: Tables, as_of: dt.date = AS_OF, seed: int = SEED, with_rx: bool = True
) -> Tables:
    """The eight clean tables; each event table is joined once, to the patients that are left."""
    patients = choose_patients(tables, as_of, with_rx)
    kept = tables.map_events(lambda df: plausible_events(df, patients.labelled, as_of))
    return clean_values(kept.replace(registry=patients.labelled), seed)


def chained_steps(tables: Tables, as_of: dt.date = AS_OF, seed: int = SEED, with_rx: bool = True) -> dict[str, Tables]:
    """The eight tables after each step, every step applied to what the one before has left."""
    patients = choose_patients(tables, as_of, with_rx)
    cohort = keep_tables(tables, patients.cohort.select(*KEY))
    cohort = cohort.replace(diagnosi=cohort.diagnosi.filter(F.col("data").isNotNull()))

    def left(registry: DataFrame) -> Tables:
        return cohort.map_events(lambda df: plausible_events(df, registry, as_of)).replace(registry=registry)

    labelled = left(patients.labelled)
    return {
        "1 cohort": cohort,
        "2 dates": left(patients.repaired),
        "3 span": left(patients.spanned),
        "5 label": labelled,
        "6 clean": clean_values(labelled, seed),
    }


def written_steps(
    tables: Tables, folder: str, as_of: dt.date = AS_OF, seed: int = SEED, with_rx: bool = True
) -> dict[str, DataFrame]:
    """The commit record of each step (see `chained_steps`): its tables are written below `folder`, each made from
    the written tables of the step before, so every table is read once a step and its rows are told by the write."""
    spark = tables.registry.sparkSession
    patients = choose_patients(tables, as_of, with_rx)
    records: dict[str, DataFrame] = {}

    def kept(step: str, of: Tables) -> Tables:
        place = f"{folder}/{step.replace(' ', '_')}"
        frames = {name: (frame, f"{place}/{name}") for name, frame in of.items()}
        records[step] = write_committed(spark, frames, f"{place}/_commit")
        back = {name: spark.read.schema(frame.schema).parquet(path) for name, (frame, path) in frames.items()}
        check_committed(spark, f"{place}/_commit", back)
        return Tables(**back)

    cohort = keep_tables(tables, patients.cohort.select(*KEY))
    left = kept("1 cohort", cohort.replace(diagnosi=cohort.diagnosi.filter(F.col("data").isNotNull())))
    for step, registry in (("2 dates", patients.repaired), ("3 span", patients.spanned), ("5 label", patients.labelled)):
        if step == "2 dates":
            events = left.map_events(lambda df: plausible_events(df, patients.repaired, as_of))
        else:  # a patient's dates do not change any more, so only patients go
            keys = registry.select(*KEY)
            events = left.map_events(lambda df, keys=keys: df.join(keys, KEY, "left_semi"))
        left = kept(step, events.replace(registry=registry))
    kept("6 clean", clean_values(left, seed))
    return records


def patient_funnel(patients: Patients) -> DataFrame:
    """(step, patients) after each step, and the classes of the last."""
    steps = {
        "1 cohort": patients.cohort,
        "2 dates": patients.repaired,
        "3 span": patients.spanned,
        "5 label": patients.labelled,
        "5 label negative": patients.labelled.filter(~F.col("label")),
        "5 label positive": patients.labelled.filter("label"),
    }
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n_patients")).select(F.lit(step).alias("step"), "n_patients")
            for step, df in steps.items()
        ]
    )
