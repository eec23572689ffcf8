"""The dated events of all tables as one timeline, and what a history looks like per patient."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaline.config import CARDIO_CODES, KEY, MIN_EVENTS, MIN_SPAN_DAYS
from vitaline.operators.cohort import keep_tables
from vitaline.sources.tables import Tables


def union_all(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)


def event_timeline(tables: Tables, with_rx: bool = True) -> DataFrame:
    """(patient, date) of every dated event."""
    dated = [df.select(*KEY, "data") for df in tables.events(with_rx).values()]
    return union_all(dated).filter(F.col("data").isNotNull())


def marked_events(
    tables: Tables, codes: Sequence[str] = CARDIO_CODES, with_rx: bool = True
) -> DataFrame:
    """(patient, date, target) of every event, `target` telling a diagnosis in `codes`."""
    return union_all(
        [
            df.select(
                *KEY,
                "data",
                (F.col("codiceamd").isin(list(codes)) if name == "diagnosi" else F.lit(False)).alias("target"),
            )
            for name, df in tables.events(with_rx).items()
        ]
    )


def daily_rollup(
    tables: Tables,
    codes: Sequence[str] = CARDIO_CODES,
    with_rx: bool = True,
    keep_undated: bool = False,
) -> DataFrame:
    """Events and target events per patient and day: at most one row per day of a life.

    Rows are counted before the shuffle, so a patient with very many events moves few rows, and every
    later question about first, last or number of events reads this table instead of the events.
    """
    rows = marked_events(tables, codes, with_rx)
    return (
        (rows if keep_undated else rows.filter(F.col("data").isNotNull()))
        .groupBy(*KEY, "data")
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if("target").alias("n_target"))
    )


def day_gaps(events: DataFrame, key: Sequence[str] = KEY, date: str = "data") -> DataFrame:
    """Per key and day with events: their number, and the days since the day before that had any (0 first).

    Events are counted per day before days are compared, so a window holds one row per day.
    """
    days = events.filter(F.col(date).isNotNull()).groupBy(*key, date).agg(F.count(F.lit(1)).alias("n_events"))
    before = F.lag(date).over(W.partitionBy(*key).orderBy(date))
    gap = F.coalesce(F.datediff(F.col(date), before), F.lit(0))
    return days.withColumn("days_since_previous", gap)


def first_last(timeline: DataFrame) -> DataFrame:
    """First and last event, number of events and days between per patient."""
    return timeline.groupBy(*KEY).agg(
        F.min("data").alias("first_event"),
        F.max("data").alias("last_event"),
        F.count("data").alias("n_events"),
        F.datediff(F.max("data"), F.min("data")).alias("span_days"),
    )


def first_event(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy(*KEY).agg(F.min("data").alias("first_event"))


def last_event(timeline: DataFrame, alias: str = "last_event") -> DataFrame:
    return timeline.groupBy(*KEY).agg(F.max("data").alias(alias))


def history_longer_than(timeline: DataFrame, days: int = MIN_SPAN_DAYS) -> DataFrame:
    """Patients whose first and last event lie more than `days` days apart."""
    spans = timeline.groupBy(*KEY).agg(F.datediff(F.max("data"), F.min("data")).alias("span_days"))
    return spans.filter(F.col("span_days") > days).select(*KEY)


def with_min_events(timeline: DataFrame, least: int = MIN_EVENTS) -> DataFrame:
    counts = timeline.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.filter(F.col("n_events") >= least)


def filter_by_history_span(tables: Tables, timeline: DataFrame, min_days: int = MIN_SPAN_DAYS) -> Tables:
    return keep_tables(tables, history_longer_than(timeline, min_days))
