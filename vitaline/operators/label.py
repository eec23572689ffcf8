"""The label: was there a target event shortly before the end of the history?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import CARDIO_CODES, KEY, LABEL_WINDOW_DAYS, MIN_EVENTS, MIN_TRAJECTORY_DAYS
from vitaline.functions.dates import within_days
from vitaline.operators.cohort import with_codes
from vitaline.operators.timeline import marked_events
from vitaline.session import cut
from vitaline.sources.tables import Tables


def label_column(window_days: int = LABEL_WINDOW_DAYS) -> Column:
    return within_days(F.col("last_event"), F.col("last_problem"), window_days).alias("label")


def label_recent_event(
    registry: DataFrame,
    timeline: DataFrame,
    diagnosi: DataFrame,
    codes: Sequence[str] = CARDIO_CODES,
    window_days: int = LABEL_WINDOW_DAYS,
    min_events: int = MIN_EVENTS,
    min_span_days: int | None = MIN_TRAJECTORY_DAYS,
) -> DataFrame:
    """The registry with `label`, for patients with enough events, a target event and a long enough history.

    Written once for the joins of the event tables to it.
    """
    histories = timeline.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("data").alias("last_event"),
        F.datediff(F.max("data"), F.min("data")).alias("span_days"),
    )
    problems = with_codes(diagnosi, codes).groupBy(*KEY).agg(F.max("data").alias("last_problem"))
    enough = F.col("n_events") >= min_events
    if min_span_days is not None:
        enough = enough & (F.col("span_days") > min_span_days)
    return cut(_labelled(registry, histories.filter(enough).join(problems, KEY), window_days))


def histories_of_events(
    tables: Tables, codes: Sequence[str] = CARDIO_CODES, with_rx: bool = True
) -> DataFrame:
    """The same straight from the events: one pass over dates and diagnosis codes, one shuffle of sums."""
    events = marked_events(tables, codes, with_rx).filter(F.col("data").isNotNull())
    return events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("data").alias("last_event"),
        F.datediff(F.max("data"), F.min("data")).alias("span_days"),
        F.max(F.when(F.col("target"), F.col("data"))).alias("last_problem"),
    )


def histories_of(days: DataFrame) -> DataFrame:
    """Number of events, last event, last target event and span of each patient, from a daily rollup."""
    return days.groupBy(*KEY).agg(
        F.sum("n_events").alias("n_events"),
        F.max("data").alias("last_event"),
        F.datediff(F.max("data"), F.min("data")).alias("span_days"),
        F.max(F.when(F.col("n_target") > 0, F.col("data"))).alias("last_problem"),
    )


def label_from_histories(
    registry: DataFrame,
    histories: DataFrame,
    window_days: int = LABEL_WINDOW_DAYS,
    min_events: int = MIN_EVENTS,
    min_span_days: int | None = MIN_TRAJECTORY_DAYS,
) -> DataFrame:
    """As `label_recent_event`, from histories. A patient with a dated target event is in the cohort of the
    target codes, so the cohort needs no join of its own."""
    enough = (F.col("n_events") >= min_events) & F.col("last_problem").isNotNull()
    if min_span_days is not None:
        enough = enough & (F.col("span_days") > min_span_days)
    return _labelled(registry, histories.filter(enough), window_days)


def _labelled(registry: DataFrame, histories: DataFrame, window_days: int) -> DataFrame:
    labels = histories.select(*KEY, label_column(window_days)).filter(F.col("label").isNotNull())
    return registry.join(labels, KEY)
