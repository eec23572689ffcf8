"""Removing what would give the label away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import CARDIO_CODES, KEY, NEGATIVE_TRUNCATION_DAYS, POSITIVE_STRIP_DAYS
from vitaline.operators.skew import join_on_key
from vitaline.operators.timeline import last_event
from vitaline.session import cut
from vitaline.sources.tables import Tables


def last_event_by_label(registry: DataFrame, timeline: DataFrame) -> DataFrame:
    """Label and last event of each labelled patient, written once for the seven joins to it."""
    return cut(registry.select(*KEY, "label").join(last_event(timeline), KEY, "left"))


def truncate_negative(
    events: DataFrame, lasts: DataFrame, days: int = NEGATIVE_TRUNCATION_DAYS
) -> DataFrame:
    """Without the negative patients' events in the last `days` days before their last event."""
    ends = lasts.filter(~F.col("label")).select(*KEY, "last_event")
    late = F.datediff("last_event", "data") <= days
    return (
        join_on_key(events, ends, KEY, "left")
        .filter(~F.coalesce(late, F.lit(False)))
        .drop("last_event")
    )


def truncate_negative_history(
    tables: Tables, lasts: DataFrame, days: int = NEGATIVE_TRUNCATION_DAYS, with_rx: bool = True
) -> Tables:
    names = tables.events(with_rx).keys()
    return tables.map_events(lambda df: truncate_negative(df, lasts, days), names)


def strip_positive_recent_codes(
    diagnosi: DataFrame,
    lasts: DataFrame,
    codes: Sequence[str] = CARDIO_CODES,
    days: int = POSITIVE_STRIP_DAYS,
) -> DataFrame:
    """Without the positive patients' target diagnoses in the last `days` days before their last event."""
    ends = lasts.filter("label").select(*KEY, "last_event")
    doomed = F.col("codiceamd").isin(list(codes)) & (F.datediff("last_event", "data") <= days)
    return (
        join_on_key(diagnosi, ends, KEY, "left")
        .filter(~F.coalesce(doomed, F.lit(False)))
        .drop("last_event")
    )


def remove_leakage(tables: Tables, timeline: DataFrame, with_rx: bool = True) -> Tables:
    """Both rules; the last events are those of the timeline before anything is removed."""
    lasts = last_event_by_label(tables.registry, timeline)
    truncated = truncate_negative_history(tables, lasts, with_rx=with_rx)
    return truncated.replace(diagnosi=strip_positive_recent_codes(truncated.diagnosi, lasts))
