"""Clean tables to balanced tables and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import PAD_FLAT, SEED
from vitaline.operators.balance import oversample, require_two_labels, undersample
from vitaline.operators.features import age_fraction, elapsed_events, elapsed_rows, flat_features
from vitaline.operators.history import history_text
from vitaline.operators.leakage import remove_leakage
from vitaline.operators.sequences import elapsed_sequences, flat_sequences, sequence_cap, table_lengths
from vitaline.operators.timeline import event_timeline
from vitaline.sources.tables import Tables


def balanced_tables(
    tables: Tables, balancing: str = "standard", seed: int = SEED, with_rx: bool = True
) -> Tables:
    """Leakage removed, then positives copied (`standard`) or the larger class cut (`lossy`)."""
    tables = tables.replace(registry=require_two_labels(tables.registry))
    safe = remove_leakage(tables, event_timeline(tables, with_rx), with_rx)
    if balancing == "standard":
        return oversample(safe, seed=seed, with_rx=with_rx)
    if balancing == "lossy":
        return undersample(safe, seed)
    raise ValueError(f"unknown balancing {balancing!r}")


def _cap_and_length(tables: Tables) -> tuple[Column, Column]:
    """The power-of-two cap made from the longest history, and the length of the longest one after the cut."""
    lengths = sequence_cap(table_lengths(tables))
    cap = lengths.select("cap").scalar()
    return cap, F.least(cap, lengths.select("longest").scalar())


def sequence_inputs(tables: Tables, pad_value: float = PAD_FLAT) -> DataFrame:
    """Arrays of step vectors, cut to the cap and padded to the longest."""
    cap, length = _cap_and_length(tables)
    return flat_sequences(flat_features(tables), cap, pad_to=length, pad_value=pad_value)


def age_fraction_inputs(tables: Tables, pad_value: float = PAD_FLAT) -> DataFrame:
    """The same with dates as shares of the longest life; the date is one of the step's entries."""
    features = flat_features(age_fraction(tables), date="delta_data")
    cap, length = _cap_and_length(tables)
    return flat_sequences(features, cap, date="delta_data", keep_date=True, pad_to=length, pad_value=pad_value)


def elapsed_inputs(tables: Tables) -> DataFrame:
    return elapsed_sequences(elapsed_rows(elapsed_events(tables)))


def text_inputs(tables: Tables, amd: DataFrame, atc: DataFrame, max_words: int | None = None) -> DataFrame:
    return history_text(tables, amd, atc, max_words)
