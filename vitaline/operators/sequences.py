"""Per-patient sequences of events: order, length, cap, padding and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import ELAPSED_STEPS, KEY, PAD_DECAY, PAD_ELAPSED, PAD_FLAT
from vitaline.functions.arrays import left_pad, repeat_label
from vitaline.functions.dates import day_number
from vitaline.functions.encode import decay
from vitaline.operators.cohort import keep_patients
from vitaline.operators.skew import collapse_copies, expand_copies, number_rows, running_total, split_parts
from vitaline.operators.timeline import union_all
from vitaline.session import cut
from vitaline.sources.tables import Tables

PART_STEPS = 4096


def history_lengths(events: DataFrame) -> DataFrame:
    """Events per patient."""
    return events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("history_len"))


def table_lengths(tables: Tables) -> DataFrame:
    """Events per registered patient over all event tables; reads the keys only."""
    keys = union_all([df.select(*KEY) for df in tables.events().values()])
    return history_lengths(keep_patients(keys, tables.registry))


def power_cap(longest: Column) -> Column:
    """Largest power of two strictly below `longest`, at least 2."""
    bits = F.length(F.bin(longest - 1))
    return F.greatest(F.lit(2).cast("long"), F.pow(F.lit(2.0), bits - 1).cast("long"))


def sequence_cap(lengths: DataFrame) -> DataFrame:
    """One row: longest history and the cap made from it."""
    return lengths.agg(F.max("history_len").alias("longest")).withColumn("cap", power_cap(F.col("longest")))


def over_cap(lengths: DataFrame, cap: Column) -> DataFrame:
    """One row: number of histories longer than the cap."""
    return lengths.filter(F.col("history_len") > cap).agg(F.count(F.lit(1)).alias("n_over"))


def distinct_events(events: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, written."""
    return cut(collapse_copies(events))


def ordered_history(events: DataFrame, fine: Sequence[str], date: str = "data") -> DataFrame:
    """`distinct_events` with `start` and `total`, in order of date, then `fine`, then all other columns.
    `fine` columns are codes and not null."""
    ties = [c for c in events.columns if c not in [*KEY, date, *fine, "n_copies"]]
    return number_rows(
        events,
        KEY,
        groups=[_order_value(events, date), *[F.col(c) for c in fine]],
        ties=ties or [date],
        weight="n_copies",
    )


def _order_value(events: DataFrame, date: str) -> Column:
    """A date as days, or a date that already is a number; missing dates come last."""
    if dict(events.dtypes)[date] == "date":
        return day_number(F.col(date))
    return F.coalesce(F.col(date).cast("double"), F.lit(float("inf")))


def capped(history: DataFrame, cap: Column | int | None = None, mode: str = "keep_last") -> DataFrame:
    """Ordered rows cut to `cap` events per patient: `start` counts from the first event kept, `cut_copies`
    of a row's copies are gone, `kept` is the number of events kept of the patient.

    `keep_last` keeps the newest `cap` events; `drop_first_k` drops the oldest `cap` events of longer
    histories.
    """
    if mode not in ("keep_last", "drop_first_k"):
        raise ValueError(f"unknown mode {mode!r}")
    none = F.lit(0).cast("long")
    if cap is None:
        return history.withColumns({"cut_copies": none, "kept": F.col("total")})
    limit = (F.lit(cap) if isinstance(cap, int) else cap).cast("long")
    over = F.col("total") - limit if mode == "keep_last" else limit
    kept = history.withColumn("_skip", F.when(F.col("total") > limit, over).otherwise(none))
    return (
        kept.withColumn("cut_copies", F.greatest(F.col("_skip") - F.col("start"), none))
        .filter(F.col("cut_copies") < F.col("n_copies"))
        .withColumn("n_copies", F.col("n_copies") - F.col("cut_copies"))
        .withColumn("start", F.greatest(F.col("start") - F.col("_skip"), none))
        .withColumn("kept", F.col("total") - F.col("_skip"))
        .drop("_skip")
    )


def steps_of(
    events: DataFrame,
    fine: Sequence[str],
    cap: Column | int | None = None,
    mode: str = "keep_last",
    date: str = "data",
) -> DataFrame:
    """One row per event kept of `distinct_events`, with its `step` from 1."""
    rows = expand_copies(capped(ordered_history(events, fine, date), cap, mode), counts=events)
    return rows.withColumn("step", F.col("start") + F.col("copy")).drop("start", "copy", "cut_copies", "kept")


def as_arrays(
    rows: DataFrame,
    vectors: dict[str, Column],
    firsts: dict[str, Column] | None = None,
    carry: Sequence[str] = ("label",),
    part_steps: int = PART_STEPS,
) -> DataFrame:
    """Capped rows gathered into arrays in order, at most `part_steps` to a row.

    A history of up to `part_steps` events is one row with part 0; the parts of a longer one follow each
    other. `firsts` gives the value of the first copy of a row where it differs from that of the others.
    Copies travel as a number and are written out inside the arrays. `carry` is constant per patient.
    """
    firsts = firsts or {}
    dealt = split_parts(rows, part_steps)
    leads = (F.col("from_copy") + F.col("cut_copies") == 0).cast("int")
    entry = F.struct(
        (F.col("start") + F.col("from_copy")).alias("at"),
        F.col("copies").cast("int").alias("n"),
        leads.alias("lead"),
        *[v.alias(n) for n, v in vectors.items()],
        *[v.alias(f"first_{n}") for n, v in firsts.items()],
    )

    def written(name: str) -> Column:
        def copies(e: Column) -> Column:
            if name not in firsts:
                return F.array_repeat(e[name], e["n"])
            head = F.array_repeat(e[f"first_{name}"], e["lead"])
            return F.concat(head, F.array_repeat(e[name], e["n"] - e["lead"]))

        return F.flatten(F.transform("_entries", copies)).alias(name)

    parts = dealt.groupBy(*KEY, F.col("part").cast("int").alias("part")).agg(
        *[F.any_value(c).alias(c) for c in carry], F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    return parts.select(*KEY, "part", *carry, *[written(n) for n in vectors])


def vector_of(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns])


def flat_sequences(
    features: DataFrame,
    cap: Column | int | None = None,
    mode: str = "keep_last",
    date: str = "data",
    keep_date: bool = False,
    pad_to: Column | int | None = None,
    pad_value: float = PAD_FLAT,
    part_steps: int = PART_STEPS,
) -> DataFrame:
    """Arrays of step vectors from the flat features; by default the date only orders.

    With `pad_to`, a history of fewer steps has rows of `pad_value` in front. Parts are cut by place in the
    padded sequence: part p holds the places from p * part_steps on, and parts of padding alone are there too.
    """
    history = ordered_history(distinct_events(features), ["extra", "codiceamd"], date)
    dropped = [*KEY, "label", *([] if keep_date else [date])]
    columns = [c for c in features.columns if c not in dropped]
    rows = capped(history, cap, mode)
    vectors = {"steps": vector_of(columns)}
    if pad_to is None:
        return as_arrays(rows, vectors, part_steps=part_steps)
    wanted = F.lit(pad_to) if isinstance(pad_to, int) else pad_to
    pad = F.greatest(wanted.cast("long") - F.col("kept"), F.lit(0).cast("long"))
    rows = rows.withColumn("pad", pad).withColumn("start", F.col("start") + F.col("pad"))
    arrays = as_arrays(rows, vectors, carry=("label", "pad"), part_steps=part_steps)
    row = F.array_repeat(F.lit(pad_value).cast("float"), len(columns))
    here = F.greatest(F.col("pad") - F.col("part") * part_steps, F.lit(0)).cast("int")
    filled = F.concat(F.array_repeat(row, F.least(here, F.lit(part_steps))), "steps")
    # whole parts of padding come from each patient's first part that has events, in the same pass
    first = F.col("part") == F.floor(F.col("pad") / part_steps)
    own = F.col("_part") == F.col("part")
    return (
        arrays.withColumn("_part", F.explode(F.sequence(F.when(first, 0).otherwise(F.col("part")), F.col("part"))))
        .withColumn("steps", F.when(own, filled).otherwise(F.array_repeat(row, part_steps)))
        .withColumn("part", F.col("_part"))
        .drop("_part", "pad")
    )


def elapsed_sequences(rows: DataFrame, length: int = ELAPSED_STEPS) -> DataFrame:
    """Per patient the last `length` encoded events, their decay weights and the label once per step.

    `rows` are those of `elapsed_rows`. All three arrays have exactly `length` entries.
    """
    reserved = [*KEY, "data", "src", "label", "n_copies", "start", "total", "days_since_previous"]
    columns = [c for c in rows.columns if c not in reserved]
    arrays = as_arrays(
        capped(rows, length),
        {"steps": vector_of(columns), "elapsed": decay(F.lit(0)).cast("float")},
        firsts={"elapsed": decay(F.col("days_since_previous")).cast("float")},
        part_steps=length,
    )
    row = F.array_repeat(F.lit(PAD_ELAPSED).cast("float"), len(columns))
    return arrays.select(
        *KEY,
        left_pad(F.col("steps"), length, row).alias("steps"),
        left_pad(F.col("elapsed"), length, F.lit(PAD_DECAY).cast("float")).alias("elapsed"),
        repeat_label(F.col("label").cast("float"), length).alias("labels"),
    )


def batch_ids(patients: DataFrame, n_batches: int | Column, key: Sequence[str] = KEY) -> DataFrame:
    """`batch_id`: patients in key order cut into equal runs; the last one may be short."""
    total = patients.agg(F.count(F.lit(1))).scalar()
    wanted = F.lit(n_batches) if isinstance(n_batches, int) else n_batches
    size = F.ceil(total / wanted)
    numbered = running_total(patients, list(key), out="_row")
    return numbered.withColumn("batch_id", F.floor((F.col("_row") - 1) / size).cast("long")).drop("_row")
