"""Feature tables: flat, elapsed-time, age-fraction and macro/micro."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import (
    AGE_FACTOR,
    AS_OF,
    ELAPSED_KIND,
    FEATURE_ORDER,
    FILL_ELAPSED,
    FILL_FLAT,
    FLAT_EXTRA,
    FLAT_KIND,
    KEY,
    MACRO_MICRO_ORDER,
    SEED,
    SPLIT_80_20,
)
from vitaline.functions.dates import age_fraction as fraction_of_age
from vitaline.functions.dates import day_number, lived_days, months_between_births
from vitaline.functions.encode import decay, label_code, sex_code, token_only, token_or_number
from vitaline.operators.balance import split_patients
from vitaline.operators.skew import (
    collapse_copies,
    expand_copies,
    fits_broadcast,
    join_on_key,
    lookup,
    number_rows,
    running_total,
)
from vitaline.operators.timeline import union_all
from vitaline.schemas import YEAR_COLUMNS
from vitaline.session import cut
from vitaline.sources.tables import Tables

CODE_COLUMNS = ["codiceamd", "codiceatc", "codicestitch", "descrizionefarmaco", "tipo", "extra"]
ELAPSED_CODE_COLUMNS = ["codiceamd", "codiceatc", "codicestitch", "descrizionefarmaco", "tipo"]


def event_rows(
    tables: Tables,
    order: Sequence[str] = FEATURE_ORDER,
    kinds: Mapping[str, str] | None = None,
    extras: Mapping[str, str] | None = None,
    date: str = "data",
) -> DataFrame:
    """All events in one frame; columns a table lacks are null, `src` is the table's place in `order`.

    Numbers and texts of `valore` stay apart, as `valore_num` and `valore_txt`.
    """
    frames = []
    for place, name in enumerate(order):
        df = getattr(tables, name)
        kind = dict(df.dtypes).get("valore")
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if kind == "string":
            text = F.col("valore")
        elif kind is not None:
            number = F.col("valore").cast("double")
        tags = {"src": F.lit(place), "valore_num": number, "valore_txt": text}
        if kinds is not None:
            tags["tipo"] = F.lit(kinds[name])
        if extras is not None:
            tags["extra"] = F.lit(extras[name])
        frames.append(df.withColumns(tags).drop("valore"))
    rows = union_all(frames, fill_missing=True)
    return rows.select(*KEY, date, *[c for c in rows.columns if c not in [*KEY, date]])


def first_seen_codes(events: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(column, value, code): values numbered from 0 by where they appear first in `order`, null included.

    The events are read once, for the distinct combinations of the columns; these are code lists.
    """
    return _codes_of_combos(_combos(events, columns, order), columns, order)


def _combos(events: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct combinations of the columns and the place each appears first; missing order values are last."""
    place = [part for c in order for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))]
    return cut(events.groupBy(*columns).agg(F.min(F.struct(*place)).alias("_seen")))


def _codes_of_combos(
    combos: DataFrame, columns: Sequence[str], order: Sequence[str], small: bool | None = None
) -> DataFrame:
    tall = combos.unpivot(["_seen"], list(columns), "column", "value")
    firsts = tall.groupBy("column", "value").agg(F.min("_seen").alias("_seen"))
    parts = [part for c in order for part in (f"no_{c}", c)]
    places = firsts.select("column", "value", *[F.col(f"_seen.{c}").alias(f"_at_{c}") for c in parts])
    ranked = running_total(places, [*[f"_at_{c}" for c in parts], "value"], by=["column"], small=small)
    return ranked.select("column", "value", (F.col("running") - 1).cast("int").alias("code"))


def encode_first_seen(
    events: DataFrame, columns: Sequence[str], order: Sequence[str], null_code: bool = True
) -> DataFrame:
    """The columns replaced by their first-seen codes; a null has its own code or, without `null_code`,
    stays null while its number remains used up. One lookup on the combination of all columns."""
    combos = _combos(events, columns, order)
    small = fits_broadcast(combos)
    codes = _codes_of_combos(combos, columns, order, small or None)
    if not null_code:
        codes = codes.filter(F.col("value").isNotNull())
    tall = (
        combos.withColumn("_row", F.struct(*columns))
        .unpivot(["_row"], list(columns), "_column", "_value")
        .join(
            codes,
            (F.col("_column") == F.col("column")) & F.col("_value").eqNullSafe(F.col("value")),
            "left",
        )
    )
    wide = tall.groupBy("_row").agg(
        *[F.max(F.when(F.col("_column") == c, F.col("code"))).alias(f"_code_{c}") for c in columns]
    )
    book = wide.select(*[F.col(f"_row.{c}").alias(c) for c in columns], *[f"_code_{c}" for c in columns])
    coded = lookup(events, book, columns, small=small)
    return coded.withColumns({c: F.col(f"_code_{c}") for c in columns}).drop(*[f"_code_{c}" for c in columns])


def sorted_codes(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds `code`: distinct non-null (is_text, num, txt) values numbered from 0, numbers before texts."""
    ranked = running_total(values.distinct(), ["is_text", "num", "txt"], by=list(by))
    return ranked.withColumn("code", (F.col("running") - 1).cast("int")).drop("running")


def _mixed(number: Column, text: Column) -> list[Column]:
    return [
        number.isNull().cast("int").alias("is_text"),
        number.alias("num"),
        F.when(number.isNull(), text).alias("txt"),
    ]


def encode_all_sorted(
    df: DataFrame, columns: Mapping[str, tuple[str | None, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Adds out -> code for every out: (number column or None, text column), each with codes as in `encode_sorted`.

    The values of all columns go through one pass of `df`, as (column, value), and one ranking.
    """
    values = [
        F.struct(F.lit(out).alias("_out"), *_mixed(F.col(number) if number else F.lit(None).cast("double"), F.col(text)))
        for out, (number, text) in columns.items()
    ]
    tall = df.select(*by, F.explode(F.array(*values)).alias("_value")).select(*by, "_value.*")
    found = tall.filter(F.col("num").isNotNull() | F.col("txt").isNotNull())
    book = cut(sorted_codes(found, ["_out", *by]))
    for out, (number, text) in columns.items():
        num = F.col(number) if number else F.lit(None).cast("double")
        own = book.filter(F.col("_out") == out).select(
            *by, F.col("num").alias("_num"), F.col("txt").alias("_txt"), F.col("code").alias(out)
        )
        keyed = df.withColumns({"_num": num, "_txt": F.when(num.isNull(), F.col(text))})
        df = lookup(keyed, own, [*by, "_num", "_txt"]).drop("_num", "_txt")
    return df


def encode_sorted(
    df: DataFrame, column: str, out: str, number: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Adds `out`: the code of the sorted distinct values of a text column, or of a pair of number and
    text columns; null stays null. With `by`, each group has its own codes."""
    num = F.col(number) if number else F.lit(None).cast("double")
    parts = [*by, *_mixed(num, F.col(column))]
    values = df.select(*parts).filter(F.col("num").isNotNull() | F.col("txt").isNotNull())
    book = sorted_codes(values, by).select(
        *by,
        F.col("num").alias("_num"),
        F.col("txt").alias("_txt"),
        F.col("code").alias(out),
    )
    keyed = df.withColumns({"_num": num, "_txt": F.when(num.isNull(), F.col(column))})
    return lookup(keyed, book, [*by, "_num", "_txt"]).drop("_num", "_txt")


def flat_features(tables: Tables, date: str = "data", drop_years: bool = True) -> DataFrame:
    """One row per event with the patient's columns; categories are first-seen codes, null is -100."""
    events = event_rows(tables, FEATURE_ORDER, FLAT_KIND, FLAT_EXTRA, date)
    registry = tables.registry
    if drop_years:
        years = [*YEAR_COLUMNS, "delta_annoprimoaccesso", "delta_decesso", "delta_annodiagnosidiabete"]
        registry = registry.drop(*years)
    joined = join_on_key(events, registry, KEY)
    coded = encode_first_seen(joined, CODE_COLUMNS, ["src", date, *KEY])
    return (
        coded.withColumns(
            {
                "sesso": sex_code(F.col("sesso")),
                "valore": F.coalesce("valore_num", token_or_number(F.col("valore_txt"))),
                "label": label_code(F.col("label")),
            }
        )
        .drop("src", "valore_num", "valore_txt")
        .fillna(FILL_FLAT)
    )


def elapsed_events(tables: Tables) -> DataFrame:
    """Distinct encoded events of each patient with their number of copies, written."""
    events = event_rows(tables, FEATURE_ORDER, ELAPSED_KIND)
    joined = join_on_key(events, tables.registry.drop(*YEAR_COLUMNS), KEY)
    coded = encode_first_seen(joined, ELAPSED_CODE_COLUMNS, ["data", "src", *KEY], null_code=False)
    numbers = coded.withColumns(
        {
            "sesso": sex_code(F.col("sesso")),
            "valore": token_only(F.col("valore_txt")),
            "label": label_code(F.col("label")),
        }
    ).drop("valore_num", "valore_txt")
    return cut(collapse_copies(numbers.fillna(FILL_ELAPSED)))


def elapsed_rows(events: DataFrame) -> DataFrame:
    """`elapsed_events` with position, history length and the days since the event before."""
    ties = [c for c in events.columns if c not in [*KEY, "data", "src", "codiceamd", "n_copies"]]
    return number_rows(
        events,
        KEY,
        groups=[day_number(F.col("data")), F.col("src"), F.col("codiceamd")],
        ties=ties,
        weight="n_copies",
        gap="days_since_previous",
    )


def elapsed_features(tables: Tables) -> DataFrame:
    """One row per event with `delta_events`, the decay weight of the days since the patient's event before."""
    events = elapsed_events(tables)
    rows = expand_copies(elapsed_rows(events), counts=events)
    days = F.when(F.col("copy") == 1, F.col("days_since_previous")).otherwise(0)
    return (
        rows.withColumn("days_since_previous", days)
        .withColumn("delta_events", decay(F.col("days_since_previous")))
        .withColumn("step", F.col("start") + F.col("copy"))
        .drop("src", "copy", "start")
    )


def longest_life(registry: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """One row: the largest number of days lived."""
    lived = lived_days(F.col("annonascita"), F.col("annodecesso"), as_of)
    return registry.agg(F.max(lived).alias("max_days"))


def age_fraction(tables: Tables, factor: float = AGE_FACTOR, as_of: dt.date = AS_OF) -> Tables:
    """All dates as shares of the longest life: `delta_*` columns replace them, the birth date stays."""
    longest = longest_life(tables.registry, as_of).scalar()
    birth = F.col("annonascita")

    def share(date: str) -> Column:
        return fraction_of_age(F.col(date), birth, longest, factor)

    registry = tables.registry.withColumns(
        {
            "delta_decesso": share("annodecesso"),  # null while alive
            "delta_annoprimoaccesso": share("annoprimoaccesso"),
            "delta_annodiagnosidiabete": share("annodiagnosidiabete"),
        }
    ).drop("annoprimoaccesso", "annodiagnosidiabete", "annodecesso")
    births = tables.registry.select(*KEY, "annonascita")
    return tables.map_events(
        lambda df: join_on_key(df, births, KEY, "left")
        .withColumn("delta_data", share("data"))
        .drop("annonascita", "data")
    ).replace(registry=registry)


def macro_micro_events(tables: Tables, order: Sequence[str] = MACRO_MICRO_ORDER) -> DataFrame:
    """Diagnoses keep their date as macro events; exams and prescriptions become undated micro events."""
    undated = {
        name: getattr(tables, name).withColumn("data", F.lit(None).cast("date"))
        for name in order
        if name != "diagnosi"
    }
    if "rx_drug" in undated:
        undated["rx_drug"] = undated["rx_drug"].withColumnRenamed("codiceatc", "codiceamd")
    events = event_rows(tables.replace(**undated), order)
    return events.withColumn("is_macro", F.col("src") == F.lit(list(order).index("diagnosi")))


def macro_micro_features(
    tables: Tables,
    fractions: Mapping[str, float] = SPLIT_80_20,
    order: Sequence[str] = MACRO_MICRO_ORDER,
    per_split: bool = False,
    seed: int = SEED,
    ordered: bool = True,
) -> DataFrame:
    """Encoded macro and micro events with dates in months of life; undated events sort first.

    Category codes are shared by all splits, or drawn up per split.
    """
    registry = split_patients(tables.registry, fractions, seed)
    months = {
        c: months_between_births(F.col(c), F.col("annonascita"))
        for c in ("annodiagnosidiabete", "annoprimoaccesso", "annodecesso", "data")
    }
    rows = (
        join_on_key(macro_micro_events(tables, order), registry, KEY)
        .withColumns(months)
        .drop("annonascita", "scolarita", "statocivile", "professione", "descrizionefarmaco", "src", "is_macro")
    )
    by = ["split"] if per_split else []
    of = {"_amd": (None, "codiceamd"), "_stitch": (None, "codicestitch"), "valore": ("valore_num", "valore_txt")}
    coded = encode_all_sorted(rows, of, by)
    features = (
        coded.withColumns(
            {
                "codiceamd": F.col("_amd").cast("double"),
                "codicestitch": F.col("_stitch").cast("double"),
                "valore": F.col("valore").cast("double"),
                "sesso": sex_code(F.col("sesso")).cast("double"),
                "label": label_code(F.col("label")).cast("double"),
                "idpasto": F.col("idpasto").cast("double"),
            }
        )
        .drop("_amd", "_stitch", "valore_num", "valore_txt")
        .fillna(FILL_FLAT)
    )
    return in_patient_order(features) if ordered else features


def in_patient_order(features: DataFrame) -> DataFrame:
    """Rows by patient and date, ties by all other columns: reproducible, and a patient of very many rows is
    spread over several range partitions."""
    rest = [c for c in features.columns if c not in (*KEY, "data")]
    return features.orderBy(*KEY, "data", *rest)
