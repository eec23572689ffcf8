"""Patient histories as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.config import (
    ENGLISH_CALCULATED,
    ENGLISH_DRUG,
    ENGLISH_EVENT,
    ENGLISH_REGISTRY,
    KEY,
    TEXT_HEADINGS,
)
from vitaline.functions.dates import day_number
from vitaline.functions.encode import label_code
from vitaline.functions.text import first_words, name_value_pairs, word_count
from vitaline.operators.skew import collapse_copies, fits_broadcast, join_on_key, lookup, number_rows, split_parts
from vitaline.operators.timeline import union_all
from vitaline.session import cut
from vitaline.sources.tables import Tables

PART_WORDS = 65536


def english(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns projected, ordered and renamed."""
    return df.select(*[F.col(c).alias(n) for c, n in names.items()])


def _pairs(names: Mapping[str, str], drop: tuple[str, ...]) -> Column:
    return name_value_pairs([(n, F.col(c)) for c, n in names.items() if c not in drop])


def _label() -> Column:
    return label_code(F.col("label")).alias("label")


def registry_line(registry: DataFrame) -> DataFrame:
    """`patientregistry idcenter 1 sex M ...`, without the patient id."""
    words = F.concat_ws(" ", F.lit("patientregistry"), _pairs(ENGLISH_REGISTRY, ("idana",)))
    return registry.select(*KEY, words.alias("line"), _label())


def event_line(
    df: DataFrame, name: str, amd: DataFrame, atc: DataFrame, small: bool | None = None
) -> DataFrame:
    """`date ... amdcode ... meaning ... value ...` of one event, without the ids."""
    if name == "rx_drug":
        named, names, code = lookup(df, atc, ["codiceatc"], small=small), ENGLISH_DRUG, "codiceatc"
    else:
        named, code = lookup(df, amd, ["codiceamd"], small=small), "codiceamd"
        names = ENGLISH_CALCULATED if name == "labs_calc" else ENGLISH_EVENT
    line = _pairs(names, tuple(KEY))
    return named.select(*KEY, "data", F.coalesce(code, F.lit("")).alias("code"), line.alias("line"))


def history_lines(tables: Tables, amd: DataFrame, atc: DataFrame) -> DataFrame:
    """Lines of all histories with the patient's label: `table_no` 0 is the registry, then each table's
    heading and events."""
    none = F.lit(None).cast("date")
    registry = registry_line(tables.registry).select(
        *KEY, F.lit(0).alias("table_no"), F.lit(0).alias("is_event"), none.alias("data"), F.lit("").alias("code"), "line", "label"
    )
    headings = F.array(
        *[
            F.struct(F.lit(no).alias("table_no"), F.lit(text).alias("line"))
            for no, text in enumerate(TEXT_HEADINGS.values(), 1)
        ]
    )
    heads = tables.registry.select(*KEY, F.explode(headings).alias("h"), _label()).select(
        *KEY, "h.table_no", F.lit(0).alias("is_event"), none.alias("data"), F.lit("").alias("code"), "h.line", "label"
    )
    labels = tables.registry.select(*KEY, _label())
    parts = [registry, heads]
    small = fits_broadcast(amd) and fits_broadcast(atc)
    for no, name in enumerate(TEXT_HEADINGS, 1):
        lines = event_line(getattr(tables, name), name, amd, atc, small)
        lines = join_on_key(lines, labels)
        parts.append(
            lines.select(*KEY, F.lit(no).alias("table_no"), F.lit(1).alias("is_event"), "data", "code", "line", "label")
        )
    return union_all(parts)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines with copies, words and the number of words before them.

    Order: registry, then table by table the heading and the events, newest first, ties by code and text.
    """
    counted = cut(collapse_copies(lines)).withColumn("words", word_count(F.col("line")))
    counted = counted.withColumn("all_words", F.col("words") * F.col("n_copies"))
    newest_first = F.when(F.col("is_event") == 1, -day_number(F.col("data"))).otherwise(-(2**31 - 1) - 1)
    undated_last = F.when((F.col("is_event") == 1) & F.col("data").isNull(), 1).otherwise(0)
    return number_rows(
        counted,
        KEY,
        groups=[F.col("table_no"), F.col("is_event"), undated_last, newest_first, F.col("code")],
        ties=["line"],
        weight="all_words",
    )


def history_text(
    tables: Tables,
    amd: DataFrame,
    atc: DataFrame,
    max_words: int | None = None,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """One text per patient with its label.

    A text longer than `part_words` words goes on in further rows with part 1, 2, ...; joining the parts
    by a space gives the whole text, so that no row has to hold a history of any length. `max_words`
    keeps the head of each history.
    """
    lines = ordered_lines(history_lines(tables, amd, atc)).drop("all_words", "total")
    if max_words is not None:
        begun = F.ceil((F.lit(max_words) - F.col("start")) / F.col("words")).cast("long")
        lines = lines.withColumn("n_copies", F.least(F.col("n_copies"), begun)).filter("n_copies > 0")
    dealt = split_parts(lines, part_words, F.col("words"))
    at = F.col("start") + F.col("from_copy") * F.col("words")
    entry = F.struct(at.alias("at"), F.col("copies").cast("int").alias("n"), "line")
    copies = F.flatten(F.transform("_entries", lambda e: F.array_repeat(e["line"], e["n"])))
    text = F.array_join(copies, " ")
    if max_words is not None:
        text = first_words(text, F.lit(max_words) - F.col("_entries")[0]["at"])
    return (
        dealt.groupBy(*KEY, F.col("part").cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"), F.any_value("label").alias("label"))
        .select(*KEY, "part", text.alias("text"), "label")
    )


def text_lengths(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("n_words", word_count(F.col(text)))


def longest_texts(texts: DataFrame, n: int = 100, text: str = "text", position: str = "position") -> DataFrame:
    """The `n` texts with most words; of equally long ones the earlier."""
    return text_lengths(texts, text).orderBy(F.desc("n_words"), position).limit(n)
