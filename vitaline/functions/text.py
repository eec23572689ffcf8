"""Rendering rows as words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaline.config import FILL_TEXT


def words_of(value: Column) -> Column:
    """A value as text: `=` becomes a space, parentheses, commas and quotes go, null is a placeholder."""
    plain = F.translate(value.cast("string"), "=(),'", " ")
    return F.coalesce(plain, F.lit(FILL_TEXT))


def name_value_pairs(pairs: Sequence[tuple[str, Column]]) -> Column:
    """`name value name value ...`"""
    parts = [part for name, value in pairs for part in (F.lit(name), words_of(value))]
    return F.concat_ws(" ", *parts)


def word_count(text: Column) -> Column:
    return F.size(F.split(text, " ")).cast("long")


def first_words(text: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(text, " "), F.lit(1), count.cast("int")), " ")
