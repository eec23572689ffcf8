"""Turning category text into numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of sex and of the value tokens.
SEX_CODES = {"M": 0, "F": 1}
TOKEN_CODES = {"N": 0, "P": 1, "S": 2}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _mapped(value: Column, codes: dict[str, int]) -> Column:
    mapped = F.lit(None).cast("int")
    for text, code in codes.items():
        mapped = F.when(value == text, code).otherwise(mapped)
    return mapped


def sex_code(sex: Column) -> Column:
    return _mapped(sex, SEX_CODES)


def try_number(text: Column) -> Column:
    """Text to a number, or null where it is none."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def token_or_number(text: Column) -> Column:
    """N, P, S to 0, 1, 2; other text is read as a number, or null."""
    return F.coalesce(_mapped(text, TOKEN_CODES).cast("double"), try_number(text))


def token_only(text: Column) -> Column:
    """N, P, S to 0, 1, 2; anything else is null."""
    return _mapped(text, TOKEN_CODES)


def label_code(label: Column) -> Column:
    """A label, boolean or the text True/False, to 1 or 0."""
    return label.cast("boolean").cast("int")


def decay(days: Column) -> Column:
    """Weight 1 / ln(e + days) of an event that many days after the one before."""
    return F.lit(1.0) / F.ln(F.lit(math.e) + days)
