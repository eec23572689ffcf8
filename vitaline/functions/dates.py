"""Dates: parsing, year numbers, differences and ages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaline.config import AGE_FACTOR, DAYS_PER_MONTH


def parse_iso(text: Column) -> Column:
    """`yyyy-MM-dd` text to a date; malformed text raises."""
    return F.to_date(text, "yyyy-MM-dd")


def year_start(year: Column) -> Column:
    """A year number to 1 January of it."""
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def open_end(end: Column, as_of: dt.date) -> Column:
    """An end date, or `as_of` where it is still open."""
    return F.coalesce(end, F.lit(as_of))


def within_days(later: Column, earlier: Column, days: int) -> Column:
    return F.datediff(later, earlier) <= days


def months_between_births(date: Column, birth: Column) -> Column:
    """Months of 31 days since birth."""
    return F.datediff(date, birth) / F.lit(DAYS_PER_MONTH)


def lived_days(birth: Column, death: Column, as_of: dt.date) -> Column:
    return F.datediff(open_end(death, as_of), birth)


def age_fraction(date: Column, birth: Column, max_days: Column, factor: float = AGE_FACTOR) -> Column:
    """Share of the longest life, stretched by `factor`, that had passed on `date`."""
    return F.datediff(date, birth) / (F.lit(factor) * max_days)


def age_in_years(birth_year: Column, death_year: Column, reference_year: int) -> Column:
    """Age at death, or in `reference_year` when alive."""
    return F.coalesce(death_year, F.lit(reference_year)) - birth_year


def day_number(date: Column) -> Column:
    """Days since 1970-01-01 for ordering; a missing date comes last."""
    return F.coalesce(F.unix_date(date), F.lit(2**31 - 1))
