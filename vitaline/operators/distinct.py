"""Distinct patients that add up across tables, stages and code sets: exact bitmaps kept beside a stage.

Patients are numbered densely once. A bitmap row holds which of 32,768 consecutive numbers occur with a value, so a
value has at most a row a block of patients, however many events it has. Blocks of several values, tables or
stages are merged by OR; a count is the number of bits set. No key is shuffled again for another count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import KEY
from vitaline.operators.skew import join_on_key, running_total
from vitaline.operators.timeline import union_all
from vitaline.session import cut
from vitaline.sources.tables import Tables

# where each table has its codes
CODE_OF = {"rx_drug": "codiceatc"}


def patient_numbers(tables: Tables) -> DataFrame:
    """(patient key, patient): numbers from 0 without gaps, of all patients in any table."""
    keys = union_all([df.select(*KEY).distinct() for _, df in tables.items()]).distinct()
    numbered = running_total(keys, KEY, out="_number")
    return cut(numbered.select(*KEY, (F.col("_number") - 1).alias("patient")))


def patient_bitmaps(events: Mapping[str, DataFrame], numbers: DataFrame) -> DataFrame:
    """(table, code, block, bits) of each table's codes; events without a code are left out.

    Equal (code, patient) pairs are first made one, before any row is moved.
    """
    parts = []
    for name, df in events.items():
        code = F.col(CODE_OF.get(name, "codiceamd"))
        rows = df.filter(code.isNotNull()).select(F.lit(name).alias("table"), code.alias("code"), *KEY).distinct()
        parts.append(join_on_key(rows, numbers, KEY).select("table", "code", "patient"))
    number = F.col("patient") + 1  # blocks and positions are counted from 1
    block = F.bitmap_bucket_number(number).alias("block")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    return union_all(parts).groupBy("table", "code", block).agg(bits)


def distinct_patients(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_patients): patients with any of the values merged into a group of `by`."""
    merged = bitmaps.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n_patients"))
