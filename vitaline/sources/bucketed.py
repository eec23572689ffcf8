"""Stage tables kept in buckets of patients, so that later joins and groupings by patient move no rows.

The rows of every table are dealt once, when the stage is written, to the same number of buckets by the patient's
key, and sorted by it. Spark reads a bucket of one table and the same bucket of another in one task, so registry
and events meet without an exchange, in every query that follows.

A bucket cannot be split, so patients who would fill one by themselves stay out of the buckets: whoever has more rows
in a table than an average bucket of it. There are at most as many of them as buckets, a table. Their rows are
kept as plain tables, whose joins broadcast the few registry rows they need and read events as they lie.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.config import KEY
from vitaline.operators.timeline import union_all
from vitaline.session import cut, join_unions, new_folder
from vitaline.sources.tables import Tables

BUCKETS = 64


@dataclasses.dataclass(frozen=True)
class Bucketed:
    """The tables of a stage in two parts: patients in buckets, and those with very many rows."""

    spread: Tables
    hot: Tables

    def per_patient(self, fn: Callable[[Tables], DataFrame]) -> DataFrame:
        """`fn`, which must treat each patient alone, on both parts."""
        return fn(self.spread).unionByName(fn(self.hot))


def hot_patients(tables: Tables, buckets: int = BUCKETS) -> DataFrame:
    """Keys with more rows in an event table than its average bucket; at most `buckets` a table."""
    found = []
    for frame in tables.events().values():
        counts = frame.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        limit = F.greatest(frame.agg(F.count(F.lit(1))).scalar() / F.lit(buckets), F.lit(1.0))
        found.append(counts.filter(F.col("n") > limit).select(*KEY))
    return union_all(found).distinct()


def write_bucketed(tables: Tables, buckets: int = BUCKETS) -> Bucketed:
    """The tables of a stage, dealt to buckets below the application's folder."""
    spark = tables.registry.sparkSession
    folder, mark = new_folder(spark), uuid.uuid4().hex
    hot = cut(hot_patients(tables, buckets))

    def spread(name: str, frame: DataFrame) -> DataFrame:
        table = f"bucketed_{name}_{mark}"
        rows = frame.join(F.broadcast(hot), KEY, "left_anti").repartition(buckets, *KEY)
        writer = rows.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{folder}/{name}").saveAsTable(table)
        return spark.table(table)

    parts = Bucketed(
        Tables(**{name: spread(name, frame) for name, frame in tables.items()}),
        Tables(**{name: cut(frame.join(F.broadcast(hot), KEY, "left_semi")) for name, frame in tables.items()}),
    )
    join_unions(spark, True)
    return parts
