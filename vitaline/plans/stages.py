"""Stage tables of one session: derived once, kept in the checkpoint folder, read by every later query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vitaline.operators.cohort import cohort_by_codes
from vitaline.plans.clean import clean_and_label
from vitaline.plans.prepare import balanced_tables
from vitaline.session import cut_all, deal_by_input, join_unions, tune
from vitaline.sources.derived import SOURCES, clinical_tables
from vitaline.sources.tables import Tables

_kept: dict[tuple, Tables] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Names, sizes and times of the input tables, so that changed data is derived anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


def _ready(spark: SparkSession, sf_dir: str) -> SparkSession:
    join_unions(spark, False)
    return deal_by_input(tune(spark), [f"{sf_dir}/{name}.parquet" for name in SOURCES])


def _once(spark: SparkSession, sf_dir: str, stage: str, build: Callable[[], Tables]) -> Tables:
    _ready(spark, sf_dir)
    place = (spark.sparkContext.applicationId, sf_dir, stage, _version(spark, sf_dir))
    if place not in _kept:
        _kept[place] = Tables(**cut_all(dict(build().items())))
    return _kept[place]


def raw(spark: SparkSession, sf_dir: str) -> Tables:
    return clinical_tables(_ready(spark, sf_dir), sf_dir)


def cohort(spark: SparkSession, sf_dir: str) -> Tables:
    """The cardiovascular cohort without undated diagnoses."""
    kept = cohort_by_codes(raw(spark, sf_dir))
    return kept.replace(diagnosi=kept.diagnosi.filter(F.col("data").isNotNull()))


def clean(spark: SparkSession, sf_dir: str) -> Tables:
    return _once(spark, sf_dir, "clean", lambda: clean_and_label(raw(spark, sf_dir)))


def balanced(spark: SparkSession, sf_dir: str) -> Tables:
    return _once(spark, sf_dir, "balanced", lambda: balanced_tables(clean(spark, sf_dir)))
