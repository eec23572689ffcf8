"""The bundle of eight tables, and how it is read and written stage by stage."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaline import schemas
from vitaline.config import EVENT_TABLES, KEY, PRESCRIPTIONS, STEMS
from vitaline.sources.commits import check_committed, committed, write_committed, write_frame  # noqa: F401
from vitaline.sources.quoted_csv import CSV, read_quoted_csv

# Texts a CSV may hold for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Folder and suffix of each stage; the raw stage has neither suffix nor prescription mark.
STAGES = {"raw": ("data", ""), "clean": ("clean_data", "_c"), "balanced": ("balanced_data", "_b")}


@dataclasses.dataclass(frozen=True)
class Tables:
    """One patient registry and seven tables of dated events."""

    registry: DataFrame
    diagnosi: DataFrame
    labs: DataFrame
    labs_calc: DataFrame
    instrumental: DataFrame
    rx_drug: DataFrame
    rx_other: DataFrame
    rx_nondiab: DataFrame

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((f.name, getattr(self, f.name)) for f in dataclasses.fields(self))

    def events(self, with_rx: bool = True) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in EVENT_TABLES if with_rx or n not in PRESCRIPTIONS}

    def replace(self, **changed: DataFrame) -> Tables:
        return dataclasses.replace(self, **changed)

    def map_events(self, fn: Callable[[DataFrame], DataFrame], names: Iterable[str] = EVENT_TABLES) -> Tables:
        return self.replace(**{n: fn(getattr(self, n)) for n in names})


def table_path(root: str, stage: str, name: str, with_rx: bool = True) -> str:
    """Where a table of a stage is kept; the path tells whether prescriptions counted as events."""
    folder, suffix = STAGES[stage]
    mark = "_pres" if with_rx and suffix else ""
    return f"{root}/{folder}/{STEMS[name]}{suffix}{mark}"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, row_index: bool = False, multi_line: bool = True
) -> DataFrame:
    """A CSV with a header, each column parsed to its type or failing; `row_index`: drop the first column.

    The header must name the columns of `schema` in their order; the row index may have any name. With
    `multi_line` fields may hold line breaks: records are then looked for in all blocks of a file at once, see
    `quoted_csv`, and written as a table. Without it files are read as they are, once for each result.
    """
    names = [*(["_index"] if row_index else []), *schema.names]
    header = spark.read.options(**CSV, inferSchema=False).csv(path).columns
    found = [c.strip() for c in header[1:]] if row_index else [c.strip() for c in header]
    if found != schema.names:
        raise ValueError(f"{path} has the columns {found}, not {schema.names}")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if multi_line:
        frame = read_quoted_csv(spark, path, texts)
    else:
        frame = spark.read.schema(texts).options(**CSV, enforceSchema=True).csv(path)
    return frame.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def _typed(text, kind: T.DataType):
    present = F.when(~text.isin(MISSING_TEXTS), text)
    if isinstance(kind, T.DateType):
        return F.to_date(present, "yyyy-MM-dd")
    if isinstance(kind, T.IntegerType | T.LongType):  # "3.0" is an integer written by a float column
        return present.cast("double").cast(kind)
    return present.cast(kind)


def record_path(root: str, stage: str, with_rx: bool = True) -> str:
    """Where the commit record of a stage is kept."""
    folder, suffix = STAGES[stage]
    return f"{root}/{folder}/_commit{suffix}{'_pres' if with_rx and suffix else ''}"


def read_tables(
    spark: SparkSession,
    root: str,
    stage: str,
    with_rx: bool = True,
    fmt: str = "parquet",
    multi_line: bool = True,
    check: str = "rows",
) -> Tables:
    """The eight tables of a stage. Parquet, and CSV without `multi_line`, is read when a result is asked for.

    A stage must be committed and pass `check` (see `check_committed`); raw tables come from elsewhere and are
    taken as they are.
    """
    kinds = _kinds(stage)
    frames = {}
    for name in STEMS:
        path = table_path(root, stage, name, with_rx)
        if fmt == "csv":
            frames[name] = read_csv(spark, f"{path}.csv", kinds[name], row_index=stage == "raw", multi_line=multi_line)
        else:
            frames[name] = spark.read.schema(kinds[name]).parquet(f"{path}.parquet")
    if stage != "raw":
        check_committed(spark, record_path(root, stage, with_rx), frames, check)
    return Tables(**frames)


def write_tables(tables: Tables, root: str, stage: str, with_rx: bool = True, fmt: str = "parquet") -> DataFrame:
    """All eight tables in the column types of the stage, and their commit record, which is returned; raw CSV has
    a row index in front."""
    kinds = _kinds(stage)
    index = [F.monotonically_increasing_id().alias("_index")] if stage == "raw" and fmt == "csv" else []
    frames = {}
    for name, frame in tables.items():
        typed = frame.select(*index, *[F.col(f.name).cast(f.dataType) for f in kinds[name].fields])
        frames[name] = typed, f"{table_path(root, stage, name, with_rx)}.{fmt}"
    return write_committed(tables.registry.sparkSession, frames, record_path(root, stage, with_rx), fmt)


def _kinds(stage: str) -> dict[str, T.StructType]:
    return schemas.RAW if stage == "raw" else schemas.CLEAN


def _write_one(frame: DataFrame, folder: str, name: str) -> DataFrame:
    return write_committed(frame.sparkSession, {name: (frame, f"{folder}/{name}.parquet")}, f"{folder}/_commit_{name}")


def _read_one(spark: SparkSession, folder: str, name: str, check: str) -> DataFrame:
    record = f"{folder}/_commit_{name}"
    committed(spark, record)
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    check_committed(spark, record, {name: frame}, check)
    return frame


def write_age_fraction_tables(tables: Tables, root: str) -> DataFrame:
    """The tables whose dates became fractions of the longest life; their commit record."""
    folder = f"{root}/delta_eta"
    frames = {name: (frame, f"{folder}/{STEMS[name]}_delta.parquet") for name, frame in tables.items()}
    return write_committed(tables.registry.sparkSession, frames, f"{folder}/_commit")


def read_age_fraction_tables(spark: SparkSession, root: str, check: str = "rows") -> Tables:
    committed(spark, f"{root}/delta_eta/_commit")
    frames = {name: spark.read.parquet(f"{root}/delta_eta/{stem}_delta.parquet") for name, stem in STEMS.items()}
    check_committed(spark, f"{root}/delta_eta/_commit", frames, check)
    return Tables(**frames)


def write_features(features: DataFrame, root: str, name: str) -> DataFrame:
    return _write_one(features, f"{root}/features", name)


def read_features(
    spark: SparkSession, root: str, name: str, fill: float | None = -100.0, check: str = "rows"
) -> DataFrame:
    """A stored feature table with missing numbers filled (`fill=None`: left missing)."""
    stored = _read_one(spark, f"{root}/features", name, check)
    return stored if fill is None else stored.fillna(fill)


def write_texts(texts: DataFrame, root: str) -> DataFrame:
    return _write_one(texts, root, "texts")


def read_texts(spark: SparkSession, root: str, check: str = "rows") -> DataFrame:
    return _read_one(spark, root, "texts", check)


def text_records(texts: DataFrame) -> DataFrame:
    """Records of label and text, as a text model takes them, with the patient and part they belong to."""
    return texts.select(*KEY, "part", "label", "text")


def read_amd_codes(spark: SparkSession, path: str) -> DataFrame:
    """Diagnosis and exam codes with their meaning."""
    return read_csv(spark, path, schemas.AMD_CODES).withColumnRenamed("codice", "codiceamd")


def read_atc_codes(spark: SparkSession, path: str) -> DataFrame:
    """Drug codes with their ingredient."""
    return read_csv(spark, path, schemas.ATC_INFO).select("codiceatc", "atc_nome")
