"""Tables written with a commit record: what was written, told by the writes themselves.

The record of a folder lists its tables with their types, rows and an order-free digest of all values. Rows and
digest are metrics observed by the tasks that write, so no table is scanned again for them; only tasks of the write
itself count, each once, so a lost executor does not count rows twice. The record goes before the first table
is replaced and comes after the last one, so a folder that is half written has none and is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaline.sources.quoted_csv import CSV

RECORD = "table string, path string, types string, n_rows long, digest string"
CHECKS = ("record", "rows", "digest")


def _measures(frame: DataFrame) -> list[Column]:
    """Rows and digest. The sum of row hashes has room for 10^19 rows; equal rows count as often as they occur."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]) if frame.columns else F.lit(0).cast("long")
    total = F.sum(row.cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")]


def _types(frame: DataFrame) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in frame.dtypes)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_frame(frame: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = frame.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV).csv(path)
    else:
        writer.parquet(path)


def write_committed(spark: SparkSession, frames: Mapping[str, tuple[DataFrame, str]], record: str, fmt: str = "parquet") -> DataFrame:
    """Write frames (table -> frame and path), then the record at the path `record`; the record's rows.

    All frames must come from other folders than those they are written to.
    """
    _delete(spark, record)

    def write(name: str) -> tuple:
        frame, path = frames[name]
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        write_frame(frame.observe(seen, *_measures(frame)), path, fmt)
        found = seen.get
        return name, path, _types(frame), found["n_rows"], found["digest"]

    with ThreadPoolExecutor(max_workers=max(len(frames), 1)) as pool:
        rows = list(pool.map(write, frames))
    spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("overwrite").parquet(record)
    return committed(spark, record)


def committed(spark: SparkSession, record: str) -> DataFrame:
    """The record at a path; an error where there is none."""
    if not _exists(spark, f"{record}/_SUCCESS"):
        raise ValueError(f"{record}: nothing was committed here")
    return spark.read.schema(RECORD).parquet(record)


def check_committed(spark: SparkSession, record: str, frames: Mapping[str, DataFrame], check: str = "rows") -> None:
    """An error unless `frames` are the tables of the record.

    check: `record` looks at names and types alone, `rows` also counts (for Parquet: in the files' footers),
    `digest` reads all values.
    """
    if check not in CHECKS:
        raise ValueError(f"unknown check {check!r}")
    said = {r.table: r for r in committed(spark, record).collect()}  # a row a table of the stage
    for name, frame in frames.items():
        if name not in said:
            raise ValueError(f"{record} has no table {name}")
        if said[name].types != _types(frame):
            raise ValueError(f"{name} was written as {said[name].types}, not {_types(frame)}")
        if check == "record":
            continue
        n_rows, digest = _measures(frame)
        found = frame.agg(n_rows, digest).first() if check == "digest" else frame.agg(n_rows).first()
        if found.n_rows != said[name].n_rows or check == "digest" and found.digest != said[name].digest:
            raise ValueError(f"{name} is not what was committed: {found.n_rows} rows against {said[name].n_rows}")
