"""What the text operators share: reading documents, bounded Arrow batches, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BITS = 1 << 23  # of a bitmap by which rows are thinned out: one megabyte, whatever the data
BATCH_ROWS = 1000  # rows of one Arrow batch, so that long texts stay far below an executor's memory
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def batches_out(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """`fn` turns an iterator of Arrow batches into batches of columns by name, on each partition.

    Batches hold at most BATCH_ROWS rows on the way in.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    target = to_arrow_schema(StructType.fromDDL(schema))

    def column(values: object, kind: pa.DataType) -> pa.Array:
        return values if isinstance(values, pa.Array) else pa.array(values, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def map_rows(
    df: DataFrame, columns: Iterable[str], fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str
) -> DataFrame:
    """As `batches_out` with lists on the way in (name -> list); only `columns` are sent to Python."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return fn(dict(zip(names, (c.to_pylist() for c in b.columns), strict=True)) for b in batches)

    return batches_out(df.select(*names), run, schema)


def slot_of(*columns: str, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def bitmap_of(rows: DataFrame, *columns: str, bits: int = BITS) -> np.ndarray:
    """Bits of the slots of rows. Others may share a slot: callers join exactly afterwards."""
    slot = slot_of(*columns, bits=bits) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # bits / 8 bytes at most
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def chosen(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose `slot` is set."""
    return batch.filter(pa.array(in_bitmap(bitmap, batch.column("slot").to_numpy(zero_copy_only=False))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fold(doc_id: Column, parts: int = 5) -> Column:
    """The remainder that deals documents into learning and held-out ones: crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def lower_ascii(text: str) -> bytes:
    """The UTF-8 bytes with A-Z lower-cased and every other byte kept."""
    return text.encode("utf-8", "surrogatepass").lower()
