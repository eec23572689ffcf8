"""Session settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Skewed join partitions are split at run time even where that costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Limits that hold where a session has none of its own. A written table of keys and years takes up to a hundred times
# its file size when it is broadcast, and a shuffled block about thirty times its size when it is sorted and summed.
LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
}
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = 1 << 20  # of input files a shuffle partition, before adaptive execution puts small ones together


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    for name, value in LIMITS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def join_unions(spark: SparkSession, together: bool) -> None:
    """Whether a union of tables that are dealt alike is one task a partition, without an exchange later, or one a
    table and partition: joins that are not in buckets would have the sorts of all tables in one task."""
    spark.conf.set("spark.sql.unionOutputPartitioning", str(together).lower())


def deal_by_input(spark: SparkSession, paths: Sequence[str]) -> SparkSession:
    """Shuffle partitions that follow the bytes of the input, at least as many as the session asks for."""
    size = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, str(max(asked, size // PARTITION_BYTES)))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="vitaline-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def tables_dir(spark: SparkSession) -> str:
    """Where the tables of this application are kept."""
    return f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own beside the tables of this application, removed with them."""
    return f"{tables_dir(spark)}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete all tables `cut` has written in this application, once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it back.

    Later reads see the same rows whichever executors are lost, and know the table's size, so a join
    to it is broadcast only where the written files are small enough.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """`cut` of several tables at once, so that the last tasks of one overlap the first of another."""
    with ThreadPoolExecutor(max_workers=max(len(frames), 1)) as pool:
        return dict(zip(frames, pool.map(cut, frames.values()), strict=True))
