"""Session limits: what is broadcast, how much one task gets, and unions of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaline.operators.timeline import union_all
from vitaline.plans import stages
from vitaline.session import INITIAL_PARTITIONS, LIMITS, PARTITION_BYTES, deal_by_input, tune


def test_limits_leave_what_a_session_says(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "300k")
    tune(spark)
    assert spark.conf.get(name) == "300k"
    spark.conf.unset(name)
    tune(spark)
    assert {k: spark.conf.get(k) for k in LIMITS} == LIMITS


def test_partitions_follow_the_input(spark, tmp_path):
    for name, parts in (("small", 1), ("large", 9)):
        (tmp_path / name).mkdir()
        for part in range(parts):
            (tmp_path / name / f"part-{part}").write_bytes(b"x" * PARTITION_BYTES)
    found = []
    for name in ("small", "large"):
        deal_by_input(spark, [str(tmp_path / name)])
        found.append(int(spark.conf.get(INITIAL_PARTITIONS)))
    spark.conf.unset(INITIAL_PARTITIONS)
    assert found == [int(spark.conf.get("spark.sql.shuffle.partitions")), 9]


def test_compressed_patients_are_not_broadcast(spark, tmp_path):
    """A registry of years is small as a file and large once it is hashed."""
    stages.raw(spark, "/root/testdata/sf0.001")
    spark.range(1 << 20).select(F.col("id").alias("idana"), (F.col("id") % 20).alias("idcentro")).write.parquet(f"{tmp_path}/r")
    assert 1 << 20 < sum(f.stat().st_size for f in (tmp_path / "r").glob("*.parquet")) < 10 << 20
    registry = spark.read.parquet(f"{tmp_path}/r")
    facts = spark.read.parquet(f"{tmp_path}/r").withColumn("v", F.lit(1))
    plan = facts.join(registry, ["idana", "idcentro"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_union_of_joins_keeps_tables_in_tasks_of_their_own(spark):
    stages.raw(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        registry = spark.range(40).select(F.col("id").alias("idana"))
        joins = [spark.range(n).select(F.col("id").alias("idana")).join(registry, "idana") for n in (50, 60, 70)]
        alone = [j.rdd.getNumPartitions() for j in joins]
        assert union_all(joins).rdd.getNumPartitions() == sum(alone)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tune(spark)
