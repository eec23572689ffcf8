"""Commit records: what the writes tell, and which folders are refused."""

from __future__ import annotations

import pytest
from rows import day, event, person, tables
from pyspark.sql import functions as F

from vitaline.sources import commits
from vitaline.sources import tables as source


@pytest.fixture
def bundle(spark):
    return tables(
        spark,
        [person(1, label=True), person(2, died=2003)],
        diagnosi=[event(1, 0), event(1, 3, "AMD049", None), event(1, 3, "AMD049", None)],
        labs=[(1, 1, day(1), "AMD004", 3.5)],
    )


def test_the_record_tells_rows_and_types(spark, tmp_path, bundle):
    record = source.write_tables(bundle, str(tmp_path), "clean")
    said = {r.table: (r.n_rows, r.types) for r in record.collect()}
    assert {name: n for name, (n, _) in said.items() if n} == {"registry": 2, "diagnosi": 3, "labs": 1}
    assert said["labs"][1] == "idana: bigint, idcentro: int, data: date, codiceamd: string, valore: double"
    source.read_tables(spark, str(tmp_path), "clean", check="digest")


def test_the_digest_does_not_depend_on_order_but_on_every_value(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], [1.0, None]) for i in range(50)], "id long, t string, v array<double>")

    def digest(frame, name):
        path = str(tmp_path / name)
        return commits.write_committed(spark, {"t": (frame, path)}, f"{path}_record").first().digest

    first = digest(df, "a")
    assert digest(df.orderBy(F.desc("id")).repartition(5), "b") == first
    changed = df.withColumn("t", F.when(F.col("id") == 7, "c").otherwise(F.col("t")))
    assert digest(changed, "c") != first
    assert digest(df.unionAll(df.where("id = 3")), "d") != first
    assert digest(df.limit(0), "e") == "0"


def test_half_written_stages_are_refused(spark, tmp_path, bundle):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="nothing was committed"):
        source.read_features(spark, root, "flat")
    source.write_tables(bundle, root, "clean")
    broken = bundle.labs.withColumn("valore", F.raise_error(F.lit("disk full")).cast("double"))
    with pytest.raises(Exception, match="disk full"):
        source.write_tables(bundle.replace(labs=broken), root, "clean")
    with pytest.raises(ValueError, match="nothing was committed"):
        source.read_tables(spark, root, "clean")
    source.write_tables(bundle, root, "clean")
    assert source.read_tables(spark, root, "clean").registry.count() == 2


def test_tables_changed_after_the_commit_are_refused(spark, tmp_path, bundle):
    root = str(tmp_path)
    source.write_tables(bundle, root, "clean")
    path = f"{source.table_path(root, 'clean', 'labs')}.parquet"
    other = bundle.labs.withColumn("valore", F.lit(4.5))
    commits.write_frame(other, path)
    source.read_tables(spark, root, "clean")  # as many rows as were committed
    with pytest.raises(ValueError, match="labs is not what was committed"):
        source.read_tables(spark, root, "clean", check="digest")
    commits.write_frame(bundle.labs.limit(0), path)
    with pytest.raises(ValueError, match="0 rows against 1"):
        source.read_tables(spark, root, "clean")
    source.read_tables(spark, root, "clean", check="record")
    with pytest.raises(ValueError, match="unknown check"):
        source.read_tables(spark, root, "clean", check="all")


def test_other_types_are_refused(spark, tmp_path):
    root = str(tmp_path)
    source.write_features(spark.createDataFrame([(1, 2.0)], "id long, v double"), root, "flat")
    commits.write_frame(spark.createDataFrame([(1, 2)], "id long, v int"), f"{root}/features/flat.parquet")
    with pytest.raises(ValueError, match="v: double"):
        source.read_features(spark, root, "flat")


def test_age_fraction_tables_come_back(spark, tmp_path, bundle):
    source.write_age_fraction_tables(bundle, str(tmp_path))
    back = source.read_age_fraction_tables(spark, str(tmp_path), check="digest")
    assert back.diagnosi.exceptAll(bundle.diagnosi).count() == 0
    assert back.diagnosi.count() == 3
