"""Checks inside the plan, parts of exact sizes, dictionaries of several columns from one pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from rows import person, tables

from vitaline.config import KEY, SPLIT_60_30_10
from vitaline.operators import balance, features, quality
from vitaline.plans.prepare import balanced_tables


def labels(spark, values):
    rows = [(i, 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "idana long, idcentro int, label string").repartition(3)


def test_two_labels_pass(spark):
    for values in (["true", "false"] * 9, [None, "true"], ["true"], []):
        out = balance.require_two_labels(labels(spark, values).withColumn("label", F.col("label").cast("boolean")))
        assert sorted(map(str, (r.label for r in out.collect()))) == sorted(str(v).capitalize() for v in values)


def test_a_third_label_fails_in_the_plan(spark):
    mixed = labels(spark, ["true", "false", None]).withColumn("label", F.col("label").cast("boolean"))
    checked = balance.require_two_labels(mixed)  # nothing has run yet
    with pytest.raises(Exception, match="third value: null"):
        checked.collect()


def test_balancing_refuses_a_third_label(spark):
    bundle = tables(spark, [person(1, label=True), person(2, label=False), person(3, label=None)])
    with pytest.raises(Exception, match="third value"):
        balanced_tables(bundle).registry.collect()


def test_values_that_are_no_numbers_fail_where_they_are_met(spark):
    df = spark.createDataFrame([(1, "3.5"), (2, None), (3, "-1e3")], "id long, valore string")
    assert [r.valore for r in quality.require_numeric(df).orderBy("id").collect()] == [3.5, None, -1000.0]
    bad = quality.require_numeric(df.unionAll(spark.createDataFrame([(4, "S")], df.schema)))
    with pytest.raises(Exception, match="valore is not numeric: S"):
        bad.collect()
    assert quality.require_numeric(df.limit(0)).collect() == []
    doubles = spark.createDataFrame([(1.5, None)], "valore double, other int")
    assert tuple(quality.require_numeric(doubles, ["valore", "other"]).first()) == (1.5, None)


@pytest.mark.parametrize("buckets", [1, 4, 1 << 14])
def test_parts_have_exact_sizes(spark, monkeypatch, buckets):
    """However many patients share a bucket, and wherever parts end."""
    monkeypatch.setattr(balance, "SAMPLE_BUCKETS", buckets)
    for n in (0, 1, 7, 250):
        registry = spark.createDataFrame([(i, i % 3, "x") for i in range(n)], "idana long, idcentro int, split_ string")
        out = balance.split_exactly(registry).collect()
        sizes = {k: sum(r.split == k for r in out) for k in SPLIT_60_30_10}
        first, second = (int(f * n + 0.5) for f in list(SPLIT_60_30_10.values())[:2])
        assert list(sizes.values()) == [first, second, n - first - second]
        assert sorted(r.idana for r in out) == list(range(n))


def test_exact_parts_follow_the_drawn_ones(spark):
    """Patients are dealt in the same order as in the split by chance."""
    registry = spark.createDataFrame([(i, 1) for i in range(300)], "idana long, idcentro int")
    drawn = {r.idana: r.split for r in balance.split_patients(registry).collect()}
    exact = {r.idana: r.split for r in balance.split_exactly(registry).collect()}
    assert sum(drawn[i] != exact[i] for i in drawn) < 40


def test_dictionaries_from_one_pass_equal_those_of_one_column(spark):
    rows = [(i, i % 2, "cba"[i % 3], [1.5, None, 0.0][i % 3], ["z", "y", None][i % 5 % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, split int, code string, num double, txt string")
    for by in ([], ["split"]):
        one = features.encode_sorted(features.encode_sorted(df, "code", "a", by=by), "txt", "b", number="num", by=by)
        both = features.encode_all_sorted(df, {"a": (None, "code"), "b": ("num", "txt")}, by)
        assert both.columns == one.columns
        assert both.exceptAll(one).count() == 0
        assert both.count() == one.count() == 30


def test_what_tables_share_about_copies(spark):
    registry = labels(spark, ["false"] * 7 + ["true"] * 2).withColumn("label", F.col("label").cast("boolean"))
    copies = balance.copies_of(registry)
    assert (copies.count, copies.offset) == (2, 100_000)
    assert sorted(r.idana for r in copies.positives.collect()) == [7, 8]
    assert copies.positives.columns == KEY
    assert balance.copies_of(registry.withColumn("idana", F.col("idana") + 3_000_000)).offset == 10_000_000
    assert balance.copies_of(registry.limit(0)).count == 0
    with pytest.raises(ValueError, match="copy offset above 5"):
        balance.copies_of(registry, 5)
