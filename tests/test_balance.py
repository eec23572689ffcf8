"""Sampling, copies and splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from rows import day, event, frame, person, tables, values

from vitaline import config
from vitaline.operators import balance


@pytest.fixture(scope="module")
def bundle(spark):
    people = [person(p, label=p % 5 == 0) for p in range(1, 101)]
    events = [event(p, d) for p in range(1, 101) for d in range(10)] + [event(5, 3, "AMD047")] * 40
    return tables(spark, people, diagnosi=events)


def test_class_sizes(bundle):
    assert tuple(balance.class_sizes(bundle.registry).head()) == (80, 20, 4)


def test_oversample_reaches_the_ratio(bundle):
    grown = balance.oversample_registry(bundle.registry)
    assert values(grown.groupBy("label").count(), "label", "count") == [(False, 80), (True, 80)]
    copies = grown.filter("idana < 0")
    assert values(copies.filter("idana IN (-100005, -200005, -300005)"), "idana") == [(-300005,), (-200005,), (-100005,)]
    assert copies.count() == 60


def test_no_copies_below_ratio_two(spark):
    t = tables(spark, [person(p, label=p % 2 == 0) for p in range(10)], diagnosi=[event(2, 0)])
    assert balance.oversample_registry(t.registry).count() == 10
    assert balance.synthetic_events(t.diagnosi, t.registry, "diagnosi").count() == 0


def test_no_positives_means_no_copies(spark):
    t = tables(spark, [person(p) for p in range(4)], diagnosi=[event(2, 0)])
    assert balance.oversample_registry(t.registry).count() == 4


def test_synthetic_events_keep_half_and_move_dates(bundle):
    made = balance.synthetic_events(bundle.diagnosi, bundle.registry, "diagnosi")
    source = bundle.diagnosi.join(bundle.registry.filter("label"), config.KEY, "left_semi").count() * 3
    assert abs(made.count() / source - 0.5) < 0.08
    assert made.filter("idana >= 0").count() == 0
    hot = made.filter("idana = -100005 AND codiceamd = 'AMD047'")
    assert 8 <= hot.count() <= 32, "equal rows are drawn one by one"
    assert hot.select("data").distinct().count() > 3


def test_synthetic_events_do_not_depend_on_partitioning(bundle):
    a = balance.synthetic_events(bundle.diagnosi.coalesce(1), bundle.registry, "diagnosi")
    b = balance.synthetic_events(bundle.diagnosi.repartition(9), bundle.registry.repartition(3), "diagnosi")
    assert a.exceptAll(b).count() == 0
    assert a.count() == b.count()
    other = balance.synthetic_events(bundle.diagnosi, bundle.registry, "diagnosi", seed=7)
    assert a.exceptAll(other).count() > 0


def test_exact_keeps_the_rounded_half(bundle):
    source = bundle.diagnosi.join(bundle.registry.filter("label"), config.KEY, "left_semi").count() * 3
    made = balance.synthetic_events(bundle.diagnosi, bundle.registry, "diagnosi", exact=True)
    assert made.count() == round(source * 0.5)


def test_undersample_levels_the_classes(bundle):
    cut = balance.undersample(bundle)
    assert values(cut.registry.groupBy("label").count(), "label", "count") == [(False, 20), (True, 20)]
    left = {r[0] for r in cut.diagnosi.select("idana").distinct().collect()}
    assert left == {r[0] for r in cut.registry.select("idana").collect()}


def test_large_ids_keep_all_copies_apart(spark):
    people = [person(p, label=p in (50_000, 150_000)) for p in range(49_998, 50_002)]
    people += [person(p, label=p == 150_000) for p in range(149_997, 150_002)]
    t = tables(spark, people, diagnosi=[event(50_000, 0), event(150_000, 1)])
    grown = balance.oversample_registry(t.registry)
    assert grown.count() == grown.select(*config.KEY).distinct().count() == 9 + 2 * 2
    assert grown.filter("idana = -1050000 OR idana = -1150000").count() == 2
    made = balance.synthetic_events(t.diagnosi, t.registry, "diagnosi", keep=1.0)
    assert made.join(grown, config.KEY, "left_semi").count() == made.count() == 4


def test_a_given_offset_must_exceed_ids(spark):
    t = tables(spark, [person(100000)])
    for made in (balance.oversample_registry, lambda r, offset: balance.synthetic_events(t.diagnosi, r, "diagnosi", offset=offset)):
        with pytest.raises(ValueError, match="offset"):
            made(t.registry, offset=100000)


def test_splits_are_disjoint_and_of_the_right_size(spark):
    registry = spark.range(20000).select(F.col("id").alias("idana"), F.lit(1).alias("idcentro"))
    split = balance.split_patients(registry)
    sizes = {r[0]: r[1] / 20000 for r in split.groupBy("split").count().collect()}
    assert sizes == pytest.approx({"train": 0.6, "test": 0.3, "val": 0.1}, abs=0.02)
    again = balance.split_patients(registry.repartition(7))
    assert split.exceptAll(again).count() == 0
    test = split.filter("split = 'test'")
    assert balance.complement(split, test).filter("split = 'test'").count() == 0
    assert balance.complement(split, test).count() + test.count() == 20000


def test_jitter_is_in_days(bundle):
    made = balance.synthetic_events(bundle.diagnosi, bundle.registry, "diagnosi", keep=1.0)
    low, high = made.agg(F.min("data"), F.max("data")).head()
    assert low >= day(-40)
    assert high <= day(60)
