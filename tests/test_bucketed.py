"""Tables in buckets of patients: no exchange later, patients with very many rows apart."""

from __future__ import annotations

import pytest
from rows import event, person, tables

from vitaline.config import KEY
from vitaline.operators import repair, timeline
from vitaline.sources.bucketed import hot_patients, write_bucketed


@pytest.fixture
def bundle(spark):
    """Forty patients with three diagnoses each, one with a third of all rows, and an event of nobody."""
    events = [event(i, n) for i in range(40) for n in (0, 40, 400)] + [event(99, 5)]
    events += [event(7, n % 300) for n in range(60)]
    return tables(spark, [person(i) for i in range(40)], diagnosi=events)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_patients_larger_than_a_bucket_are_kept_apart(spark, bundle):
    assert [tuple(r) for r in hot_patients(bundle, 4).collect()] == [(7, 1)]
    kept = write_bucketed(bundle, 4)
    assert (kept.hot.diagnosi.count(), kept.hot.registry.count()) == (63, 1)
    assert (kept.spread.diagnosi.count(), kept.spread.registry.count()) == (118, 39)
    for buckets in (1, 4, 8):
        assert hot_patients(bundle, buckets).count() <= 7 * buckets


def test_joins_and_groupings_by_patient_move_nothing(spark, bundle):
    kept = write_bucketed(bundle, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = repair.plausible_events(kept.spread.diagnosi, kept.spread.registry)
        assert "SortMergeJoin" in plan(joined)
        assert "Exchange" not in plan(joined)
        stats = timeline.first_last(timeline.event_timeline(kept.spread))
        assert "Exchange" not in plan(stats)
        assert "Exchange" in plan(timeline.first_last(timeline.event_timeline(bundle)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_both_parts_give_the_results_of_the_whole(spark, bundle):
    for buckets in (1, 4, 64):
        kept = write_bucketed(bundle, buckets)
        found = kept.per_patient(lambda t: repair.plausible_events(t.diagnosi, t.registry))
        assert rows(found) == rows(repair.plausible_events(bundle.diagnosi, bundle.registry).select(*found.columns))
        stats = kept.per_patient(lambda t: timeline.first_last(timeline.event_timeline(t)))
        assert rows(stats) == rows(timeline.first_last(timeline.event_timeline(bundle)).select(*stats.columns))


def test_empty_tables(spark, bundle):
    nothing = bundle.map_events(lambda df: df.limit(0)).replace(registry=bundle.registry.limit(0))
    kept = write_bucketed(nothing, 2)
    assert kept.per_patient(lambda t: t.registry.select(*KEY)).count() == 0
