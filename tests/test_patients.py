"""Cohort, dates, spans, label and leakage on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from rows import day, event, person, raw_person, tables, values

from vitaline.operators import cohort, label, leakage, repair, timeline
from vitaline.plans import clean


def test_cohort_keeps_patient_and_centre_apart(spark):
    t = tables(
        spark,
        [person(1), person(1, centre=2), person(2)],
        diagnosi=[event(1, 0, "AMD047"), event(1, 5, centre=2), event(2, 1), event(2, None, "AMD303")],
        labs=[(1, 1, day(1), "AMD004", 1.0), (1, 2, day(1), "AMD004", 2.0)],
    )
    kept = cohort.cohort_by_codes(t)
    assert values(kept.registry, "idana", "idcentro") == [(1, 1), (2, 1)]
    assert values(kept.labs, "idana", "idcentro", "valore") == [(1, 1, 1.0)]
    assert kept.diagnosi.count() == 3


def test_key_overlap_counts_distinct_keys(spark):
    t = tables(spark, [person(1), person(2)], diagnosi=[event(1, 0), event(1, 1), event(3, 0)])
    assert cohort.key_overlap(t.registry, t.diagnosi).head()[0] == 1


@pytest.mark.parametrize(("days", "kept"), [(31, False), (32, True)])
def test_span_must_exceed_limit(spark, days, kept):
    t = tables(spark, diagnosi=[event(1, 0), event(1, days)])
    keys = timeline.history_longer_than(timeline.event_timeline(t), 31)
    assert bool(values(keys, "idana")) is kept


def test_undated_events_are_no_part_of_the_timeline(spark):
    t = tables(spark, diagnosi=[event(1, None), event(1, 3)], rx_nondiab=[event(1, 9)])
    assert values(timeline.event_timeline(t), "data") == [(day(3),), (day(9),)]
    assert values(timeline.event_timeline(t, with_rx=False), "data") == [(day(3),)]


@pytest.mark.parametrize(("gap", "expected"), [(186, True), (187, False)])
def test_label_window(spark, gap, expected):
    t = tables(spark, [person(1)], diagnosi=[event(1, 0), event(1, 500, "AMD047"), event(1, 500 + gap)])
    labelled = label.label_recent_event(t.registry.drop("label"), timeline.event_timeline(t), t.diagnosi)
    assert values(labelled, "idana", "label") == [(1, expected)]


@pytest.mark.parametrize(("days", "kept"), [(186, 0), (187, 1)])
def test_label_needs_a_trajectory(spark, days, kept):
    t = tables(spark, [person(1)], diagnosi=[event(1, 0, "AMD047"), event(1, days)])
    labelled = label.label_recent_event(t.registry.drop("label"), timeline.event_timeline(t), t.diagnosi)
    assert labelled.count() == kept


def test_first_access_is_filled_only_inside_the_life(spark):
    t = tables(
        spark,
        [
            raw_person(1, access=None),
            raw_person(2, access=None, born=2000.0),  # first event on the birth date itself
            raw_person(3, access=None, died=2000.0),  # first event on the date of death
            raw_person(4, access=None),  # no event
            raw_person(5),
        ],
        raw=True,
        diagnosi=[event(p, 0) for p in (1, 2, 3, 5)] + [event(1, 40)],
    )
    filled = repair.fill_first_access(
        repair.type_registry_years(t.registry), timeline.first_event(timeline.event_timeline(t))
    )
    assert values(filled, "idana", "annoprimoaccesso") == [(1, day(0)), (5, dt.date(1990, 1, 1))]


def test_inconsistent_registry_goes_and_missing_diagnosis_is_filled(spark):
    t = tables(
        spark,
        [
            raw_person(1, diagnosed=None),
            raw_person(2, died=1989.0),
            raw_person(3, died=1990.0),  # diagnosed 1991
            raw_person(4, died=1991.0),
        ],
        raw=True,
    )
    repaired = repair.repair_registry_dates(t.registry, timeline.event_timeline(t))
    assert values(repaired, "idana", "annodiagnosidiabete") == [
        (1, dt.date(1990, 1, 1)),
        (4, dt.date(1991, 1, 1)),
    ]


def test_plausible_events_compare_years(spark):
    t = tables(
        spark,
        [person(1, born=2000, died=2001)],
        diagnosi=[event(1, dt.date(y, m, 1)) for y, m in ((1999, 12), (2000, 1), (2001, 12), (2002, 1))]
        + [event(1, None), event(9, 0)],
    )
    kept = repair.plausible_events(t.diagnosi, t.registry)
    assert values(kept, "data") == [(dt.date(2000, 1, 1),), (dt.date(2001, 12, 1),)]


@pytest.mark.parametrize(("gap", "kept"), [(182, False), (183, True)])
def test_negatives_lose_their_last_days(spark, gap, kept):
    t = tables(spark, [person(1)], diagnosi=[event(1, 0), event(1, 1000 - gap), event(1, 1000)])
    lasts = leakage.last_event_by_label(t.registry, timeline.event_timeline(t))
    left = leakage.truncate_negative_history(t, lasts).diagnosi
    assert values(left, "data") == [(day(0),), *([(day(1000 - gap),)] if kept else [])]


@pytest.mark.parametrize(("gap", "kept"), [(186, False), (187, True)])
def test_positives_lose_target_diagnoses_only(spark, gap, kept):
    t = tables(
        spark,
        [person(1, label=True)],
        diagnosi=[event(1, 1000 - gap, "AMD047"), event(1, 999, "AMD400"), event(1, 1000, "AMD400")],
    )
    safe = leakage.remove_leakage(t, timeline.event_timeline(t)).diagnosi
    assert values(safe, "codiceamd") == [*([("AMD047",)] if kept else []), ("AMD400",), ("AMD400",)][
        0 : 3 if kept else 2
    ]


def test_patients_without_label_keep_everything(spark):
    t = tables(spark, [person(1)], diagnosi=[event(1, 0), event(7, 0, "AMD047"), event(7, None, "AMD047")])
    lasts = leakage.last_event_by_label(t.registry, timeline.event_timeline(t))
    assert leakage.truncate_negative(t.diagnosi, lasts).filter("idana = 7").count() == 2
    assert leakage.strip_positive_recent_codes(t.diagnosi, lasts).filter("idana = 7").count() == 2


def test_rollup_chain_equals_the_single_steps(spark):
    """Patients chosen on the daily rollup are those the table-by-table operators choose."""
    from vitaline.plans import stages

    raw = stages.raw(spark, "/root/testdata/sf0.001")
    chosen = clean.choose_patients(raw)
    t = cohort.cohort_by_codes(raw)
    t = t.replace(diagnosi=t.diagnosi.filter("data is not null"))
    registry = repair.repair_registry_dates(t.registry, timeline.event_timeline(t))
    t = t.map_events(lambda df: repair.plausible_events(df, registry)).replace(registry=registry)
    t = timeline.filter_by_history_span(t, timeline.event_timeline(t))
    labelled = label.label_recent_event(t.registry, timeline.event_timeline(t), t.diagnosi)
    assert values(labelled, "idana", "label") == values(chosen.labelled, "idana", "label")
