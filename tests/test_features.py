"""Feature tables, sequences and texts on hand-made rows."""

from __future__ import annotations

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F
from rows import day, event, frame, person, tables, values

from vitaline import config
from vitaline.operators import features, history, sequences
from vitaline.plans import macro_micro, prepare


@pytest.fixture(scope="module")
def bundle(spark):
    return tables(
        spark,
        [person(1, label=True, sex="F"), person(2, died=2005)],
        diagnosi=[event(1, 0, "AMD047"), event(1, 10, "AMD400", "36.1"), event(2, 5, "AMD401", None)],
        labs=[(1, 1, day(0), "AMD004", 120.0), (1, 1, day(0), "AMD004", 120.0), (2, 1, day(4), "AMD005", None)],
        labs_calc=[(1, 1, day(20), None, "STITCH003", 90.5)],
        instrumental=[event(2, 9, "AMD125", "N")],
        rx_drug=[(1, 1, day(20), "A10AB01", 2.0, 1, "drug 1")],
        rx_other=[event(1, 33, "AMD086", "S")],
        rx_nondiab=[event(2, 9, "AMD121", "C1")],
    )


def test_flat_features_encode_and_fill(bundle):
    rows = features.flat_features(bundle)
    assert rows.count() == 11
    assert rows.filter("valore IS NULL OR codiceamd IS NULL OR codicestitch IS NULL").count() == 0
    labs = rows.filter("tipo = 0 AND extra = 0")
    assert values(labs, "idana", "valore", "codicestitch") == [(1, 120.0, 0), (1, 120.0, 0), (2, -100.0, 0)]
    assert values(rows.filter("extra = 6"), "idana", "valore") == [(1, 2.0), (1, 36.1), (2, -100.0)]
    assert values(rows, "sesso")[0] == (0,)
    assert values(rows.filter("idana = 1"), "sesso")[0] == (1,)


def test_first_seen_codes_follow_the_table_order(bundle):
    events = features.event_rows(bundle, config.FEATURE_ORDER, config.FLAT_KIND, config.FLAT_EXTRA)
    codes = features.first_seen_codes(events, ["codiceamd", "tipo"], ["src", "data", *config.KEY])
    amd = [r.value for r in codes.filter("column = 'codiceamd'").orderBy("code").collect()]
    assert amd == ["AMD004", "AMD005", None, "AMD125", "AMD086", "AMD121", "AMD047", "AMD401", "AMD400"]
    assert [r.value for r in codes.filter("column = 'tipo'").orderBy("code").collect()] == [
        "esame", "prescrizione", "diagnosi",
    ]


def test_null_keeps_its_number_but_not_its_code(bundle):
    events = features.event_rows(bundle)
    coded = features.encode_first_seen(events, ["codiceamd"], ["src", "data", *config.KEY], null_code=False)
    got = {r[0] for r in coded.select("codiceamd").distinct().collect()}
    assert got == {0, 1, None, 3, 4, 5, 6, 7, 8}


def test_sorted_codes_put_numbers_before_texts(spark):
    df = frame(spark, [("10", None), (None, 9.0), (None, 10.0), ("A", None), (None, None), ("A", None)], "t string, n double")
    coded = features.encode_sorted(df, "t", "code", number="n")
    assert {(r.t, r.n): r.code for r in coded.collect()} == {
        (None, 9.0): 0, (None, 10.0): 1, ("10", None): 2, ("A", None): 3, (None, None): None,
    }


def test_elapsed_counts_from_the_event_before(bundle):
    rows = features.elapsed_features(bundle).filter("idana = 1").orderBy("step")
    assert [r.days_since_previous for r in rows.collect()] == [0, 0, 0, 10, 10, 0, 13]
    assert [r.delta_events for r in rows.collect()][-1] == pytest.approx(1 / math.log(math.e + 13))
    assert [r.step for r in rows.collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert rows.filter("valore = -1").count() == 5, "numbers and codes other than N, P, S are lost"


def test_elapsed_sequences_are_padded(bundle):
    row = sequences.elapsed_sequences(features.elapsed_rows(features.elapsed_events(bundle)), length=5).filter("idana = 2").head()
    assert [len(row.steps), len(row.elapsed), len(row.labels)] == [5, 5, 5]
    assert row.steps[0] == [-100.0] * len(row.steps[1])
    assert row.elapsed[0] == 0.0
    assert row.elapsed[1:] == pytest.approx([1 / math.log(math.e + d) for d in (0, 1, 4, 0)])
    full = sequences.elapsed_sequences(features.elapsed_rows(features.elapsed_events(bundle)), length=3).filter("idana = 1").head()
    assert full.elapsed == pytest.approx([1 / math.log(math.e + d) for d in (10, 0, 13)])


def history_of(spark, n=20):
    rows = [(1, 1, day(i // 3), i % 3, f"c{i % 2}", "v") for i in range(n)] + [(2, 1, day(0), 0, "c", "v")] * 9
    return frame(spark, rows, "idana long, idcentro int, data date, src int, code string, value string"), rows


@pytest.mark.parametrize(("mode", "left"), [("keep_last", (8, 8)), ("drop_first_k", (12, 1))])
def test_capped_histories(spark, mode, left):
    events, rows = history_of(spark)
    steps = sequences.steps_of(sequences.distinct_events(events), ["src", "code"], 8, mode)
    ours = [tuple(r) for r in steps.filter("idana = 1").orderBy("step").select("data", "src", "code").collect()]
    plain = sorted(r[2:5] for r in rows if r[0] == 1)
    assert ours == (plain[-8:] if mode == "keep_last" else plain[8:])
    assert values(steps.groupBy("idana").count(), "idana", "count") == [(1, left[0]), (2, left[1])]
    assert values(steps.filter("idana = 2"), "step") == [(i,) for i in range(1, left[1] + 1)]


def test_unknown_mode_raises(spark):
    events, _ = history_of(spark)
    with pytest.raises(ValueError, match="mode"):
        sequences.capped(sequences.ordered_history(sequences.distinct_events(events), ["src", "code"]), 3, "middle")


@pytest.mark.parametrize("part_steps", [4, 4096])
def test_arrays_hold_every_step_in_order(spark, part_steps):
    events, rows = history_of(spark)
    ordered = sequences.capped(sequences.ordered_history(sequences.distinct_events(events), ["src", "code"]))
    arrays = sequences.as_arrays(ordered, {"src": F.col("src")}, carry=(), part_steps=part_steps)
    whole = {}
    for r in arrays.orderBy("idana", "part").collect():
        assert len(r.src) <= part_steps
        whole.setdefault(r.idana, []).extend(r.src)
    assert whole[1] == [r[3] for r in sorted(r for r in rows if r[0] == 1)]
    assert whole[2] == [0] * 9


@pytest.mark.parametrize(("longest", "cap"), [(1, 2), (2, 2), (3, 2), (4, 2), (5, 4), (8, 4), (9, 8), (513, 512), (2**40 + 1, 2**40)])
def test_power_cap(spark, longest, cap):
    lengths = frame(spark, [(longest,)], "history_len long")
    assert sequences.sequence_cap(lengths).head().cap == cap


def test_batches_are_equal_runs(spark):
    patients = frame(spark, [(p, c) for p in range(10) for c in (1, 2)], "idana long, idcentro int")
    batches = values(sequences.batch_ids(patients, 3), "idana", "idcentro", "batch_id")
    assert [b for _, _, b in batches] == [0] * 7 + [1] * 7 + [2] * 6


def test_age_fractions(bundle):
    aged = features.age_fraction(bundle)
    longest = (config.AS_OF - dt.date(1950, 1, 1)).days * 1.05
    rows = {r.idana: r for r in aged.registry.collect()}
    assert rows[1].delta_decesso is None
    assert rows[2].delta_decesso == pytest.approx(20089 / longest)
    assert "annodecesso" not in aged.registry.columns
    born = (day(33) - dt.date(1950, 1, 1)).days
    assert aged.rx_other.head().delta_data == pytest.approx(born / longest)


def test_macro_micro(bundle):
    rows = features.macro_micro_features(bundle)
    assert rows.count() == 10, "one table is left out"
    assert rows.filter("data = -100").count() == 7
    assert rows.filter("annodecesso <> -100").select("idana").distinct().collect()[0][0] == 2
    per_patient = [(r.idana, r.data) for r in rows.collect()]
    assert per_patient == sorted(per_patient)
    events = features.macro_micro_events(bundle)
    assert events.filter("is_macro AND data IS NULL OR NOT is_macro AND data IS NOT NULL").count() == 0


def test_macro_micro_splits(bundle):
    parts = macro_micro.split_features(bundle)
    assert set(parts) == {"test", "train"}
    assert sum(df.count() for df in parts.values()) == 10


@pytest.fixture(scope="module")
def codes(spark):
    amd = frame(spark, [("AMD047", "Infarction (acute), 'x' = y")], "codiceamd string, meaning string")
    atc = frame(spark, [("A10AB01", "insulin")], "codiceatc string, atc_nome string")
    return amd, atc


def test_history_text_reads_like_the_record(bundle, codes):
    rows = {r.idana: r for r in history.history_text(bundle, *codes).collect()}
    assert rows[1].text == (
        "patientregistry idcenter 1 sex F yeardiagnosisdiabetes 1991-01-01 levelofeducation [UNK] "
        "maritalstatus 1.0 profession [UNK] yearofbirth 1950-01-01 yearfirstaccess 1990-01-01 yearofdeath [UNK] "
        "diagnosis date 2000-01-11 amdcode AMD400 meaning [UNK] value 36.1 "
        "date 2000-01-01 amdcode AMD047 meaning Infarction acute x   y value S "
        "exam parameter date 2000-01-01 amdcode AMD004 meaning [UNK] value 120.0 "
        "date 2000-01-01 amdcode AMD004 meaning [UNK] value 120.0 "
        "exam parameter calculated date 2000-01-21 amdcode [UNK] stitchcode STITCH003 meaning [UNK] value 90.5 "
        "exam strumental prescription diabete drugs date 2000-01-21 atccode A10AB01 meaning insulin quantity 2.0 "
        "idmeal 1 drugdescription drug 1 prescription diabete not drugs "
        "date 2000-02-03 amdcode AMD086 meaning [UNK] value S prescription not diabete"
    )
    assert (rows[1].part, rows[1].label, rows[2].label) == (0, 1, 0)
    assert rows[2].text.endswith("prescription not diabete date 2000-01-10 amdcode AMD121 meaning [UNK] value C1")


@pytest.fixture(scope="module")
def whole(bundle, codes):
    return {r.idana: r.text for r in history.history_text(bundle, *codes).collect()}


@pytest.mark.parametrize("part_words", [1, 7])
def test_parts_join_to_the_whole_text(bundle, codes, whole, part_words):
    parts = history.history_text(bundle, *codes, part_words=part_words).orderBy("idana", "part").collect()
    joined = {}
    for r in parts:
        joined.setdefault(r.idana, []).append(r.text)
    assert {k: " ".join(v) for k, v in joined.items()} == whole


@pytest.mark.parametrize("max_words", [1, 40, 57])
def test_max_words_keeps_the_head(bundle, codes, whole, max_words):
    heads = {r.idana: r.text for r in history.history_text(bundle, *codes, max_words=max_words).collect()}
    assert heads == {k: " ".join(v.split(" ")[:max_words]) for k, v in whole.items()}


def test_longest_texts_prefer_the_earlier(spark):
    df = frame(spark, [(0, "a b"), (1, "a b c"), (2, "x y z"), (3, "a")], "position long, text string")
    assert [r.position for r in history.longest_texts(df, 3).collect()] == [1, 2, 0]


def test_plans_give_one_row_per_patient(bundle, codes):
    flat = prepare.sequence_inputs(bundle)
    assert values(flat, "idana") == [(1,), (2,)]
    assert {len(r.steps) for r in flat.collect()} == {4}, "cap of the longest history, 7, is 4"
    aged = prepare.age_fraction_inputs(bundle)
    assert values(aged, "idana") == [(1,), (2,)]
    assert prepare.elapsed_inputs(bundle).count() == 2
    assert prepare.text_inputs(bundle, *codes, max_words=5).count() == 2


@pytest.mark.parametrize("part_steps", [1, 3, 4, 4096])
def test_padding_goes_by_place_over_parts(bundle, part_steps):
    rows = features.flat_features(bundle)
    whole = {r.idana: r.steps for r in sequences.flat_sequences(rows).collect()}
    joined = {}
    for r in sequences.flat_sequences(rows, pad_to=9, part_steps=part_steps).orderBy("idana", "part").collect():
        parts = joined.setdefault(r.idana, [])
        assert r.part * part_steps == len(parts)
        assert len(r.steps) == min(part_steps, 9 - len(parts))
        parts += r.steps
    width = len(whole[1][0])
    assert joined == {i: [[-200.0] * width] * (9 - len(steps)) + steps for i, steps in whole.items()}
