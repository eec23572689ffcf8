"""Step vectors summed as rows, padding made in one pass, the cohort's first events written once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from rows import event, frame, raw_person, tables, values

from vitaline.operators import sequences
from vitaline.plans import catalog, clean


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def arrays(spark):
    rows = frame(spark, [(1, 1, 0), (1, 1, 1), (2, 1, 0)], "idana long, idcentro int, part int")
    vectors = {(1, 0): [[1.25, -0.05], [0.5, 3.0]], (1, 1): [], (2, 0): [[-200.0, 0.04]]}
    steps = F.lit(None).cast("array<array<float>>")
    for (patient, part), of in vectors.items():
        given = F.array(*[F.array(*[F.lit(x).cast("float") for x in step]) for step in of]).cast("array<array<float>>")
        steps = F.when((F.col("idana") == patient) & (F.col("part") == part), given).otherwise(steps)
    return rows.withColumn("label", F.col("idana") % 2).withColumn("steps", steps)


def test_steps_are_summed_as_rows(arrays):
    told = catalog._described(arrays, 2)
    assert told.columns == ["idana", "idcentro", "part", "label", "n_steps", "n_entries", "total", "in_order"]
    # -0.05 as a float is a little below, so it rounds to -1 tenth; 1.25 is 12.5 tenths and rounds to 13
    assert values(told, "idana", "part", "label", "n_steps", "n_entries", "total", "in_order") == [
        (1, 0, 1, 2, 4, 4.7, (13 - 2) + 2 * (5 + 60)),
        (1, 1, 1, 0, 0, 0.0, 0),
        (2, 0, 0, 1, 2, -199.96, -2000),
    ]
    assert "lambda" not in plan(told)


def test_padding_numbers_the_events_once(spark):
    rows = frame(
        spark, [(1, 1, d, 0, 0, 1, 1.0) for d in range(3)] + [(2, 1, 0, 0, 0, 0, 2.0)],
        "idana long, idcentro int, data int, extra int, codiceamd int, label int, valore double",
    )
    padded = sequences.flat_sequences(rows, pad_to=5, part_steps=2)
    assert "Union" not in plan(padded)
    sizes = padded.select("idana", "part", F.size("steps").alias("n"), F.col("steps")[0][2].alias("first"))
    assert values(sizes, "idana", "part", "n", "first") == [
        (1, 0, 2, -200.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0),
        (2, 0, 2, -200.0), (2, 1, 2, -200.0), (2, 2, 1, 2.0),
    ]


def test_first_events_of_the_cohort_are_written_once(spark):
    raw = tables(
        spark, [raw_person(1), raw_person(2)], raw=True,
        diagnosi=[event(1, 0, "AMD047"), event(1, 400), event(2, 3)],
    )
    cohort = clean.choose_patients(raw).cohort
    assert "Aggregate" not in plan(cohort)
    assert values(cohort, "idana") == [(1,)]
