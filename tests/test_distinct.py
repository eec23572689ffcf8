"""Distinct patients from kept bitmaps."""

from __future__ import annotations

from rows import event, person, tables

from vitaline.operators import distinct


def test_counts_merge_over_codes_tables_and_blocks(spark):
    """More patients than a block of a bitmap holds, repeated events, patients of no registry."""
    n = 70_000
    few = tables(spark, [person(1)], diagnosi=[event(1, 0), event(1, 0), event(2, 3, "AMD049"), event(n + 5, 1, None)])
    many = spark.range(n).selectExpr(
        "id AS idana", "1 AS idcentro", "date'2001-01-01' AS data", "if(id % 2 = 0, 'A', 'B') AS codiceamd", "'x' AS valore"
    )
    bundle = few.replace(rx_other=many.unionAll(many.limit(500)))
    numbers = distinct.patient_numbers(bundle)
    assert numbers.agg({"patient": "max"}).first()[0] == numbers.count() - 1 == n
    kept = distinct.patient_bitmaps(bundle.events(), numbers)
    assert {(r.table, r.code): r.n_patients for r in distinct.distinct_patients(kept, ["table", "code"]).collect()} == {
        ("diagnosi", "AMD400"): 1,
        ("diagnosi", "AMD049"): 1,
        ("rx_other", "A"): n // 2,
        ("rx_other", "B"): n // 2,
    }
    assert {r.table: r.n_patients for r in distinct.distinct_patients(kept, ["table"]).collect()} == {"diagnosi": 2, "rx_other": n}
    assert distinct.distinct_patients(kept, []).first().n_patients == n
    assert kept.where("code = 'A'").count() == 3


def test_nothing_to_count(spark):
    empty = tables(spark, [])
    kept = distinct.patient_bitmaps(empty.events(), distinct.patient_numbers(empty))
    assert distinct.distinct_patients(kept, ["code"]).count() == 0
