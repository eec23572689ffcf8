"""Joins, numbering and copies under heavy skew, compared with brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from rows import day, event, frame, tables, values

from vitaline import config
from vitaline.operators import skew, timeline
from vitaline.session import checkpoint_dir, cut

ROWS = "idana long, idcentro int, data date, code string"


def hot_rows(n=1200, seed=3):
    """A third of all rows is one patient, and of these a third one and the same row."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((1, 1, day(0), "A") if i % 9 == 0 else (1, 1, day(rnd.randrange(9)), rnd.choice("ABC")))
        else:
            rows.append((rnd.randrange(2, 40), rnd.randrange(1, 3), day(rnd.randrange(9)), rnd.choice("ABC")))
    return rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_on_key_equals_plain_join(spark, how):
    facts = frame(spark, hot_rows(), ROWS).repartition(5)
    dim = frame(spark, [(k, 1, k * 10) for k in range(0, 30)], "idana long, idcentro int, v long")
    for threshold in ("10485760", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = skew.join_on_key(facts, dim, how=how)
        want = facts.join(dim, config.KEY, how)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0
        assert got.count() == want.count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_small_and_large_agree(spark):
    facts = frame(spark, [(i, None if i % 4 == 0 else f"c{i % 5}") for i in range(60)], "id long, code string")
    dim = frame(spark, [("c1", "one"), ("c2", None), (None, "nothing")], "code string, name string")
    small, large = skew.lookup(facts, dim, ["code"]), skew.lookup(facts, dim, ["code"], max_rows=1)
    assert small.columns == large.columns == ["id", "code", "name"]
    assert small.exceptAll(large).count() == 0
    assert large.exceptAll(small).count() == 0
    assert small.count() == 60
    assert {r.name for r in small.filter("code IS NULL").collect()} == {"nothing"}


def test_lookup_goes_by_bytes(spark):
    wide = frame(spark, [(f"c{i}", "é" * 5000) for i in range(5)], "code string, name string")
    wide = wide.withColumn("more", F.array(F.lit(1), F.lit(None)))
    assert skew.fits_broadcast(wide)
    assert not skew.fits_broadcast(wide, max_bytes=50_000)  # 25,000 characters
    assert skew.fits_broadcast(wide.select("code"), max_bytes=100)
    assert skew.fits_broadcast(wide.limit(0), max_rows=0, max_bytes=0)
    facts = frame(spark, [(i, f"c{i % 7}") for i in range(40)], "id long, code string")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    small, large = skew.lookup(facts, wide, ["code"]), skew.lookup(facts, wide, ["code"], max_bytes=50_000)
    assert "broadcast" in plan(small)
    assert "broadcast" not in plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


@pytest.mark.parametrize("chunk", [3, 4096])
def test_copies_come_back(spark, chunk):
    df = frame(spark, hot_rows(), ROWS)
    collapsed = skew.collapse_copies(df)
    assert collapsed.count() == df.distinct().count()
    expanded = skew.expand_copies(collapsed, chunk=chunk)
    assert expanded.drop("copy").exceptAll(df).count() == 0
    assert expanded.count() == df.count()
    through_counts = skew.expand_copies(collapsed, chunk=chunk, counts=cut(collapsed))
    assert through_counts.exceptAll(expanded).count() == 0
    assert through_counts.count() == expanded.count()
    numbers = expanded.groupBy(*df.columns).agg(F.min("copy"), F.max("copy"), F.count_distinct("copy"), F.count("*"))
    assert numbers.filter("`min(copy)` <> 1 OR `max(copy)` <> `count(1)` OR `count(DISTINCT copy)` <> `count(1)`").count() == 0


def test_number_rows_equals_sorted_positions(spark):
    rows = hot_rows()
    numbered = skew.number_rows(
        skew.collapse_copies(frame(spark, rows, ROWS)),
        config.KEY,
        groups=[F.unix_date("data")],
        ties=["code"],
        weight="n_copies",
        gap="gap",
    )
    expected = {}
    for key in {r[:2] for r in rows}:
        mine = sorted(r for r in rows if r[:2] == key)
        for i, r in enumerate(mine):
            before = mine[i - 1][2] if i else r[2]
            expected.setdefault(r, (i, len(mine), (r[2] - before).days if mine[i - 1 : i] else 0))
    got = {tuple(r[:4]): (r.start, r.total, r.gap) for r in numbered.select(*[c.split()[0] for c in ROWS.split(", ")], "start", "total", "gap").collect()}
    assert got == expected


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_split_parts_share_out_every_copy(spark, size):
    rows = frame(
        spark,
        [("a", 0, 5, 3), ("b", 15, 1, 40), ("c", 55, 9, 2), ("d", 73, 1, 1)],
        "k string, start long, n_copies long, unit long",
    )
    got = []
    for r in skew.split_parts(rows, size, F.col("unit")).collect():
        for c in range(r.from_copy, r.from_copy + r.copies):
            at = r.start + c * r.unit
            assert r.part == at // size
            got.append((r.k, c))
    assert sorted(got) == [("a", i) for i in range(5)] + [("b", 0)] + [("c", i) for i in range(9)] + [("d", 0)]


@pytest.mark.parametrize("small", [True, False])
def test_running_total_small_and_blocked(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(skew, "fits_broadcast", lambda df, max_rows=0: False)
    rows = [(g, i * 7 % 211, i) for i in range(211) for g in ("x", "y")]
    df = frame(spark, rows, "g string, o long, v long")
    got = {(r.g, r.o): r.running for r in skew.running_total(df, ["o"], F.col("v"), ["g"]).collect()}
    for g in ("x", "y"):
        total = 0
        for _, o, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[(g, o)] == total
    numbered = skew.running_total(df.filter("g = 'x'"), ["o"])
    assert values(numbered, "running") == [(i,) for i in range(1, 212)]


def test_numbering_does_not_depend_on_partitioning(spark):
    df = frame(spark, hot_rows(), ROWS)
    args = {"groups": [F.unix_date("data")], "ties": ["code"], "weight": "n_copies"}
    one = skew.number_rows(skew.collapse_copies(df.coalesce(1)), config.KEY, **args)
    many = skew.number_rows(skew.collapse_copies(df.repartition(11)), config.KEY, **args)
    assert one.exceptAll(many).count() == 0


def test_large_groups_are_numbered_in_blocks(spark, monkeypatch):
    """A third of all rows are distinct ones of one group; copies count, and groups at the limit stay whole."""
    rows = [(1, 1, day(0), "A", i * 7 % 4001, 1 + i % 3) for i in range(4001)]
    rows += [(2 + i % 97, 1, day(i % 11), "AB"[i % 2], i, 1) for i in range(8000)] + [(1, 1, day(d), "A", 0, 2) for d in (-1, 1)]
    df = cut(frame(spark, rows, f"{ROWS}, v long, n_copies long").repartition(7))
    args = {"groups": [F.unix_date("data"), F.col("code")], "ties": ["v"], "weight": "n_copies", "gap": "gap"}
    plain = skew.number_rows(df, config.KEY, **args).collect()
    blocks = []

    def watched(table):
        blocks.append(cut(table))
        return blocks[-1]

    monkeypatch.setattr(skew, "cut", watched)
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, *limits: False)
    assert sorted(map(str, skew.number_rows(df, config.KEY, max_group_rows=4000, **args).collect())) == sorted(map(str, plain))
    sizes = [r["count"] for t in blocks if "_block" in t.columns for r in t.groupBy("_block").count().collect()]
    assert sum(sizes) == 4001
    assert len(sizes) > 1
    assert max(sizes) <= 2 * 4001 / len(sizes)
    del blocks[:]
    skew.number_rows(df, config.KEY, max_group_rows=4001, **args).collect()
    assert not any("_block" in t.columns for t in blocks)


def test_rollup_has_one_row_per_patient_day(spark):
    t = tables(spark, diagnosi=[event(1, 0, "AMD047")] * 500 + [event(1, 1)] * 3, rx_other=[event(1, 0)] * 2)
    assert values(timeline.daily_rollup(t), "data", "n_events", "n_target") == [(day(0), 502, 500), (day(1), 3, 0)]


def test_cut_writes_to_the_checkpoint_folder(spark):
    df = cut(spark.range(10).withColumn("s", F.struct("id")))
    assert df.count() == 10
    folder = checkpoint_dir(spark).removeprefix("file:").lstrip("/")
    assert all(folder in f for f in df.inputFiles())
