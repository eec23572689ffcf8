"""Values: clipping, filling, encoding, binning; metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from rows import day, event, frame, person, tables, values

from vitaline.functions import arrays, bins, dates, encode, hashing, text
from vitaline.operators import metrics, profile, quality, reports


def test_clip_moves_to_the_bound_and_keeps_null(spark):
    rows = [(1, 1, day(0), "AMD004", v) for v in (39.0, 40.0, 41.0, 200.0, 201.0, None)]
    t = tables(spark, labs=[*rows, (1, 1, day(0), "AMD006", 900.0)])
    clipped = sorted(r[0] if r[0] is not None else -1 for r in quality.clip_by_code(t.labs).select("valore").collect())
    assert clipped == [-1, 40.0, 40.0, 41.0, 200.0, 200.0, 900.0]
    assert values(quality.out_of_range_report(t.labs), "code", "n_outside") == [("AMD004", 2)]


def test_override_fill_and_drop_leave_other_rows_alone(spark):
    t = tables(
        spark,
        diagnosi=[event(1, 0, "AMD049", None), event(1, 0, "AMD400", None), event(1, 0, None, "x")],
        instrumental=[event(1, 0, "AMD126", None), event(1, 0, "AMD126", "P"), event(1, 0, "AMD125", None)],
        rx_other=[event(1, 0, "AMD096", None), event(1, 0, "AMD096", "S"), event(1, 0, None, None)],
    )
    overridden = {tuple(r) for r in quality.override_values(t.diagnosi).select("codiceamd", "valore").collect()}
    assert overridden == {("AMD049", "S"), ("AMD400", None), (None, "x")}
    filled = {tuple(r) for r in quality.fill_by_code(t.instrumental).select("codiceamd", "valore").collect()}
    assert filled == {("AMD126", "N"), ("AMD126", "P"), ("AMD125", None)}
    dropped = {tuple(r) for r in quality.drop_null_by_code(t.rx_other).select("codiceamd", "valore").collect()}
    assert dropped == {("AMD096", "S"), (None, None)}


def test_group_mean_is_by_sex(spark):
    labs = [(1, 1, day(0), "AMD001", 170.0), (1, 1, day(1), "AMD001", 180.0), (1, 1, day(2), "AMD001", None),
            (2, 1, day(0), "AMD001", 160.0), (2, 1, day(1), "AMD001", None), (2, 1, day(2), "AMD004", None),
            (1, 1, day(3), "AMD004", 100.0)]
    t = tables(spark, [person(1, sex="M"), person(2, sex="F")], labs=labs)
    filled = quality.fill_group_mean(t.labs, t.registry)
    assert values(filled.filter("codiceamd = 'AMD001'"), "idana", "data", "valore") == [
        (1, day(0), 170.0), (1, day(1), 180.0), (1, day(2), 175.0), (2, day(0), 160.0), (2, day(1), 160.0),
    ]
    everything = quality.fill_group_mean(t.labs, t.registry, same_code_only=False)
    assert values(everything.filter("idana = 1 AND data = '2000-01-03'"), "valore") == [(150.0,)]
    assert everything.filter("codiceamd = 'AMD004' AND valore IS NULL").count() == 1


def test_weighted_fill_draws_known_values_by_frequency(spark):
    known = [event(p, 0, "AMD152", "A") for p in range(300)] + [event(p, 0, "AMD152", "B") for p in range(100)]
    missing = [event(p, 1, "AMD152", None) for p in range(1000)] + [event(1, 2, "AMD152", None)] * 5
    t = tables(spark, rx_other=[*known, *missing, event(1, 3, "AMD086", None)])
    filled = quality.fill_weighted(t.rx_other)
    assert filled.count() == t.rx_other.count()
    assert filled.filter("codiceamd = 'AMD152' AND valore IS NULL").count() == 0
    assert filled.filter("codiceamd = 'AMD086' AND valore IS NULL").count() == 1
    share = filled.filter("data = '2000-01-02' AND valore = 'A'").count() / 1000
    assert abs(share - 0.75) < 0.06
    again = quality.fill_weighted(t.rx_other.repartition(5))
    assert filled.exceptAll(again).count() == 0


def test_weighted_fill_without_known_values_keeps_rows(spark):
    t = tables(spark, rx_other=[event(1, 0, "AMD152", None), event(2, 0, "AMD086", "S")])
    assert quality.fill_weighted(t.rx_other).count() == 2


def test_weighted_fill_covers_every_position(spark):
    """Many rare values: each position of the cumulative counts belongs to exactly one value."""
    known = [event(p, 0, "AMD152", f"v{p % 700}") for p in range(2100)]
    missing = [event(p, 1, "AMD152", None) for p in range(500)]
    t = tables(spark, rx_other=known + missing)
    filled = quality.fill_weighted(t.rx_other, min_buckets=64).filter("data = '2000-01-02'")
    assert filled.count() == 500
    assert filled.filter("valore IS NULL").count() == 0


def test_null_reports(spark):
    t = tables(spark, diagnosi=[event(1, None, "A", None), event(1, 0, "A", None), event(1, 0, None, None)])
    profile_rows = values(reports.null_profile({"d": t.diagnosi}, "raw"), "column", "nulls")
    assert profile_rows == [("codiceamd", 1), ("data", 1), ("idana", 0), ("idcentro", 0), ("valore", 3)]
    assert values(reports.code_null_report(t.diagnosi), "codiceamd", "n_null") == [("A", 2)]


@pytest.mark.parametrize(
    ("age", "label"),
    [(0, None), (1, "0-50"), (50, "0-50"), (51, "51-60"), (100, "91-100"), (120, "101-120"), (121, None), (None, None)],
)
def test_age_bins_are_closed_on_the_right(spark, age, label):
    df = frame(spark, [(age,)], "age int")
    assert df.select(bins.bin_label(F.col("age"), [0, 50, 60, 70, 80, 90, 100, 120],
        ["0-50", "51-60", "61-70", "71-80", "81-90", "91-100", "101-120"])).head()[0] == label


def test_empty_bins_are_shown(spark):
    df = frame(spark, [("A", 10.0), ("A", 30.0), ("A", 900.0)], "codiceamd string, valore double")
    rows = values(profile.histogram_per_code(df), "bin_no", "n_rows")
    assert rows == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]


def test_dead_patients_age_stops(spark):
    t = tables(spark, [person(1, born=1950), person(2, born=1950, died=2000)])
    assert values(profile.with_age(t.registry), "idana", "age") == [(1, 71), (2, 50)]


@pytest.mark.parametrize(
    ("given", "flat", "elapsed"),
    [("N", 0.0, 0), ("P", 1.0, 1), ("S", 2.0, 2), ("3.5", 3.5, None), (" 7 ", 7.0, None), ("1e2", 100.0, None),
     ("3d", None, None), ("x", None, None), ("", None, None), (None, None, None)],
)
def test_value_tokens(spark, given, flat, elapsed):
    df = frame(spark, [(given,)], "v string")
    row = df.select(encode.token_or_number(F.col("v")), encode.token_only(F.col("v"))).head()
    assert tuple(row) == (flat, elapsed)


def test_small_functions(spark):
    df = frame(spark, [(1950.0, "True", "2000-01-02")], "y double, b string, d string")
    row = df.select(
        dates.year_start(F.col("y")).cast("string"),
        encode.label_code(F.col("b")),
        dates.parse_iso(F.col("d")).cast("string"),
        encode.sex_code(F.lit("F")),
        encode.decay(F.lit(0)),
        encode.decay(F.lit(31)),
        text.words_of(F.lit("a=b (c), d's")),
        text.words_of(F.lit(None).cast("string")),
    ).head()
    assert tuple(row)[:5] == ("1950-01-01", 1, "2000-01-02", 1, 1.0)
    assert row[5] == pytest.approx(1 / math.log(math.e + 31))
    assert tuple(row)[6:] == ("a b c ds", "[UNK]")


def test_malformed_date_raises(spark):
    df = frame(spark, [("02/01/2000",)], "d string")
    with pytest.raises(Exception, match="(?i)pars|CANNOT"):
        df.select(dates.parse_iso(F.col("d"))).collect()


def test_arrays(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]],)], "a array<array<float>>")
    pad = F.array(F.lit(-200.0).cast("float"))
    padded = df.select(arrays.left_pad(F.col("a"), 5, pad).alias("p"), arrays.keep_last(F.col("a"), 2).alias("k"))
    row = padded.withColumn("d", arrays.drop_padding(F.col("p"), -200.0)).head()
    assert row.p == [[-200.0], [-200.0], [1.0], [2.0], [3.0]]
    assert row.k == [[2.0], [3.0]]
    assert row.d == [[1.0], [2.0], [3.0]]


def test_hash_uniform_is_even_and_fixed(spark):
    u = hashing.hash_uniform(42, "t", F.col("id"))
    row = spark.range(20000).select(F.avg(u), F.min(u), F.max(u), F.stddev(u)).head()
    assert abs(row[0] - 0.5) < 0.01
    assert 0 <= row[1]
    assert row[2] < 1
    v = hashing.hash_uniform(42, "t", F.col("id"), second=True)
    assert abs(spark.range(20000).select(F.corr(u, v)).head()[0]) < 0.03
    noise = hashing.gaussian_days(u, v, 5.0)
    mean, sd = spark.range(20000).select(F.avg(noise), F.stddev(noise)).head()
    assert abs(mean) < 0.15
    assert 4.5 < sd < 5.2


def test_auc_against_pairs(spark):
    rows = [(i, (i * 37 % 101) / 50, int(i * 13 % 7 < 3)) for i in range(200)]
    df = frame(spark, rows, "id int, score double, truth int")
    pos, neg = [s for _, s, t in rows if t], [s for _, s, t in rows if not t]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(df).head()[0] == pytest.approx(expected)


def test_binary_metrics_clamp_and_threshold(spark):
    df = frame(spark, [(1.7, 1), (-0.4, 0), (0.5, 0), (0.49, 1)], "score double, truth int")
    row = metrics.binary_metrics(df).head()
    assert (row.tp, row.tn, row.fp, row.fn, row.n_correct, row.n_wrong) == (1, 1, 1, 1, 2, 2)
    assert (row.accuracy, row.f1, row.min_score, row.max_score) == (0.5, 0.5, -0.4, 1.7)
    empty = metrics.binary_metrics(df.filter("score > 9")).head()
    assert empty.accuracy is None


def test_auc_of_one_class_is_null(spark):
    df = frame(spark, [(0.1, 1), (0.2, 1)], "score double, truth int")
    assert metrics.auc(df).head()[0] is None
