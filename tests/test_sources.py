"""Reading and writing stages, in both formats."""

from __future__ import annotations

import datetime as dt

import pytest
from rows import day, event, person, tables, values

from vitaline import schemas
from vitaline.operators import balance
from vitaline.plans import clean, prepare
from vitaline.sources import tables as source


def test_raw_csv_drops_the_index_and_reads_missing_texts(spark, tmp_path):
    path = tmp_path / "diagnosi.csv"
    path.write_text(",idana,idcentro,data,codiceamd,valore\n0,7,1,2001-02-03,AMD047,S\n1,8,2,NA,AMD048,nan\n2,9,3,,null,\n")
    df = source.read_csv(spark, str(path), schemas.RAW["diagnosi"], row_index=True)
    assert sorted((tuple(r) for r in df.collect()), key=str) == [
        (7, 1, dt.date(2001, 2, 3), "AMD047", "S"),
        (8, 2, None, "AMD048", None),
        (9, 3, None, None, None),
    ]


def test_integers_written_as_floats(spark, tmp_path):
    path = tmp_path / "rx.csv"
    path.write_text(
        "idana,idcentro,data,codiceatc,quantita,idpasto,descrizionefarmaco\n7,1,2001-02-03,A10,2.5,3.0,x\n"
    )
    assert source.read_csv(spark, str(path), schemas.RAW["rx_drug"]).head().idpasto == 3


def test_malformed_number_fails(spark, tmp_path):
    path = tmp_path / "labs.csv"
    path.write_text("idana,idcentro,data,codiceamd,valore\n7,1,2001-02-03,A,abc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        source.read_csv(spark, str(path), schemas.RAW["labs"]).collect()


def test_paths():
    assert source.table_path("/r", "raw", "labs") == "/r/data/esamilaboratorioparametri"
    assert source.table_path("/r", "clean", "registry") == "/r/clean_data/anagraficapazientiattivi_c_pres"
    assert source.table_path("/r", "balanced", "rx_drug", False) == "/r/balanced_data/prescrizionidiabetefarmaci_b"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_stage_comes_back_as_written(spark, tmp_path, fmt):
    t = tables(
        spark,
        [person(1, label=True), person(2, died=2003)],
        diagnosi=[event(1, 0), event(1, 3, "AMD049", None)],
        labs=[(1, 1, day(1), "AMD004", 3.5), (2, 1, day(2), "AMD004", None)],
        rx_drug=[(1, 1, day(2), None, 1.0, 2, "Altro")],
    )
    source.write_tables(t, str(tmp_path), "clean", fmt=fmt)
    back = source.read_tables(spark, str(tmp_path), "clean", fmt=fmt)
    for (name, written), (_, read) in zip(t.items(), back.items(), strict=True):
        assert read.schema.names == written.schema.names, name
        assert read.exceptAll(written).count() == 0, name
        assert read.count() == written.count(), name


def test_features_and_texts_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id long, v double")
    source.write_features(df, str(tmp_path), "flat")
    assert values(source.read_features(spark, str(tmp_path), "flat"), "id", "v") == [(1, -100.0), (2, 3.0)]
    texts = spark.createDataFrame([(7, 1, 0, "a b", 1), (7, 1, 1, "c", 1)], "idana long, idcentro long, part int, text string, label int")
    source.write_texts(texts, str(tmp_path))
    records = source.text_records(source.read_texts(spark, str(tmp_path)))
    assert values(records, "idana", "part", "label", "text") == [(7, 0, 1, "a b"), (7, 1, 1, "c")]


ODD = ['say "hi", ok', " padded ", "two\nlines", "back\\slash", "a,b", "'", '"', "plain"]


def test_any_text_comes_back_from_csv(spark, tmp_path):
    kind = "codice string, meaning string"
    df = spark.createDataFrame([(f"C{i}", t) for i, t in enumerate(ODD)], kind)
    source.write_frame(df, str(tmp_path / "codes.csv"), "csv")
    back = source.read_csv(spark, str(tmp_path / "codes.csv"), df.schema)
    assert values(back, "codice", "meaning") == values(df, "codice", "meaning")


def test_doubled_quotes_of_other_tools(spark, tmp_path):
    (tmp_path / "amd.csv").write_text('codice,meaning\nA,"say ""hi"", ok"\nB,"x\ny"\n')
    assert values(source.read_amd_codes(spark, str(tmp_path / "amd.csv")), "codiceamd", "meaning") == [
        ("A", 'say "hi", ok'),
        ("B", "x\ny"),
    ]


def test_reordered_columns_are_refused(spark, tmp_path):
    path = tmp_path / "diagnosi.csv"
    path.write_text(",idcentro,idana,data,codiceamd,valore\n0,1,7,2001-02-03,AMD047,S\n")
    with pytest.raises(ValueError, match="idcentro"):
        source.read_csv(spark, str(path), schemas.RAW["diagnosi"], row_index=True)


def test_code_tables(spark, tmp_path):
    (tmp_path / "amd.csv").write_text('codice,meaning\nAMD001,"Height, standing"\n')
    (tmp_path / "atc.csv").write_text(
        "codiceatc,first,last,len,numpatients,numdates,atc_nome\nA10,2001-01-01,2002-01-01,3,4,5,\n"
    )
    assert values(source.read_amd_codes(spark, str(tmp_path / "amd.csv")), "codiceamd", "meaning") == [
        ("AMD001", "Height, standing")
    ]
    assert source.read_atc_codes(spark, str(tmp_path / "atc.csv")).collect()[0][:] == ("A10", None)


def test_raw_to_balanced_through_files(spark, tmp_path):
    """The whole flow with every stage on disk."""
    from vitaline.plans import stages

    raw = stages.raw(spark, "/root/testdata/sf0.001")
    cleaned = clean.clean_and_label(raw)
    source.write_tables(cleaned, str(tmp_path), "clean")
    kept = source.read_tables(spark, str(tmp_path), "clean")
    sizes = balance.class_sizes(kept.registry).head()
    assert (sizes.n_negative, sizes.n_positive) == (43, 7)
    grown = prepare.balanced_tables(kept)
    source.write_tables(grown, str(tmp_path), "balanced")
    assert source.read_tables(spark, str(tmp_path), "balanced").registry.count() == 43 + 7 * 6
    lossy = prepare.balanced_tables(kept, balancing="lossy")
    assert lossy.registry.count() == 14
    with pytest.raises(ValueError, match="balancing"):
        prepare.balanced_tables(kept, balancing="none")
