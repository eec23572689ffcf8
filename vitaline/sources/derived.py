"""Clinical tables derived from the sales tables customer, orders and lineitem.

The select statements are plain SQL that other engines run unchanged once the table names are filled
in, so a result can be compared across engines. Nothing is invented: one patient per customer, one
diagnosis per order, one exam or prescription per order line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitaline.sources.tables import Tables

SOURCES = ("customer", "orders", "lineitem")

# Two groups of patients get short histories, so that the history filters have something to drop.
_EVENT_DATE = (
    "CASE WHEN c_custkey % 17 = 0 THEN DATE '1998-01-01' + CAST(o_orderkey % 25 AS INT) "
    "WHEN c_custkey % 19 = 0 THEN DATE '1998-01-01' + CAST(o_orderkey % 150 AS INT) "
    "ELSE CAST({date} AS DATE) END"
)
_SHIP_DATE = _EVENT_DATE.format(date="l_shipdate")
_LINES = (
    "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey "
)

REGISTRY = """
SELECT c_custkey AS idana, c_nationkey AS idcentro,
 CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS sesso,
 CASE WHEN c_custkey % 23 = 0 THEN 1997 ELSE 1920 + c_custkey % 71 END AS annonascita,
 CASE WHEN c_custkey % 9 = 0 THEN 1997 + c_custkey % 5 END AS annodecesso,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1991 + c_custkey % 8 END AS annoprimoaccesso,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 1985 + c_custkey % 17 END AS annodiagnosidiabete,
 CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 END AS scolarita,
 CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 END AS statocivile,
 CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 8 END AS professione,
 CASE WHEN c_custkey % 100 = 0 THEN 1 END AS origine, 5 AS tipodiabete
FROM {customer}
"""

DIAGNOSI = (
    "SELECT c_custkey AS idana, c_nationkey AS idcentro, "
    "CASE WHEN o_orderkey % 199 = 0 THEN NULL ELSE " + _EVENT_DATE.format(date="o_orderdate") + " END AS data, "
    "CASE WHEN c_custkey % 10 < 4 AND o_orderkey % 40 < 8 THEN (CASE o_orderkey % 40 WHEN 0 THEN 'AMD047' "
    "WHEN 1 THEN 'AMD048' WHEN 2 THEN 'AMD049' WHEN 3 THEN 'AMD071' WHEN 4 THEN 'AMD081' "
    "WHEN 5 THEN 'AMD082' WHEN 6 THEN 'AMD208' ELSE 'AMD303' END) "
    "ELSE CONCAT('AMD', CAST(400 + o_orderkey % 40 AS VARCHAR(3))) END AS codiceamd, "
    "CASE WHEN o_orderkey % 40 IN (2, 4) THEN (CASE WHEN o_orderkey % 3 = 0 THEN '36.1' ELSE 'S' END) "
    "WHEN o_orderkey % 40 = 7 THEN '433.01' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'S' END AS valore "
    "FROM {orders} JOIN {customer} ON o_custkey = c_custkey"
)

LABS = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE l_linenumber WHEN 1 THEN 'AMD001' WHEN 2 THEN 'AMD004' WHEN 3 THEN 'AMD005' WHEN 4 THEN 'AMD007' "
    "WHEN 5 THEN 'AMD008' ELSE 'AMD009' END AS codiceamd, "
    "CASE WHEN l_linenumber IN (1, 6) AND l_orderkey % 11 = 0 THEN NULL "
    "WHEN l_linenumber = 5 THEN l_quantity / 2 WHEN l_linenumber = 4 THEN l_quantity * 12 "
    f"ELSE l_quantity * 5 END AS valore {_LINES}WHERE l_returnflag = 'A'"
)

LABS_CALC = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE l_linenumber WHEN 1 THEN 'AMD927' WHEN 2 THEN 'AMD013' WHEN 5 THEN 'AMD304' END AS codiceamd, "
    "CONCAT('STITCH00', CAST(CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE 3 END AS VARCHAR(1))) "
    f"AS codicestitch, l_quantity * 8 AS valore {_LINES}WHERE l_returnflag = 'R' AND l_linestatus = 'F'"
)

INSTRUMENTAL = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE WHEN l_linenumber <= 2 THEN 'AMD125' WHEN l_linenumber <= 4 THEN 'AMD126' ELSE 'AMD040' END "
    "AS codiceamd, CASE WHEN l_linenumber <= 2 AND l_orderkey % 2 = 0 THEN NULL "
    "WHEN l_linenumber <= 4 AND l_orderkey % 29 = 0 THEN NULL "
    "WHEN l_orderkey % 3 = 0 THEN 'P' ELSE 'N' END AS valore "
    f"{_LINES}WHERE l_returnflag = 'R' AND l_linestatus <> 'F'"
)

RX_DRUG = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE WHEN l_orderkey % 301 = 0 THEN NULL WHEN l_linenumber = 1 THEN 'A10AB01' "
    "WHEN l_linenumber = 2 THEN 'A10AB04' ELSE 'A10AB05' END AS codiceatc, l_quantity AS quantita, "
    "l_linenumber AS idpasto, CASE WHEN l_orderkey % 301 = 0 THEN 'Altro' "
    "ELSE CONCAT('drug ', CAST(l_linenumber AS VARCHAR(1))) END AS descrizionefarmaco "
    f"{_LINES}WHERE l_returnflag = 'N' AND l_linenumber <= 3"
)

RX_OTHER = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE WHEN l_orderkey % 151 = 0 THEN 'AMD096' WHEN l_linenumber = 4 THEN 'AMD152' ELSE 'AMD086' END "
    "AS codiceamd, CASE WHEN l_orderkey % 151 = 0 AND l_linenumber = 4 THEN NULL "
    "WHEN l_linenumber = 4 AND l_orderkey % 10 = 0 THEN NULL "
    "WHEN l_linenumber = 4 THEN CONCAT('M', CAST(l_orderkey % 10 % 4 AS VARCHAR(1))) ELSE 'S' END AS valore "
    f"{_LINES}WHERE l_returnflag = 'N' AND l_linenumber IN (4, 5)"
)

RX_NONDIAB = (
    f"SELECT c_custkey AS idana, c_nationkey AS idcentro, {_SHIP_DATE} AS data, "
    "CASE l_orderkey % 3 WHEN 0 THEN 'AMD121' WHEN 1 THEN 'AMD124' ELSE 'AMD131' END AS codiceamd, "
    f"CONCAT('C', CAST(l_orderkey % 7 AS VARCHAR(1))) AS valore {_LINES}"
    "WHERE l_returnflag = 'N' AND l_linenumber >= 6"
)

VIEWS = {
    "registry": REGISTRY,
    "diagnosi": DIAGNOSI,
    "labs": LABS,
    "labs_calc": LABS_CALC,
    "instrumental": INSTRUMENTAL,
    "rx_drug": RX_DRUG,
    "rx_other": RX_OTHER,
    "rx_nondiab": RX_NONDIAB,
}

# Own short code tables for the codes above.
AMD_MEANINGS = {
    "AMD001": "Height",
    "AMD004": "Systolic blood pressure",
    "AMD005": "Diastolic blood pressure",
    "AMD007": "Fasting glucose (mg/dl)",
    "AMD008": "Glycated haemoglobin",
    "AMD013": "LDL, calculated",
    "AMD047": "Myocardial infarction",
    "AMD048": "Coronary angioplasty",
    "AMD049": "Coronary bypass",
    "AMD071": "Ictus",
    "AMD081": "Lower limb angioplasty",
    "AMD082": "Lower limb bypass",
    "AMD125": "Electrocardiogram",
    "AMD126": "Foot exam = pulse",
    "AMD208": "Head and neck vessel revascularisation",
    "AMD303": "Ischemic stroke",
    "AMD304": "GFR (CKDEpi)",
    "AMD927": "Body mass index",
}
ATC_NAMES = {"A10AB01": "insulin (human)", "A10AB04": "insulin lispro", "A10AB05": "insulin aspart"}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clinical_tables(spark: SparkSession, sf_dir: str) -> Tables:
    base = {n: source(spark, sf_dir, n) for n in SOURCES}
    return Tables(
        **{
            name: spark.sql(sql, **{n: f for n, f in base.items() if f"{{{n}}}" in sql})
            for name, sql in VIEWS.items()
        }
    )


def _code_table(spark: SparkSession, codes: dict[str, str], code: str, name: str) -> DataFrame:
    rows = ", ".join(f"('{c}', '{n}')" for c, n in codes.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({code}, {name})")


def amd_codes(spark: SparkSession) -> DataFrame:
    return _code_table(spark, AMD_MEANINGS, "codiceamd", "meaning")


def atc_codes(spark: SparkSession) -> DataFrame:
    return _code_table(spark, ATC_NAMES, "codiceatc", "atc_nome")
