"""Column types of the eight tables as they arrive, and after dates are typed."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_ID = {"idana": T.LongType(), "idcentro": T.IntegerType()}
_TEXT_EVENT = {**_ID, "data": T.DateType(), "codiceamd": T.StringType(), "valore": T.StringType()}

RAW = {
    "registry": _schema(
        **_ID,
        sesso=T.StringType(),
        annonascita=T.DoubleType(),
        annodecesso=T.DoubleType(),
        annoprimoaccesso=T.DoubleType(),
        annodiagnosidiabete=T.DoubleType(),
        scolarita=T.DoubleType(),
        statocivile=T.DoubleType(),
        professione=T.DoubleType(),
        origine=T.DoubleType(),
        tipodiabete=T.IntegerType(),
    ),
    "diagnosi": _schema(**_TEXT_EVENT),
    "labs": _schema(**{**_TEXT_EVENT, "valore": T.DoubleType()}),
    "labs_calc": _schema(
        **_ID,
        data=T.DateType(),
        codiceamd=T.StringType(),
        codicestitch=T.StringType(),
        valore=T.DoubleType(),
    ),
    "instrumental": _schema(**_TEXT_EVENT),
    "rx_drug": _schema(
        **_ID,
        data=T.DateType(),
        codiceatc=T.StringType(),
        quantita=T.DoubleType(),
        idpasto=T.IntegerType(),
        descrizionefarmaco=T.StringType(),
    ),
    "rx_other": _schema(**_TEXT_EVENT),
    "rx_nondiab": _schema(**_TEXT_EVENT),
}

# A registry after cleaning: years became dates, two columns went, the label came.
CLEAN_REGISTRY = _schema(
    **_ID,
    sesso=T.StringType(),
    annonascita=T.DateType(),
    annodecesso=T.DateType(),
    annoprimoaccesso=T.DateType(),
    annodiagnosidiabete=T.DateType(),
    scolarita=T.DoubleType(),
    statocivile=T.DoubleType(),
    professione=T.DoubleType(),
    label=T.BooleanType(),
)
CLEAN = {**RAW, "registry": CLEAN_REGISTRY}

AMD_CODES = _schema(codice=T.StringType(), meaning=T.StringType())
ATC_INFO = _schema(
    codiceatc=T.StringType(),
    first=T.DateType(),
    last=T.DateType(),
    len=T.IntegerType(),
    numpatients=T.LongType(),
    numdates=T.LongType(),
    atc_nome=T.StringType(),
)

YEAR_COLUMNS = ["annonascita", "annodecesso", "annoprimoaccesso", "annodiagnosidiabete"]
