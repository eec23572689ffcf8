"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa

from vitaline.sources.tables import Tables

EVENT = "idana long, idcentro int, data date, codiceamd string, valore string"
NUMERIC = "idana long, idcentro int, data date, codiceamd string, valore double"
CALC = "idana long, idcentro int, data date, codiceamd string, codicestitch string, valore double"
DRUG = (
    "idana long, idcentro int, data date, codiceatc string, quantita double, idpasto int, "
    "descrizionefarmaco string"
)
REGISTRY = (
    "idana long, idcentro int, sesso string, annonascita date, annodecesso date, annoprimoaccesso date, "
    "annodiagnosidiabete date, scolarita double, statocivile double, professione double, label boolean"
)
RAW_REGISTRY = (
    "idana long, idcentro int, sesso string, annonascita double, annodecesso double, annoprimoaccesso double, "
    "annodiagnosidiabete double, scolarita double, statocivile double, professione double, origine double, "
    "tipodiabete int"
)


def day(n: int) -> dt.date:
    """Day `n` after 2000-01-01."""
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


def event(patient, date, code="AMD400", value="S", centre=1):
    return (patient, centre, date if date is None or isinstance(date, dt.date) else day(date), code, value)


def person(patient, label=False, centre=1, sex="M", born=1950, died=None):
    return (
        patient, centre, sex, dt.date(born, 1, 1), dt.date(died, 1, 1) if died else None,
        dt.date(1990, 1, 1), dt.date(1991, 1, 1), None, 1.0, None, label,
    )


def raw_person(patient, centre=1, born=1950.0, died=None, access=1990.0, diagnosed=1991.0):
    return (patient, centre, "M", born, died, access, diagnosed, None, None, None, None, 5)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
    "date": pa.date32(), "boolean": pa.bool_(),
}


def frame(spark, rows, ddl):
    """A local table of plain columns."""
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return spark.createDataFrame(pa.table(dict(zip([n for n, _ in fields], arrays, strict=True))))


def tables(spark, registry=(), raw=False, **events) -> Tables:
    schemas = {
        "diagnosi": EVENT, "labs": NUMERIC, "labs_calc": CALC, "instrumental": EVENT, "rx_drug": DRUG,
        "rx_other": EVENT, "rx_nondiab": EVENT,
    }
    frames = {n: frame(spark, events.get(n, ()), s) for n, s in schemas.items()}
    frames["registry"] = frame(spark, registry, RAW_REGISTRY if raw else REGISTRY)
    return Tables(**frames)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
