"""Running a registered query and its SQL counterpart, and comparing rows, columns and types."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        raise TypeError(f"decimal {value}: cast it")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    return repr(value) if not isinstance(value, dt.date) else value.isoformat()


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


def differences(df, con, sql, show=3):
    """A list of what differs; empty when all agree."""
    result = con.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    actual = [tuple(r) for r in df.collect()]
    problems = []
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(n for n, _ in described):
        return [f"columns {sorted(ours)} against {sorted(n for n, _ in described)}"]
    for name, kind in described:
        if _KINDS.get(ours[name], ours[name]) != kind:
            problems.append(f"type of {name}: {ours[name]} against {kind}")
    names = sorted(ours)
    left = {n: i for i, n in enumerate(df.columns)}
    right = {n: i for i, (n, _) in enumerate(described)}
    a = sorted(tuple(_cell(r[left[n]]) for n in names) for r in actual)
    b = sorted(tuple(_cell(r[right[n]]) for n in names) for r in expected)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} against {len(b)}")
    if a != b:
        only_a = sorted(set(a) - set(b))
        only_b = sorted(set(b) - set(a))
        problems.append(f"{names}: {len(only_a)} only here {only_a[:show]}, {len(only_b)} only there {only_b[:show]}")
    return problems
