"""SQL for each registered query, over the sales tables, in the dialect of DuckDB."""

from __future__ import annotations

from vitaline.sources.derived import AMD_MEANINGS, ATC_NAMES, VIEWS

EVENTS = ["diagnosi", "labs", "labs_calc", "instrumental", "rx_drug", "rx_other", "rx_nondiab"]
CARDIO = "('AMD047','AMD048','AMD049','AMD071','AMD081','AMD082','AMD208','AMD303')"
AS_OF = "DATE '2021-12-31'"
SEED = 42

_NAMES = {n: n for n in ("customer", "orders", "lineitem")}


def _with(steps: dict[str, str], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    return f"WITH {body}\n{final}" if steps else final


def u(purpose: str, *parts: str, start: int = 1) -> str:
    """Hash uniform of seed, purpose and parts."""
    texts = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts)
    digest = f"md5(concat_ws('|', '{SEED}', '{purpose}', {texts}))"
    return f"(CAST(('0x' || substr({digest}, {start}, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE))"


# --- steps shared by several queries -------------------------------------------------------------

RAW = {name: sql.format(**_NAMES) for name, sql in VIEWS.items()}


def raw(*names: str) -> dict[str, str]:
    return {n: RAW[n] for n in names}


def _union(columns: str, prefix: str = "", names: list[str] = EVENTS, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns.format(table=n)} FROM {prefix}{n} {where}" for n in names
    )


TIMELINE = _union("idana, idcentro, data", where="WHERE data IS NOT NULL")
COHORT = f"SELECT DISTINCT idana, idcentro FROM diagnosi WHERE codiceamd IN {CARDIO}"

# Tables of the cohort, undated diagnoses dropped, up to the repaired registry.
REPAIR = {
    **RAW,
    "cohort": COHORT,
    "timeline": TIMELINE,
    "cohort_timeline": "SELECT t.* FROM timeline t SEMI JOIN cohort c USING (idana, idcentro)",
    "firsts": "SELECT idana, idcentro, min(data) AS first_event FROM cohort_timeline GROUP BY 1, 2",
    "typed": """
        SELECT r.* REPLACE (
          make_date(CAST(annonascita AS BIGINT), 1, 1) AS annonascita,
          make_date(CAST(annodecesso AS BIGINT), 1, 1) AS annodecesso,
          make_date(CAST(annoprimoaccesso AS BIGINT), 1, 1) AS annoprimoaccesso,
          make_date(CAST(annodiagnosidiabete AS BIGINT), 1, 1) AS annodiagnosidiabete)
        FROM registry r SEMI JOIN cohort USING (idana, idcentro)""",
    "accessed": f"""
        SELECT * FROM (
          SELECT t.* REPLACE (coalesce(annoprimoaccesso, CASE WHEN first_event > annonascita
            AND first_event < coalesce(annodecesso, {AS_OF}) THEN first_event END) AS annoprimoaccesso)
          FROM typed t LEFT JOIN firsts f USING (idana, idcentro))
        WHERE annoprimoaccesso IS NOT NULL""",
    "repaired": f"""
        SELECT * FROM (
          SELECT a.* REPLACE (coalesce(annodiagnosidiabete, annoprimoaccesso) AS annodiagnosidiabete)
          FROM accessed a)
        WHERE annoprimoaccesso <= coalesce(annodecesso, {AS_OF})
          AND annodiagnosidiabete <= coalesce(annodecesso, {AS_OF})""",
}

_ALIVE = f"year(e.data) BETWEEN year(r.annonascita) AND year(coalesce(r.annodecesso, {AS_OF}))"

# ... up to the labelled registry.
LABEL = {
    **REPAIR,
    "p_timeline": f"""SELECT e.* FROM timeline e JOIN repaired r USING (idana, idcentro) WHERE {_ALIVE}""",
    "p_diagnosi": f"""SELECT e.* FROM diagnosi e JOIN repaired r USING (idana, idcentro) WHERE {_ALIVE}""",
    "spans": """SELECT idana, idcentro, min(data) AS lo, max(data) AS hi, count(*) AS n
        FROM p_timeline GROUP BY 1, 2""",
    "spanned": "SELECT r.* FROM repaired r JOIN spans USING (idana, idcentro) WHERE hi - lo > 31",
    "problems": f"""SELECT idana, idcentro, max(data) AS last_problem FROM p_diagnosi
        WHERE codiceamd IN {CARDIO} GROUP BY 1, 2""",
    "labelled": """SELECT r.*, hi - last_problem <= 186 AS label
        FROM spanned r JOIN spans USING (idana, idcentro) JOIN problems USING (idana, idcentro)
        WHERE n >= 2 AND hi - lo > 186""",
}


def _kept(name: str) -> str:
    return (
        f"SELECT e.* FROM {name} e JOIN labelled r USING (idana, idcentro) "
        f"WHERE {_ALIVE} AND e.data IS NOT NULL"
    )


def _clip(code: str, ranges: dict[str, tuple[int, int]]) -> str:
    cases = " ".join(
        f"WHEN {code} = '{c}' AND valore < {lo} THEN {lo} WHEN {code} = '{c}' AND valore > {hi} THEN {hi}"
        for c, (lo, hi) in ranges.items()
    )
    return f"CAST(CASE {cases} ELSE valore END AS DOUBLE)"


CLIP_LABS = _clip("codiceamd", {"AMD004": (40, 200), "AMD005": (40, 130), "AMD007": (50, 500), "AMD008": (5, 15)})
CLIP_CALC = _clip("codicestitch", {"STITCH002": (30, 300), "STITCH003": (60, 330)})
OVERRIDE = (
    "CASE codiceamd WHEN 'AMD049' THEN 'S' WHEN 'AMD303' THEN '434.91' WHEN 'AMD081' THEN '39.5' ELSE valore END"
)


def _mean_fill(labs: str, registry: str, same_code: bool = True) -> str:
    where = "WHERE codiceamd = 'AMD001'" if same_code else ""
    return f"""SELECT l.* REPLACE (CASE WHEN l.codiceamd = 'AMD001' AND l.valore IS NULL THEN m.mean
          ELSE l.valore END AS valore)
        FROM {labs} l JOIN {registry} r USING (idana, idcentro)
        LEFT JOIN (SELECT sesso, avg(valore) AS mean FROM {labs} JOIN {registry} USING (idana, idcentro)
                   {where} GROUP BY sesso) m ON m.sesso = r.sesso"""


def _weighted_fill(table: str) -> dict[str, str]:
    """Steps that end in `weighted`: missing AMD152 values drawn by position among the known ones."""
    missing = "codiceamd = 'AMD152' AND valore IS NULL"
    return {
        "w_known": f"""SELECT valore, count(*) AS n, sum(count(*)) OVER (ORDER BY valore) AS upto
            FROM {table} WHERE codiceamd = 'AMD152' AND valore IS NOT NULL GROUP BY valore""",
        "w_numbered": f"""SELECT *, row_number() OVER (PARTITION BY idana, idcentro, data) AS copy
            FROM {table} WHERE {missing}""",
        "w_drawn": f"""SELECT *, floor({u("fill", "idana", "idcentro", "data", "codiceamd", "copy")}
              * (SELECT sum(n) FROM w_known)) AS draw FROM w_numbered""",
        "weighted": f"""
            SELECT idana, idcentro, data, codiceamd, valore FROM {table}
            WHERE coalesce(NOT ({missing}), true)
            UNION ALL
            SELECT idana, idcentro, data, codiceamd,
              (SELECT k.valore FROM w_known k WHERE d.draw >= k.upto - k.n AND d.draw < k.upto)
            FROM w_drawn d""",
    }


DROP_NULL = "coalesce(NOT (codiceamd = 'AMD096' AND valore IS NULL), true)"

# ... up to the eight clean tables, c_*.
CLEAN = {
    **LABEL,
    "c_registry": "SELECT * EXCLUDE (origine, tipodiabete) FROM labelled",
    "c_diagnosi": f"SELECT * REPLACE ({OVERRIDE} AS valore) FROM ({_kept('diagnosi')})",
    "k_labs": f"SELECT * REPLACE ({CLIP_LABS} AS valore) FROM ({_kept('labs')})",
    "c_labs": _mean_fill("k_labs", "labelled"),
    "c_labs_calc": f"SELECT * REPLACE ({CLIP_CALC} AS valore) FROM ({_kept('labs_calc')})",
    "c_instrumental": f"""SELECT * REPLACE (CASE WHEN codiceamd = 'AMD126' AND valore IS NULL THEN 'N'
        ELSE valore END AS valore) FROM ({_kept('instrumental')})""",
    "c_rx_drug": _kept("rx_drug"),
    "k_rx_other": f"SELECT * FROM ({_kept('rx_other')}) WHERE {DROP_NULL}",
    **_weighted_fill("k_rx_other"),
    "c_rx_other": "SELECT * FROM weighted",
    "c_rx_nondiab": _kept("rx_nondiab"),
}

C_TIMELINE = _union("idana, idcentro, data", "c_")
# Last event and label of each clean patient, and the tables without leakage, s_*.
LASTS = {
    **CLEAN,
    "lasts": f"""SELECT r.idana, r.idcentro, label, max(data) AS last_event
        FROM c_registry r LEFT JOIN ({C_TIMELINE}) USING (idana, idcentro) GROUP BY 1, 2, 3""",
}


def _truncated(name: str) -> str:
    return f"""SELECT e.* FROM c_{name} e LEFT JOIN lasts l ON e.idana = l.idana AND e.idcentro = l.idcentro
        AND NOT l.label WHERE l.last_event IS NULL OR l.last_event - e.data > 182"""


def _stripped(name: str) -> str:
    return f"""SELECT e.* FROM {name} e LEFT JOIN lasts l ON e.idana = l.idana AND e.idcentro = l.idcentro
        AND l.label WHERE NOT coalesce(e.codiceamd IN {CARDIO} AND l.last_event - e.data <= 186, false)"""


SAFE = {
    **LASTS,
    "t_diagnosi": _truncated("diagnosi"),
    "s_diagnosi": _stripped("t_diagnosi"),
    **{f"s_{n}": _truncated(n) for n in EVENTS if n != "diagnosi"},
}

# the smallest power of ten above every id, at least 100000
OFFSET = "(SELECT greatest(100000, CAST(pow(10, length(CAST(max(abs(idana)) AS VARCHAR))) AS BIGINT)) FROM c_registry)"
RATIO = "(SELECT floor(count(*) FILTER (NOT label) / count(*) FILTER (label)) FROM c_registry)"


def _copied(table: str, columns: list[str]) -> str:
    """Every event of a positive patient once per copy, with its number among equal rows."""
    listed = ", ".join(columns)
    return f"""SELECT e.*, c.copy_id FROM (
          SELECT {listed}, row_number() OVER (PARTITION BY {listed}) AS nth FROM {table}
          SEMI JOIN (SELECT * FROM c_registry WHERE label) p USING (idana, idcentro)) e,
        (SELECT unnest(range(1, CAST({RATIO} AS BIGINT))) AS copy_id) c"""


def _jittered(rows: str, name: str, columns: list[str], where: str) -> str:
    identity = [*columns, "copy_id", "nth"]
    u1, u2 = u(f"jitter-{name}", *identity), u(f"jitter-{name}", *identity, start=13)
    days = f"CAST(trunc(5.0 * sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2})) AS INTEGER)"
    rest = ", ".join(columns[3:])
    return f"""SELECT -(idana + {OFFSET} * copy_id) AS idana, idcentro, CAST(data + {days} AS DATE) AS data, {rest}
        FROM ({rows}) WHERE {where}"""


COLUMNS = {
    "diagnosi": ["idana", "idcentro", "data", "codiceamd", "valore"],
    "labs": ["idana", "idcentro", "data", "codiceamd", "valore"],
    "labs_calc": ["idana", "idcentro", "data", "codiceamd", "codicestitch", "valore"],
    "instrumental": ["idana", "idcentro", "data", "codiceamd", "valore"],
    "rx_drug": ["idana", "idcentro", "data", "codiceatc", "quantita", "idpasto", "descrizionefarmaco"],
    "rx_other": ["idana", "idcentro", "data", "codiceamd", "valore"],
    "rx_nondiab": ["idana", "idcentro", "data", "codiceamd", "valore"],
}


def _synthetic(table: str, name: str, keep: float = 0.5) -> str:
    columns = COLUMNS[name]
    where = f"{u(f'keep-{name}', *columns, 'copy_id', 'nth')} < {keep}"
    return _jittered(_copied(table, columns), name, columns, where)


REGISTRY_COPIES = f"""SELECT r.* FROM c_registry r UNION ALL
    SELECT r.* REPLACE (-(idana + {OFFSET} * copy_id) AS idana) FROM c_registry r,
      (SELECT unnest(range(1, CAST({RATIO} AS BIGINT))) AS copy_id) WHERE label"""


def _counts(step: str, prefix: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{step}' AS step, '{n}' AS \"table\", count(*) AS n_rows FROM {prefix}{n}" for n in names
    )


def _dated(prefix: str) -> str:
    return _union("'{table}' AS \"table\", idana, idcentro, data", prefix)


# --- the queries ---------------------------------------------------------------------------------

ORACLES: dict[str, str] = {}

_HIST = """SELECT idana, idcentro, max(data) AS last_event, max(data) - min(data) AS span, count(*) AS n
    FROM cohort_timeline GROUP BY 1, 2"""
LABEL_COHORT = _with(
    REPAIR,
    f"""SELECT h.idana, h.idcentro, last_event - last_problem <= 186 AS label
    FROM ({_HIST}) h JOIN (SELECT idana, idcentro, max(data) AS last_problem FROM diagnosi
      WHERE codiceamd IN {CARDIO} AND data IS NOT NULL GROUP BY 1, 2) p USING (idana, idcentro)
    WHERE n >= 2""",
)
ORACLES["label_cohort"] = LABEL_COHORT
ORACLES["label_of_cohort_tables"] = LABEL_COHORT.replace("WHERE n >= 2", "WHERE n >= 2 AND span > 186")
ORACLES["label_after_repair"] = _with(LABEL, "SELECT idana, idcentro, label FROM labelled")
ORACLES["label_counts"] = f"SELECT label, count(*) AS n_rows FROM ({LABEL_COHORT}) GROUP BY label"
ORACLES["patient_funnel"] = _with(
    LABEL,
    """SELECT '1 cohort' AS step, count(*) AS n_patients FROM typed
    UNION ALL SELECT '2 dates', count(*) FROM repaired
    UNION ALL SELECT '3 span', count(*) FROM spanned
    UNION ALL SELECT '5 label', count(*) FROM labelled
    UNION ALL SELECT '5 label negative', count(*) FROM labelled WHERE NOT label
    UNION ALL SELECT '5 label positive', count(*) FROM labelled WHERE label""",
)
ORACLES["key_overlap"] = _with(
    raw("registry", "diagnosi"),
    """SELECT count(*) AS n_keys FROM (SELECT DISTINCT idana, idcentro FROM registry) r
    JOIN (SELECT DISTINCT idana, idcentro FROM diagnosi) d USING (idana, idcentro)""",
)
ORACLES["cohort_keys"] = _with(raw("diagnosi"), COHORT)
ORACLES["cohort_rows_per_table"] = _with(
    {**RAW, "cohort": COHORT},
    _counts("0 raw", "", ["registry", *EVENTS])
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '1 cohort', '{n}', count(*) FROM {n} SEMI JOIN cohort USING (idana, idcentro)"
        for n in ["registry", *EVENTS]
    ),
)
_STATS = """SELECT idana, idcentro, min(data) AS first_event, max(data) AS last_event, count(*) AS n_events,
    max(data) - min(data) AS span_days FROM ({}) GROUP BY 1, 2"""
ORACLES["event_timeline_stats"] = _with(RAW, _STATS.format(TIMELINE))
ORACLES["event_timeline_without_rx"] = _with(
    raw(*EVENTS[:4]),
    _STATS.format(_union("idana, idcentro, data", names=EVENTS[:4], where="WHERE data IS NOT NULL")),
)
ORACLES["daily_rollup"] = _with(
    RAW,
    f"""SELECT idana, idcentro, data, count(*) AS n_events, count(*) FILTER (target) AS n_target FROM (
      SELECT idana, idcentro, data, codiceamd IN {CARDIO} AS target FROM diagnosi UNION ALL
      {_union("idana, idcentro, data, false", names=EVENTS[1:])}) WHERE data IS NOT NULL GROUP BY 1, 2, 3""",
)
_SPAN = f"SELECT idana, idcentro FROM ({TIMELINE}) GROUP BY 1, 2 HAVING max(data) - min(data) > 31"
_GAPS = """SELECT {k}, {d}, count(*) AS n_events,
    CAST(coalesce({d} - lag({d}) OVER (PARTITION BY {k} ORDER BY {d}), 0) AS BIGINT) AS days_since_previous
    FROM ({t}) GROUP BY {k}, {d}"""
ORACLES["event_day_gaps"] = _with(RAW, _GAPS.format(k="idana, idcentro", d="data", t=TIMELINE))
ORACLES["stream_day_gaps"] = _GAPS.format(
    k="user_id", d="day", t="SELECT user_id, CAST(ts AS DATE) AS day FROM events"
)
ORACLES["first_patients"] = _with(
    raw("registry"), "SELECT idana, idcentro FROM registry ORDER BY idana, idcentro LIMIT 500"
)
ORACLES["history_span_filter"] = _with(RAW, _SPAN)
ORACLES["history_span_rows"] = _with(
    {**RAW, "spanned": _SPAN},
    " UNION ALL ".join(
        f"SELECT '3 span' AS step, '{n}' AS \"table\", count(*) AS n_rows "
        f"FROM {n} SEMI JOIN spanned USING (idana, idcentro)"
        for n in ["registry", *EVENTS]
    ),
)
ORACLES["min_two_events"] = _with(
    RAW, f"SELECT idana, idcentro, count(*) AS n_events FROM ({TIMELINE}) GROUP BY 1, 2 HAVING count(*) >= 2"
)
ORACLES["last_events"] = _with(
    RAW,
    f"""SELECT * FROM (SELECT idana, idcentro, max(data) AS last_event FROM ({TIMELINE}) GROUP BY 1, 2)
    JOIN (SELECT idana, idcentro, max(data) AS last_problem FROM diagnosi WHERE codiceamd IN {CARDIO}
      GROUP BY 1, 2) USING (idana, idcentro)""",
)
ORACLES["registry_probes"] = _with(
    raw("registry"),
    """SELECT count(*) FILTER (annonascita < 1900) AS birth_before_1900,
    count(*) FILTER (annodecesso > 2023) AS death_after_2023,
    count(*) FILTER (annodiagnosidiabete < annonascita) AS diagnosis_before_birth,
    count(*) FILTER (annoprimoaccesso < annonascita) AS access_before_birth,
    count(*) FILTER (coalesce(annodecesso, 2021) < annonascita) AS death_before_birth,
    count(*) FILTER (annoprimoaccesso > coalesce(annodecesso, 2021)) AS access_after_death,
    count(*) FILTER (annodiagnosidiabete > coalesce(annodecesso, 2021)) AS diagnosis_after_death
    FROM registry""",
)
ORACLES["repair_first_access"] = _with(REPAIR, "SELECT idana, idcentro, annoprimoaccesso FROM accessed")
ORACLES["repair_diabetes_year"] = _with(
    REPAIR,
    "SELECT idana, idcentro, annonascita, annodecesso, annoprimoaccesso, annodiagnosidiabete FROM repaired",
)
ORACLES["plausible_events"] = _with(
    RAW,
    f"""SELECT "table", idana, idcentro, data FROM ({_dated("")}) JOIN registry USING (idana, idcentro)
    WHERE year(data) >= annonascita AND year(data) <= coalesce(annodecesso, 2021)""",
)
ORACLES["out_of_range"] = _with(
    raw("labs", "labs_calc"),
    f"""SELECT codiceamd AS code, count(*) FILTER (valore <> {CLIP_LABS}) AS n_outside FROM labs
    WHERE codiceamd IN ('AMD004', 'AMD005', 'AMD007', 'AMD008') GROUP BY 1
    UNION ALL SELECT codicestitch, count(*) FILTER (valore <> {CLIP_CALC}) FROM labs_calc
    WHERE codicestitch IN ('STITCH002', 'STITCH003') GROUP BY 1""",
)
ORACLES["clip_values"] = _with(raw("labs"), f"SELECT * REPLACE ({CLIP_LABS} AS valore) FROM labs")
ORACLES["clip_stream_values"] = """SELECT event_id, event_type,
    CASE event_type WHEN 'view' THEN least(greatest(value, 2.0::DOUBLE), 40.0::DOUBLE)
      WHEN 'click' THEN least(greatest(value, 5.0::DOUBLE), 60.0::DOUBLE) ELSE value END AS value FROM events"""
ORACLES["clip_calculated_values"] = _with(
    raw("labs_calc"), f"SELECT * REPLACE ({CLIP_CALC} AS valore) FROM labs_calc"
)
ORACLES["override_values"] = _with(raw("diagnosi"), f"SELECT * REPLACE ({OVERRIDE} AS valore) FROM diagnosi")
ORACLES["fill_mode_code"] = _with(
    raw("instrumental"),
    """SELECT * REPLACE (CASE WHEN codiceamd = 'AMD126' THEN coalesce(valore, 'N') ELSE valore END AS valore)
    FROM instrumental""",
)
ORACLES["drop_null_code"] = _with(raw("rx_other"), f"SELECT * FROM rx_other WHERE {DROP_NULL}")
for _name, _same in (("fill_group_mean", True), ("fill_group_mean_all_codes", False)):
    ORACLES[_name] = _with(
        raw("labs", "registry"),
        f"SELECT * REPLACE (round(valore, 6) AS valore) FROM ({_mean_fill('labs', 'registry', _same)})",
    )
ORACLES["fill_weighted"] = _with({**raw("rx_other"), **_weighted_fill("rx_other")}, "SELECT * FROM weighted")
ORACLES["value_distribution"] = _with(
    {**raw("rx_other"), **_weighted_fill("rx_other")},
    """SELECT valore, n, round(n / (SELECT sum(n) FROM w_known), 6) AS probability,
    CAST(upto - n AS BIGINT) AS count_from, CAST(upto AS BIGINT) AS count_to FROM w_known""",
)
ORACLES["clean_rows_per_table"] = _with(CLEAN, _counts("6 clean", "c_", ["registry", *EVENTS]))


def _step_rows(step: str, registry: str) -> str:
    events = [
        f"""SELECT '{step}' AS step, '{n}' AS "table", count(*) AS n_rows FROM {n} e JOIN {registry} r USING (idana, idcentro)
        WHERE {_ALIVE} AND e.data IS NOT NULL"""
        for n in EVENTS
    ]
    return " UNION ALL ".join([f"SELECT '{step}' AS step, 'registry' AS \"table\", count(*) AS n_rows FROM {registry}", *events])


ORACLES["funnel_rows_per_table"] = _with(
    {**CLEAN, "cohort": COHORT},
    " UNION ALL ".join(
        f"""SELECT '1 cohort' AS step, '{n}' AS "table", count(*) AS n_rows FROM {n} SEMI JOIN cohort USING (idana, idcentro)
        {"WHERE data IS NOT NULL" if n == "diagnosi" else ""}"""
        for n in ["registry", *EVENTS]
    )
    + " UNION ALL "
    + " UNION ALL ".join(_step_rows(s, r) for s, r in (("2 dates", "repaired"), ("3 span", "spanned"), ("5 label", "labelled")))
    + " UNION ALL "
    + _counts("6 clean", "c_", ["registry", *EVENTS]),
)
ORACLES["clean_registry"] = _with(CLEAN, "SELECT * FROM c_registry")

_REGISTRY_COLUMNS = [
    "idana", "idcentro", "sesso", "annonascita", "annodecesso", "annoprimoaccesso", "annodiagnosidiabete",
    "scolarita", "statocivile", "professione",
]


def _nulls(stage: str, prefix: str, registry: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{stage}' AS stage, '{c}' AS \"column\", "
        f"count(*) FILTER ({c} IS NULL) AS nulls FROM {prefix}{t}"
        for t, columns in {"registry": registry, **COLUMNS}.items()
        for c in columns
    )


ORACLES["null_profile"] = _with(RAW, _nulls("raw", "", [*_REGISTRY_COLUMNS, "origine", "tipodiabete"]))
ORACLES["null_profile_clean"] = _with(CLEAN, _nulls("clean", "c_", [*_REGISTRY_COLUMNS, "label"]))
ORACLES["null_dates"] = _with(
    RAW, _union("'{table}' AS \"table\", count(*) FILTER (data IS NULL) AS n_null")
)
ORACLES["null_values_per_code"] = _with(
    RAW,
    " UNION ALL ".join(
        f"SELECT codiceamd, count(*) AS n_null, '{n}' AS \"table\" FROM {n} WHERE valore IS NULL GROUP BY 1"
        for n in ["diagnosi", "labs", "instrumental", "rx_other"]
    ),
)
ORACLES["null_atc_descriptions"] = _with(
    raw("rx_drug"),
    "SELECT descrizionefarmaco, count(*) AS n_rows FROM rx_drug WHERE codiceatc IS NULL GROUP BY 1",
)
ORACLES["named_by_code_file"] = _with(
    raw("diagnosi", "labs"),
    " UNION ALL ".join(
        f"""SELECT codiceamd, CASE WHEN codiceamd <> 'AMD009' THEN 'exam, "' || codiceamd || '"' END AS meaning,
        count(*) AS n_events, '{n}' AS "table" FROM {n} GROUP BY 1, 2"""
        for n in ["diagnosi", "labs"]
    ),
)
_CODE_OF = {n: "codiceatc" if n == "rx_drug" else "codiceamd" for n in EVENTS}
ORACLES["code_counts"] = _with(
    RAW,
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", {c} AS code, count(*) AS n_rows FROM {n} WHERE {c} IS NOT NULL GROUP BY {c}"
        for n, c in _CODE_OF.items()
    ),
)
ORACLES["code_pair_counts"] = _with(
    raw("labs_calc"),
    "SELECT codicestitch, codiceamd, count(*) AS n_rows FROM labs_calc WHERE codiceamd IS NOT NULL GROUP BY 1, 2",
)
ORACLES["null_code_in_set"] = _with(
    raw("labs_calc"),
    """SELECT count(*) AS n_missing, count(*) FILTER (codicestitch IN ('STITCH003', 'STITCH004')) AS n_in_set
    FROM labs_calc WHERE codiceamd IS NULL""",
)
ORACLES["truncate_negative"] = _with(
    {**LASTS, **{f"t_{n}": _truncated(n) for n in EVENTS}}, _dated("t_")
)
ORACLES["strip_positive_codes"] = _with(LASTS, _stripped("c_diagnosi"))
ORACLES["leakage_removed"] = _with(SAFE, "SELECT * FROM s_diagnosi")
ORACLES["class_ratio"] = _with(
    CLEAN,
    """SELECT count(*) FILTER (NOT label) AS n_negative, count(*) FILTER (label) AS n_positive,
    CAST(floor(count(*) FILTER (NOT label) / count(*) FILTER (label)) AS BIGINT) AS ratio FROM c_registry""",
)
_UNDER = f"""SELECT idana, idcentro, label FROM c_registry
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY {u("undersample", "idana", "idcentro")}, idana, idcentro)
      <= (SELECT least(count(*) FILTER (label), count(*) FILTER (NOT label)) FROM c_registry)"""
ORACLES["undersample"] = _with(CLEAN, _UNDER)
ORACLES["undersample_events"] = _with(
    {**CLEAN, "chosen": _UNDER}, f"SELECT * FROM ({_dated('c_')}) SEMI JOIN chosen USING (idana, idcentro)"
)
ORACLES["oversample_registry"] = _with(CLEAN, REGISTRY_COPIES)


def _all_columns(sql: str, name: str, kind: str = "table") -> str:
    """Rows of one event table in the columns that hold all tables' rows, values as text or number."""
    own = COLUMNS[name]
    texts = [f"CAST({c} AS VARCHAR) AS {c}" if c in own else f"CAST(NULL AS VARCHAR) AS {c}"
             for c in ("codiceamd", "codicestitch", "codiceatc", "descrizionefarmaco")]
    numbers = [f"CAST({c} AS DOUBLE) AS {c}" if c in own else f"CAST(NULL AS DOUBLE) AS {c}" for c in ("quantita", "idpasto")]
    value = f"CAST({_value_text(name)} AS VARCHAR)" if "valore" in own else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{name}' AS \"{kind}\", idana, idcentro, data, {', '.join(texts + numbers)}, {value} AS valore FROM ({sql})"


def _value_text(name: str) -> str:
    return "CAST(round(valore * 1000) AS BIGINT)" if name in ("labs", "labs_calc") else "valore"


ORACLES["oversample_events"] = _with(
    CLEAN, " UNION ALL ".join(_all_columns(_synthetic(f"c_{n}", n), n) for n in EVENTS)
)


def _exact(name: str) -> str:
    chance = u(f"keep-{name}", *COLUMNS[name], "copy_id", "nth")
    return _jittered(
        f"SELECT *, row_number() OVER (ORDER BY {chance}) AS place FROM e_{name}",
        name,
        COLUMNS[name],
        f"place <= (SELECT round_even(count(*) * 0.5, 0) FROM e_{name})",
    )


ORACLES["oversample_events_exact"] = _with(
    {**CLEAN, **{f"e_{n}": _copied(f"c_{n}", COLUMNS[n]) for n in EVENTS}},
    " UNION ALL ".join(_all_columns(_exact(n), n) for n in EVENTS),
)
BALANCED = {**SAFE, "b_registry": REGISTRY_COPIES} | {
    f"b_{n}": f"SELECT * FROM s_{n} UNION ALL {_synthetic(f's_{n}', n)}" for n in EVENTS
}
ORACLES["balanced_registry"] = _with(BALANCED, "SELECT * FROM b_registry")
ORACLES["balanced_events"] = _with(
    BALANCED, " UNION ALL ".join(_all_columns(f"SELECT * FROM b_{n}", n) for n in EVENTS)
)
ORACLES["numbered_duplicates"] = _with(
    raw("labs_calc"),
    """SELECT *, number > 1 AS duplicated FROM (SELECT idana, idcentro, codicestitch,
      row_number() OVER (PARTITION BY idana, idcentro, codicestitch) AS number FROM labs_calc)""",
)
ORACLES["balanced_rows_per_table"] = _with(
    BALANCED,
    _counts("balanced", "b_", ["registry", *EVENTS]),
)
_U_SPLIT = u("split", "idana", "idcentro")
ORACLES["split_patients"] = _with(
    raw("registry"),
    f"""SELECT idana, idcentro, CASE WHEN {_U_SPLIT} < 0.6 THEN 'train' WHEN {_U_SPLIT} < 0.9 THEN 'test'
    ELSE 'val' END AS split FROM registry""",
)
ORACLES["split_rest"] = _with(
    raw("registry"), f"SELECT idana, idcentro FROM registry WHERE {_U_SPLIT} < 0.8"
)

# --- profiles

_AGE_BINS = [(0, 50), (50, 60), (60, 70), (70, 80), (80, 90), (90, 100), (100, 120)]
_AGE_NAMES = ["0-50", "51-60", "61-70", "71-80", "81-90", "91-100", "101-120"]
_VALUE_BINS = [(0, 25), (25, 50), (50, 75), (75, 100), (100, 150), (150, 200), (200, 300)]
_VALUE_NAMES = ["0-25", "26-50", "51-75", "76-100", "101-150", "151-200", "201-300"]


def _bins(bins: list[tuple[int, int]], names: list[str]) -> str:
    rows = ", ".join(f"({i}, '{n}', {lo}, {hi})" for i, ((lo, hi), n) in enumerate(zip(bins, names, strict=True)))
    return f"(SELECT CAST(no AS BIGINT) AS bin_no, bin, lo, hi FROM (VALUES {rows}) v(no, bin, lo, hi))"


_AGES = f"{_bins(_AGE_BINS, _AGE_NAMES)} b LEFT JOIN a ON age > lo AND age <= hi GROUP BY bin_no, bin"
_AGED = "SELECT sesso, coalesce(annodecesso, 2021) - annonascita AS age FROM registry"
ORACLES["age_groups"] = _with(
    {**raw("registry"), "a": _AGED}, f"SELECT bin_no, bin, count(age) AS n_rows FROM {_AGES}"
)
ORACLES["age_groups_clean"] = _with(
    {**CLEAN, "a": "SELECT coalesce(year(annodecesso), 2021) - year(annonascita) AS age FROM c_registry"},
    f"SELECT bin_no, bin, count(age) AS n_rows FROM {_AGES}",
)
ORACLES["age_group_by_sex"] = _with(
    {**raw("registry"), "a": _AGED},
    f"""SELECT bin_no, bin, count(age) FILTER (sesso = 'F') AS "F", count(age) FILTER (sesso = 'M') AS "M"
    FROM {_AGES}""",
)
ORACLES["share_by_centre"] = _with(
    raw("registry"),
    """SELECT idcentro, count(*) AS n_rows, round(count(*) * 100.0 / (SELECT count(*) FROM registry), 6) AS percent
    FROM registry GROUP BY 1""",
)
ORACLES["patients_by_sex"] = _with(
    raw("registry"), "SELECT sesso, count(*) AS n_rows FROM registry WHERE sesso IS NOT NULL GROUP BY 1"
)


def _patients(table: str, *columns: str) -> str:
    listed = ", ".join(columns)
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""SELECT {listed}, count(*) AS n_patients FROM
        (SELECT DISTINCT idana, idcentro, {listed} FROM {table} WHERE {present}) GROUP BY {listed}"""


ORACLES["patients_per_code"] = _with(
    RAW,
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", {c} AS code, n_patients FROM ({_patients(n, c)})" for n, c in _CODE_OF.items()
    ),
)
ORACLES["patients_per_stitch"] = _with(raw("labs_calc"), _patients("labs_calc", "codicestitch"))
ORACLES["patients_per_code_pair"] = _with(
    raw("labs_calc"), _patients("labs_calc", "codicestitch", "codiceamd")
)
ORACLES["patients_per_value"] = _with(raw("rx_nondiab"), _patients("rx_nondiab", "valore"))
ORACLES["wanted_codes"] = _with(
    raw("diagnosi"), f"SELECT * FROM ({_patients('diagnosi', 'codiceamd')}) WHERE codiceamd IN {CARDIO}"
)
ORACLES["values_per_code"] = _with(
    RAW,
    " UNION ALL ".join(
        f"""SELECT codiceamd, valore, count(*) AS n_rows, '{n}' AS "table" FROM {n}
        WHERE codiceamd {codes} AND valore IS NOT NULL GROUP BY 1, 2"""
        for n, codes in (("diagnosi", f"IN {CARDIO}"), ("instrumental", "IS NOT NULL"), ("rx_other", "IS NOT NULL"))
    ),
)


def _histogram(table: str, code: str) -> str:
    return f"""SELECT c.{code}, bin_no, bin, count(v.valore) AS n_rows
        FROM (SELECT DISTINCT {code} FROM {table}) c CROSS JOIN {_bins(_VALUE_BINS, _VALUE_NAMES)} b
        LEFT JOIN {table} v ON v.{code} = c.{code} AND v.valore > lo AND v.valore <= hi
        GROUP BY 1, 2, 3"""


ORACLES["stream_histogram"] = _histogram("events", "event_type").replace("v.valore", "v.value")
ORACLES["stream_type_counts"] = "SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1"
ORACLES["histogram_per_code"] = _with(raw("labs"), _histogram("labs", "codiceamd"))
ORACLES["histogram_per_stitch"] = _with(raw("labs_calc"), _histogram("labs_calc", "codicestitch"))

# --- features

_FLAT = {
    "labs": ("esame", "parametri", "esame parametri"),
    "labs_calc": ("esame", "parametri calcolati", "esame parametri calcolati"),
    "instrumental": ("esame", "strumentali", "esame strumentale"),
    "rx_drug": ("prescrizione", "farmaco diabate", "prescrizione farmaco diabate"),
    "rx_other": ("prescrizione", "non-farmaco diabete", "prescrizione non-farmaco diabete"),
    "rx_nondiab": ("prescrizione", "non-diabete", "prescrizione non-diabete"),
    "diagnosi": ("diagnosi", "", "diagnosi"),
}


def _feature_union(prefix: str, tag: int) -> str:
    """All events in feature order; `tag` picks the vocabulary of tipo."""
    parts = []
    for src, (name, tags) in enumerate(_FLAT.items()):
        has = COLUMNS[name]
        text = [c if c in has else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("codiceamd", "codicestitch", "codiceatc")]
        number = name in ("labs", "labs_calc")
        kind = tags[tag]
        parts.append(
            f"""SELECT idana, idcentro, data, {src} AS src, {", ".join(text)},
            {"valore" if number else "CAST(NULL AS DOUBLE)"} AS num,
            {"valore" if not number and "valore" in has else "CAST(NULL AS VARCHAR)"} AS txt,
            {"quantita" if name == "rx_drug" else "CAST(NULL AS DOUBLE)"} AS quantita,
            {"idpasto" if name == "rx_drug" else "CAST(NULL AS INTEGER)"} AS idpasto,
            {"descrizionefarmaco" if name == "rx_drug" else "CAST(NULL AS VARCHAR)"} AS descrizionefarmaco,
            '{kind}' AS tipo, '{tags[1]}' AS extra FROM {prefix}{name}"""
        )
    return " UNION ALL ".join(parts)


def _first_seen(events: str, column: str, order: str) -> str:
    """(value, code) of one column by place of first appearance."""
    return f"""SELECT value, CAST(row_number() OVER (ORDER BY seen, value NULLS FIRST) - 1 AS INTEGER) AS code
        FROM (SELECT {column} AS value, min(({order})) AS seen FROM {events} GROUP BY 1)"""


_CODED = ["codiceamd", "codiceatc", "codicestitch", "descrizionefarmaco", "tipo", "extra"]
ORACLES["encode_first_seen"] = _with(
    {**RAW, "events": _feature_union("", 0)},
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", value, code FROM ({_first_seen('events', c, 'src, data, idana, idcentro')})"
        for c in _CODED
    ),
)
_MACRO = ["diagnosi", "labs", "labs_calc", "instrumental", "rx_drug", "rx_other"]


def _sorted_codes(rows: str, by: str = "") -> str:
    """Distinct values numbered, numbers before texts."""
    part = f"PARTITION BY {by} " if by else ""
    first = f"{by}, " if by else ""
    return f"""SELECT {first}is_text, num, txt,
        CAST(row_number() OVER ({part}ORDER BY is_text, num, txt) - 1 AS INTEGER) AS code FROM
        (SELECT DISTINCT {first}CAST(num IS NULL AS INTEGER) AS is_text, num,
           CASE WHEN num IS NULL THEN txt END AS txt FROM {rows} WHERE num IS NOT NULL OR txt IS NOT NULL)"""


ORACLES["encode_sorted"] = _with(
    {**RAW, "events": f"SELECT * FROM ({_feature_union('', 0)}) WHERE extra <> 'non-diabete'"},
    _sorted_codes("events"),
)

_FLAT_COLUMNS = """idana, idcentro, data, codiceamd, tipo, extra, codicestitch, codiceatc, quantita, idpasto,
    descrizionefarmaco, sesso, scolarita, statocivile, professione, label, valore"""


def _coded_join(columns: list[str], null_code: bool) -> tuple[str, str]:
    """Select list and joins that put codes in place of the values."""
    joins = " ".join(f"LEFT JOIN k_{c} ON k_{c}.value IS NOT DISTINCT FROM e.{c}" for c in columns)
    if null_code:
        picks = ", ".join(f"k_{c}.code AS {c}" for c in columns)
    else:
        picks = ", ".join(f"CASE WHEN e.{c} IS NULL THEN -1 ELSE k_{c}.code END AS {c}" for c in columns)
    return picks, joins


_PICKS, _JOINS = _coded_join(_CODED, True)
FLAT = {
    **CLEAN,
    "events": f"SELECT * FROM ({_feature_union('c_', 0)}) SEMI JOIN c_registry USING (idana, idcentro)",
    **{f"k_{c}": _first_seen("events", c, "src, data, idana, idcentro") for c in _CODED},
    "flat": f"""SELECT e.idana, e.idcentro, e.data, {_PICKS}, coalesce(e.quantita, -100) AS quantita,
        coalesce(e.idpasto, -100) AS idpasto, CAST(sesso = 'F' AS INTEGER) AS sesso,
        coalesce(scolarita, -100) AS scolarita, coalesce(statocivile, -100) AS statocivile,
        coalesce(professione, -100) AS professione, CAST(label AS INTEGER) AS label,
        round(CAST(coalesce(num, CASE txt WHEN 'N' THEN 0 WHEN 'P' THEN 1 WHEN 'S' THEN 2
          ELSE TRY_CAST(txt AS DOUBLE) END, -100) AS DOUBLE), 6) AS valore
        FROM events e JOIN c_registry r USING (idana, idcentro) {_JOINS}""",
}
ORACLES["flat_features"] = _with(FLAT, f"SELECT {_FLAT_COLUMNS} FROM flat")

_ELAPSED_CODED = _CODED[:-1]
_PICKS_E, _JOINS_E = _coded_join(_ELAPSED_CODED, False)
_ELAPSED_ORDER = """data, src, codiceamd, tipo, codicestitch, codiceatc, quantita, idpasto, descrizionefarmaco,
    sesso, scolarita, statocivile, professione, label, valore"""
ELAPSED = {
    **CLEAN,
    "events": f"SELECT * FROM ({_feature_union('c_', 2)}) SEMI JOIN c_registry USING (idana, idcentro)",
    **{f"k_{c}": _first_seen("events", c, "data, src, idana, idcentro") for c in _ELAPSED_CODED},
    "coded": f"""SELECT e.idana, e.idcentro, e.data, e.src, {_PICKS_E}, coalesce(e.quantita, -1) AS quantita,
        coalesce(e.idpasto, -1) AS idpasto, CAST(sesso = 'F' AS INTEGER) AS sesso,
        coalesce(scolarita, -1) AS scolarita, coalesce(statocivile, -1) AS statocivile,
        coalesce(professione, -1) AS professione, CAST(label AS INTEGER) AS label,
        CASE txt WHEN 'N' THEN 0 WHEN 'P' THEN 1 WHEN 'S' THEN 2 ELSE -1 END AS valore
        FROM events e JOIN c_registry r USING (idana, idcentro) {_JOINS_E}""",
    "elapsed": f"""SELECT * EXCLUDE (src),
        CAST(coalesce(data - lag(data) OVER (PARTITION BY idana, idcentro ORDER BY {_ELAPSED_ORDER}), 0) AS BIGINT)
          AS days_since_previous,
        count(*) OVER (PARTITION BY idana, idcentro) AS total,
        row_number() OVER (PARTITION BY idana, idcentro ORDER BY {_ELAPSED_ORDER}) AS step FROM coded""",
}
ORACLES["elapsed_decay"] = _with(
    ELAPSED, "SELECT *, round(1 / ln(exp(1) + days_since_previous), 6) AS delta_events FROM elapsed"
)

_LONGEST = f"(SELECT 1.05 * max(coalesce(annodecesso, {AS_OF}) - annonascita) FROM c_registry)"
ORACLES["age_fraction_registry"] = _with(
    CLEAN,
    f"""SELECT idana, idcentro, sesso, annonascita, scolarita, statocivile, professione, label,
    round(CAST((annodecesso - annonascita) / {_LONGEST} AS DOUBLE), 6) AS delta_decesso,
    round(CAST((annoprimoaccesso - annonascita) / {_LONGEST} AS DOUBLE), 6) AS delta_annoprimoaccesso,
    round(CAST((annodiagnosidiabete - annonascita) / {_LONGEST} AS DOUBLE), 6) AS delta_annodiagnosidiabete
    FROM c_registry""",
)
ORACLES["age_fraction_events"] = _with(
    CLEAN,
    f"""SELECT "table", idana, idcentro, round(CAST((data - annonascita) / {_LONGEST} AS DOUBLE), 6) AS delta_data
    FROM ({_dated("c_")}) JOIN c_registry USING (idana, idcentro)""",
)


def _macro_micro(by_split: bool) -> str:
    group = "split" if by_split else ""
    same = "AND k.split = e.split" if by_split else ""
    code = "(SELECT {s} CAST(NULL AS DOUBLE) AS num, {c} AS txt FROM rows)"
    pick = "split," if by_split else ""
    steps = {
        **CLEAN,
        "rows": f"""SELECT e.* REPLACE (coalesce(codiceamd, codiceatc) AS codiceamd), r.sesso, r.label, annonascita,
            annodecesso, annoprimoaccesso, annodiagnosidiabete,
            CASE WHEN {_U_SPLIT} < 0.8 THEN 'train' ELSE 'test' END AS split
            FROM ({_feature_union("c_", 0)}) e JOIN c_registry r USING (idana, idcentro)
            WHERE extra <> 'non-diabete'""",
        "k_amd": _sorted_codes(code.format(s=pick, c="codiceamd"), group),
        "k_stitch": _sorted_codes(code.format(s=pick, c="codicestitch"), group),
        "k_value": _sorted_codes("rows", group),
    }

    def months(c: str) -> str:
        return f"round(CAST(coalesce(({c} - annonascita) / 31.0, -100) AS DOUBLE), 6)"

    def filled(c: str) -> str:
        return f"CAST(coalesce({c}, -100) AS DOUBLE)"

    return _with(
        steps,
        f"""SELECT e.idana, e.idcentro, CASE WHEN extra = '' THEN {months("data")} ELSE -100.0::DOUBLE END AS data,
        (SELECT {filled("max(code)")} FROM k_amd k WHERE k.txt = e.codiceamd {same}) AS codiceamd,
        (SELECT {filled("max(code)")} FROM k_stitch k WHERE k.txt = e.codicestitch {same}) AS codicestitch,
        {filled("quantita")} AS quantita, {filled("idpasto")} AS idpasto,
        CAST(sesso = 'F' AS DOUBLE) AS sesso, {months("annodecesso")} AS annodecesso,
        {months("annoprimoaccesso")} AS annoprimoaccesso, {months("annodiagnosidiabete")} AS annodiagnosidiabete,
        CAST(label AS DOUBLE) AS label, e.split,
        (SELECT {filled("max(code)")} FROM k_value k WHERE (k.num = e.num OR (e.num IS NULL AND k.txt = e.txt))
           {same}) AS valore
        FROM rows e""",
    )


ORACLES["macro_micro_features"] = _macro_micro(False)
ORACLES["macro_micro_per_split"] = _macro_micro(True)

# --- sequences

READINGS = {
    **CLEAN,
    "readings": f"""SELECT idana, idcentro, data, CAST(src AS BIGINT) AS src,
        coalesce(codiceamd, codicestitch, codiceatc, '~') AS code,
        coalesce(txt, CAST(num AS VARCHAR), '~') AS value FROM ({_feature_union("c_", 0)})""",
    "lengths": "SELECT idana, idcentro, count(*) AS history_len FROM readings GROUP BY 1, 2",
    "caps": """SELECT longest, (SELECT max(p) FROM (SELECT CAST(pow(2, unnest(range(1, 40))) AS BIGINT) AS p)
          WHERE p < longest OR p = 2) AS cap FROM (SELECT max(history_len) AS longest FROM lengths)""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY idana, idcentro ORDER BY data, src, code, value) AS rn,
        count(*) OVER (PARTITION BY idana, idcentro) AS n FROM readings""",
}
ORACLES["sequence_lengths"] = _with(READINGS, "SELECT * FROM lengths")
ORACLES["sequence_cap"] = _with(
    READINGS,
    "SELECT longest, cap, (SELECT count(*) FROM lengths WHERE history_len > cap) AS n_over FROM caps",
)
ORACLES["keep_last_steps"] = _with(
    READINGS,
    """SELECT idana, idcentro, data, src, code, value, rn - greatest(n - cap, 0) AS step
    FROM ordered, caps WHERE rn > n - cap""",
)
ORACLES["drop_first_steps"] = _with(
    READINGS,
    """SELECT idana, idcentro, data, src, code, value, CASE WHEN n > cap THEN rn - cap ELSE rn END AS step
    FROM ordered, caps WHERE n <= cap OR rn > cap""",
)
_FLAT_ORDER = """data, extra, codiceamd, tipo, codicestitch, codiceatc, quantita, idpasto, descrizionefarmaco,
    sesso, scolarita, statocivile, professione, label, valore"""


_FLAT_VECTOR = """codiceamd tipo extra codicestitch codiceatc quantita idpasto descrizionefarmaco
    sesso scolarita statocivile professione valore""".split()


def _arrays(columns: list[str], length: str, pad_value: int, part_steps: int = 4096) -> str:
    """What _described tells of `kept` (a row per event kept: place from 0, n events kept, label), padded to
    `length` in front and cut into parts of `part_steps` places."""
    tenths = [f"{j} * CAST(round(CAST(CAST({c} AS FLOAT) AS DOUBLE) * 10) AS BIGINT)" for j, c in enumerate(columns, 1)]
    width, weights = len(columns), sum(range(1, len(columns) + 1))
    return f"""patients AS (
          SELECT idana, idcentro, CAST(any_value(label) AS BIGINT) AS label, CAST({length} - any_value(n) AS BIGINT) AS pad,
            CAST({length} AS BIGINT) AS length FROM kept GROUP BY idana, idcentro),
        parts AS (
          SELECT *, greatest(least(pad - part * {part_steps}, {part_steps}), 0) AS pads FROM (
            SELECT *, unnest(range(0, CAST(ceil(length / {part_steps}) AS BIGINT))) AS part FROM patients)),
        steps AS (
          SELECT kept.*, place + pad AS spot, {" + ".join(columns)} AS total, {" + ".join(tenths)} AS dot
          FROM kept JOIN patients USING (idana, idcentro)),
        summed AS (
          SELECT idana, idcentro, spot // {part_steps} AS part, count(*) AS n, sum(total) AS total,
            sum((spot % {part_steps} + 1) * dot) AS dot FROM steps GROUP BY ALL),
        described AS (
          SELECT idana, idcentro, part, label, pads + coalesce(n, 0) AS n_steps, {width} * (pads + coalesce(n, 0)) AS n_entries,
            round(coalesce(total, 0) + {pad_value}.0 * {width} * pads, 2) AS total,
            CAST(coalesce(dot, 0) + pads * (pads + 1) // 2 * {10 * pad_value * weights} AS BIGINT) AS in_order
          FROM parts LEFT JOIN summed USING (idana, idcentro, part))"""


def _flat_ordered(flat: dict[str, str]) -> dict[str, str]:
    return {
        **flat,
        "ordered": f"""SELECT *, row_number() OVER (PARTITION BY idana, idcentro ORDER BY {_FLAT_ORDER}) AS rn,
            count(*) OVER (PARTITION BY idana, idcentro) AS total_n FROM flat""",
        "caps": READINGS["caps"].replace("lengths", "(SELECT max(total_n) AS history_len FROM ordered)"),
    }


def _flat_arrays(flat: dict[str, str], cap: str, length: str, part_steps: int = 4096) -> str:
    kept = f"""SELECT *, rn - 1 - greatest(total_n - {cap}, 0) AS place, least(total_n, {cap}) AS n FROM ordered
        WHERE rn > total_n - {cap}"""
    arrays = _arrays(_FLAT_VECTOR, length, -200, part_steps)
    return _with({**_flat_ordered(flat), "kept": kept}, "SELECT * FROM described").replace(
        "SELECT * FROM described", f"SELECT * FROM (WITH {arrays} SELECT * FROM described)"
    )


_LONGEST_KEPT = "(SELECT max(total_n) FROM ordered)"
ORACLES["flat_sequences"] = _flat_arrays(FLAT, "(SELECT cap FROM caps)", "any_value(n)")
ORACLES["left_pad"] = _flat_arrays(FLAT, _LONGEST_KEPT, _LONGEST_KEPT)
ORACLES["left_pad_parts"] = _flat_arrays(FLAT, _LONGEST_KEPT, _LONGEST_KEPT, 7)
_BALANCED_FLAT = {**BALANCED} | {
    k: v.replace("c_registry", "b_registry").replace(" c_", " b_") for k, v in FLAT.items() if k not in CLEAN
}
ORACLES["balanced_sequences"] = _flat_arrays(
    _BALANCED_FLAT, "(SELECT cap FROM caps)", f"least((SELECT cap FROM caps), {_LONGEST_KEPT})"
)


def _elapsed_arrays(length: int) -> str:
    vector = [c for c in _FLAT_VECTOR if c != "extra"]
    kept = f"""SELECT *, step - 1 - greatest(total - {length}, 0) AS place, least(total, {length}) AS n
        FROM elapsed WHERE step > total - {length}"""
    arrays = _arrays(vector, str(length), -100, length).replace("SELECT kept.*,", "SELECT kept.* EXCLUDE (total),")
    sums = """SELECT idana, idcentro, round(sum(CAST(1 / ln(exp(1) + days_since_previous) AS FLOAT)), 3) AS elapsed_sum
        FROM kept GROUP BY idana, idcentro"""
    return _with(
        {**ELAPSED, "kept": kept, "sums": sums},
        f"""SELECT * EXCLUDE (part, label), CAST({length} AS BIGINT) AS n_elapsed, CAST({length} AS BIGINT) AS n_labels
        FROM (WITH {arrays} SELECT * FROM described) JOIN sums USING (idana, idcentro)""",
    )


ORACLES["elapsed_last_512"] = _elapsed_arrays(512)
ORACLES["elapsed_last_16"] = _elapsed_arrays(16)
ORACLES["batch_ids"] = _with(
    raw("registry"),
    """SELECT idana, idcentro, CAST(floor((row_number() OVER (ORDER BY idana, idcentro) - 1)
      / ceil(n / floor(n / 7))) AS BIGINT) AS batch_id FROM registry, (SELECT count(*) AS n FROM registry)""",
)

# --- texts


def _values(pairs: dict[str, str], columns: str) -> str:
    quoted = {k: v.replace("'", "''") for k, v in pairs.items()}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in quoted.items()) + f") v({columns})"


def _word(expression: str) -> str:
    return f"coalesce(translate(CAST({expression} AS VARCHAR), '=(),''', ' '), '[UNK]')"


def _say(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws(' ', " + ", ".join(f"'{name}', {_word(column)}" for name, column in pairs) + ")"


_HEADINGS = {
    "diagnosi": "diagnosis",
    "labs": "exam parameter",
    "labs_calc": "exam parameter calculated",
    "instrumental": "exam strumental",
    "rx_drug": "prescription diabete drugs",
    "rx_other": "prescription diabete not drugs",
    "rx_nondiab": "prescription not diabete",
}
_SAY_REGISTRY = _say(
    [
        ("idcenter", "idcentro"),
        ("sex", "sesso"),
        ("yeardiagnosisdiabetes", "annodiagnosidiabete"),
        ("levelofeducation", "scolarita"),
        ("maritalstatus", "statocivile"),
        ("profession", "professione"),
        ("yearofbirth", "annonascita"),
        ("yearfirstaccess", "annoprimoaccesso"),
        ("yearofdeath", "annodecesso"),
    ]
)


def _said(name: str) -> str:
    if name == "rx_drug":
        pairs = [
            ("date", "data"),
            ("atccode", "codiceatc"),
            ("meaning", "atc_nome"),
            ("quantity", "quantita"),
            ("idmeal", "idpasto"),
            ("drugdescription", "descrizionefarmaco"),
        ]
        return f"SELECT idana, idcentro, data, codiceatc AS code, {_say(pairs)} AS line FROM c_rx_drug LEFT JOIN atc USING (codiceatc)"
    stitch = [("stitchcode", "codicestitch")] if name == "labs_calc" else []
    pairs = [("date", "data"), ("amdcode", "codiceamd"), *stitch, ("meaning", "meaning"), ("value", "valore")]
    return f"SELECT idana, idcentro, data, codiceamd AS code, {_say(pairs)} AS line FROM c_{name} LEFT JOIN amd USING (codiceamd)"


_BLOCKS = ", ".join(
    f"""'{heading}', (SELECT string_agg(line, ' ' ORDER BY data DESC, coalesce(code, ''), line) FROM said_{name} s
      WHERE s.idana = r.idana AND s.idcentro = r.idcentro)"""
    for name, heading in _HEADINGS.items()
)
TEXT = {
    **CLEAN,
    "amd": _values(AMD_MEANINGS, "codiceamd, meaning"),
    "atc": _values(ATC_NAMES, "codiceatc, atc_nome"),
    **{f"said_{n}": _said(n) for n in _HEADINGS},
    "texts": f"""SELECT idana, idcentro, CAST(0 AS BIGINT) AS part,
        concat_ws(' ', 'patientregistry', {_SAY_REGISTRY}, {_BLOCKS}) AS text, CAST(label AS BIGINT) AS label
        FROM c_registry r""",
}
ORACLES["history_text"] = _with(TEXT, "SELECT idana, idcentro, part, text, label FROM texts")
ORACLES["history_text_head"] = _with(
    TEXT, "SELECT idana, idcentro, part, label, array_to_string(string_split(text, ' ')[1:512], ' ') AS text FROM texts"
)
ORACLES["longest_texts"] = """SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM documents
    ORDER BY n_words DESC, doc_id LIMIT 100"""

# --- metrics

PREDICTIONS = {
    "p": f"""SELECT doc_id, quality AS truth, toxic AS truth_toxic, {u("score", "doc_id")} * 1.4 - 0.2 AS score,
        {u("score2", "doc_id")} AS score2 FROM labels"""
}
ORACLES["binary_metrics"] = _with(
    {
        **PREDICTIONS,
        "c": """SELECT count(*) FILTER (score >= 0.5 AND truth = 1) AS tp,
            count(*) FILTER (score < 0.5 AND truth <> 1) AS tn, count(*) FILTER (score >= 0.5 AND truth <> 1) AS fp,
            count(*) FILTER (score < 0.5 AND truth = 1) AS fn, count(*) AS n,
            min(score) AS lo, max(score) AS hi FROM p""",
    },
    """SELECT tp, tn, fp, fn, tp + tn AS n_correct, fp + fn AS n_wrong, n AS n_total,
    round((tp + tn) / n, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
    round(lo, 6) AS min_score, round(hi, 6) AS max_score FROM c""",
)
ORACLES["argmax_accuracy"] = _with(
    PREDICTIONS, "SELECT round(avg(CASE WHEN (score2 > score) = (truth = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p"
)


def _pairs_auc(rows: str) -> str:
    """Share of (positive, negative) pairs in the right order, by counting pairs."""
    return f"""(SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)
        FROM {rows} a, {rows} b WHERE a.truth = 1 AND b.truth = 0)"""


ORACLES["auc"] = _with(PREDICTIONS, f"SELECT round({_pairs_auc('p')}, 6) AS auc")
ORACLES["auc_micro_macro"] = _with(
    {
        **PREDICTIONS,
        "second": "SELECT score2 AS score, truth_toxic AS truth FROM p",
        "pooled": "SELECT score, truth FROM p UNION ALL SELECT score, truth FROM second",
    },
    f"""SELECT round({_pairs_auc("pooled")}, 6) AS auc_micro,
    round(({_pairs_auc("p")} + {_pairs_auc("second")}) / 2, 6) AS auc_macro""",
)

# --- files: what comes back is what was written ---------------------------------------------------

ORACLES["csv_documents"] = "SELECT doc_id, n_chars, lang, source, md5(text) AS text_md5 FROM documents"
ORACLES["csv_raw_events"] = _with(RAW, " UNION ALL ".join(_all_columns(f"SELECT * FROM {n}", n) for n in EVENTS))
# Stored registries have their stage's types: numbers are doubles.
_YEARS = ["annonascita", "annodecesso", "annoprimoaccesso", "annodiagnosidiabete"]
_PERSONAL = ["scolarita", "statocivile", "professione"]


def _doubles(table: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM {table}"


ORACLES["csv_raw_registry"] = _with(raw("registry"), _doubles("registry", [*_YEARS, *_PERSONAL, "origine"]))
ORACLES["committed_clean_csv"] = _with(CLEAN, _doubles("c_registry", _PERSONAL))
ORACLES["committed_clean"] = _with(CLEAN, " UNION ALL ".join(_all_columns(f"SELECT * FROM c_{n}", n) for n in EVENTS))
for _name, _same in {
    "funnel_from_writes": "funnel_rows_per_table",
    "committed_balanced": "balanced_events",
    "committed_age_fractions": "age_fraction_events",
    "committed_features": "flat_features",
    "committed_texts": "history_text",
}.items():
    ORACLES[_name] = ORACLES[_same]

ORACLES["split_sizes_exact"] = _with(
    raw("registry"),
    f"""SELECT idana, idcentro, CASE WHEN place <= round(0.6 * n) THEN 'train'
      WHEN place <= round(0.6 * n) + round(0.3 * n) THEN 'test' ELSE 'val' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY {_U_SPLIT}, idana, idcentro) AS place, count(*) OVER () AS n FROM registry)""",
)
ORACLES["checked_labels"] = _with(CLEAN, "SELECT idana, idcentro, label FROM c_registry")
ORACLES["checked_numbers"] = ORACLES["flat_features"]
ORACLES["bucketed_plausible_events"] = ORACLES["plausible_events"]
ORACLES["bucketed_timeline_stats"] = ORACLES["event_timeline_stats"]
ORACLES["patients_per_code_kept"] = ORACLES["patients_per_code"]
_CODED = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", {c} AS code, idana, idcentro FROM {n} WHERE {c} IS NOT NULL" for n, c in _CODE_OF.items()
)
ORACLES["patients_per_table_and_class"] = _with(
    {**RAW, "coded": _CODED},
    """SELECT 'code' AS kind, substr(code, 1, 4) AS "value", count(DISTINCT (idana, idcentro)) AS n_patients FROM coded GROUP BY 2
    UNION ALL SELECT 'table', "table", count(DISTINCT (idana, idcentro)) FROM coded GROUP BY 2""",
)
