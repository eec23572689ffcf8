"""Registered queries: each takes a session and a data folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline import config
from vitaline.config import KEY, SEED
from vitaline.functions.hashing import hash_uniform
from vitaline.operators import (
    balance,
    cohort,
    distinct,
    features,
    history,
    label,
    leakage,
    metrics,
    profile,
    quality,
    repair,
    reports,
    sequences,
    skew,
    timeline,
)
from vitaline.operators.timeline import union_all
from vitaline.plans import clean, prepare, stages
from vitaline.session import cut, new_folder, tune
from vitaline.sources.bucketed import write_bucketed
from vitaline.sources.commits import write_frame
from vitaline.sources.derived import amd_codes, atc_codes, source
from vitaline.sources.quoted_csv import read_quoted_csv
from vitaline.sources.tables import (
    Tables,
    read_age_fraction_tables,
    read_amd_codes,
    read_features,
    read_tables,
    read_texts,
    text_records,
    write_age_fraction_tables,
    write_features,
    write_tables,
    write_texts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _long(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("long") for n in names}


def _dates_by_table(tables: Tables) -> DataFrame:
    return timeline.union_all(
        [df.select(F.lit(n).alias("table"), *KEY, "data") for n, df in tables.events().items()]
    )


# --- cohort, timeline, label ---------------------------------------------------------------------


@query
def label_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    histories = label.histories_of_events(t)
    return label.label_from_histories(t.registry, histories, min_span_days=None).select(*KEY, "label")


@query
def label_of_cohort_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.cohort(spark, sf_dir)
    return label.label_recent_event(t.registry, timeline.event_timeline(t), t.diagnosi).select(*KEY, "label")


@query
def label_after_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.choose_patients(stages.raw(spark, sf_dir)).labelled.select(*KEY, "label")


@query
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_counts(label_cohort(spark, sf_dir))


@query
def patient_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.patient_funnel(clean.choose_patients(stages.raw(spark, sf_dir)))


@query
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return cohort.key_overlap(t.registry, t.diagnosi)


@query
def cohort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_keys(stages.raw(spark, sf_dir).diagnosi)


@query
def cohort_rows_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stages.raw(spark, sf_dir)
    return reports.funnel_report({"0 raw": raw, "1 cohort": cohort.cohort_by_codes(raw)})


@query
def event_timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = timeline.first_last(timeline.event_timeline(stages.raw(spark, sf_dir)))
    return stats.withColumns(_long("span_days"))


@query
def event_timeline_without_rx(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = timeline.first_last(timeline.event_timeline(stages.raw(spark, sf_dir), with_rx=False))
    return stats.withColumns(_long("span_days"))


@query
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.daily_rollup(stages.raw(spark, sf_dir))


@query
def event_day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = timeline.day_gaps(timeline.event_timeline(stages.raw(spark, sf_dir)))
    return gaps.withColumns(_long("days_since_previous"))


@query
def stream_day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    events = source(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return timeline.day_gaps(events, ["user_id"], "day").withColumns(_long("days_since_previous"))


@query
def first_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_patients(stages.raw(spark, sf_dir).registry, 500).select(*KEY)


@query
def history_span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return timeline.history_longer_than(timeline.event_timeline(t))


@query
def history_span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return reports.table_rows(timeline.filter_by_history_span(t, timeline.event_timeline(t)), "3 span")


@query
def min_two_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_min_events(timeline.event_timeline(stages.raw(spark, sf_dir)))


@query
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    problems = cohort.with_codes(t.diagnosi)
    return timeline.last_event(timeline.event_timeline(t)).join(
        timeline.last_event(problems, "last_problem"), KEY
    )


# --- registry dates ------------------------------------------------------------------------------


@query
def registry_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.registry_probes(repair.type_registry_years(stages.raw(spark, sf_dir).registry))


@query
def repair_first_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.cohort(spark, sf_dir)
    firsts = timeline.first_event(timeline.event_timeline(t))
    filled = repair.fill_first_access(repair.type_registry_years(t.registry), firsts)
    return filled.select(*KEY, "annoprimoaccesso")


@query
def repair_diabetes_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.cohort(spark, sf_dir)
    repaired = repair.repair_registry_dates(t.registry, timeline.event_timeline(t))
    return repaired.select(*KEY, "annonascita", "annodecesso", "annoprimoaccesso", "annodiagnosidiabete")


@query
def plausible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    registry = repair.type_registry_years(t.registry)
    return _dates_by_table(t.map_events(lambda df: repair.plausible_events(df, registry)))


@query
def bucketed_plausible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    kept = write_bucketed(t.replace(registry=repair.type_registry_years(t.registry)))

    def plausible(part: Tables) -> DataFrame:
        return _dates_by_table(part.map_events(lambda df: repair.plausible_events(df, part.registry)))

    return kept.per_patient(plausible)


@query
def bucketed_timeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = write_bucketed(stages.raw(spark, sf_dir))
    stats = kept.per_patient(lambda part: timeline.first_last(timeline.event_timeline(part)))
    return stats.withColumns(_long("span_days"))


# --- values --------------------------------------------------------------------------------------


@query
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    calculated = quality.out_of_range_report(t.labs_calc, config.STITCH_RANGES, "codicestitch")
    return quality.out_of_range_report(t.labs).unionByName(calculated)


@query
def clip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clip_by_code(stages.raw(spark, sf_dir).labs)


@query
def clip_stream_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    ranges = {"view": (2.0, 40.0), "click": (5.0, 60.0)}
    events = source(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return quality.clip_by_code(events, ranges, "event_type", "value")


@query
def clip_calculated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return quality.clip_by_code(t.labs_calc, config.STITCH_RANGES, "codicestitch")


@query
def override_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.override_values(stages.raw(spark, sf_dir).diagnosi)


@query
def fill_mode_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fill_by_code(stages.raw(spark, sf_dir).instrumental)


@query
def drop_null_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_null_by_code(stages.raw(spark, sf_dir).rx_other)


@query
def fill_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return _rounded(quality.fill_group_mean(t.labs, t.registry))


@query
def fill_group_mean_all_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return _rounded(quality.fill_group_mean(t.labs, t.registry, same_code_only=False))


@query
def fill_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fill_weighted(stages.raw(spark, sf_dir).rx_other)


@query
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.value_distribution(stages.raw(spark, sf_dir).rx_other))


@query
def clean_rows_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_rows(stages.clean(spark, sf_dir), "6 clean")


@query
def funnel_rows_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel_report(clean.chained_steps(stages.raw(spark, sf_dir)))


@query
def clean_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.clean(spark, sf_dir).registry


@query
def funnel_from_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recorded_rows(clean.written_steps(stages.raw(spark, sf_dir), new_folder(spark)))


# --- files ---------------------------------------------------------------------------------------


@query
def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, written as CSV and read by blocks."""
    docs, path = source(spark, sf_dir, "documents"), f"{new_folder(spark)}/documents.csv"
    write_frame(docs, path, "csv")
    back = read_quoted_csv(spark, path, docs.schema)
    numbers = [F.col(n).cast("long").alias(n) for n in ("doc_id", "n_chars")]
    return back.select(*numbers, "lang", "source", F.md5("text").alias("text_md5"))


@query
def csv_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_tables(stages.raw(spark, sf_dir), root, "raw", fmt="csv")
    return _all_columns(read_tables(spark, root, "raw", fmt="csv").events())


@query
def csv_raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_tables(stages.raw(spark, sf_dir), root, "raw", fmt="csv")
    return read_tables(spark, root, "raw", fmt="csv").registry


@query
def committed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_tables(stages.clean(spark, sf_dir), root, "clean")
    return _all_columns(read_tables(spark, root, "clean", check="digest").events())


@query
def committed_clean_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a stage comes back from CSV, by the digest taken while it was written."""
    root = new_folder(spark)
    write_tables(stages.clean(spark, sf_dir), root, "clean", fmt="csv")
    return read_tables(spark, root, "clean", fmt="csv", check="digest").registry


@query
def committed_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_tables(stages.balanced(spark, sf_dir), root, "balanced")
    return _all_columns(read_tables(spark, root, "balanced", check="digest").events())


@query
def committed_age_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_age_fraction_tables(features.age_fraction(stages.clean(spark, sf_dir)), root)
    t = read_age_fraction_tables(spark, root, check="digest")
    rows = [df.select(F.lit(n).alias("table"), *KEY, "delta_data") for n, df in t.events().items()]
    return _rounded(timeline.union_all(rows))


@query
def committed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_features(features.flat_features(stages.clean(spark, sf_dir)), root, "flat")
    return _rounded(read_features(spark, root, "flat", fill=None, check="digest"))


@query
def committed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_folder(spark)
    write_texts(history_text(spark, sf_dir), root)
    return read_texts(spark, root, check="digest")


@query
def named_by_code_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the meaning of their code, from a dictionary file: broadcast for one table, as if too wide for the other."""
    t = stages.raw(spark, sf_dir)
    codes = t.diagnosi.select("codiceamd").union(t.labs.select("codiceamd")).where("codiceamd <> 'AMD009'").distinct()
    meaning = F.concat(F.lit('exam, "'), "codiceamd", F.lit('"'))
    path = f"{new_folder(spark)}/amd_codes.csv"
    write_frame(codes.select(F.col("codiceamd").alias("codice"), meaning.alias("meaning")), path, "csv")
    book = read_amd_codes(spark, path)
    named = {
        "diagnosi": skew.lookup(t.diagnosi.select("codiceamd"), book, ["codiceamd"]),
        "labs": skew.lookup(t.labs.select("codiceamd"), book, ["codiceamd"], max_bytes=0),
    }
    counted = [
        df.groupBy("codiceamd", "meaning").agg(F.count("*").alias("n_events")).withColumn("table", F.lit(n)) for n, df in named.items()
    ]
    return union_all(counted)


# --- reports -------------------------------------------------------------------------------------


@query
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.null_profile(dict(stages.raw(spark, sf_dir).items()), "raw")


@query
def null_profile_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.null_profile(dict(stages.clean(spark, sf_dir).items()), "clean")


@query
def null_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return timeline.union_all(
        [
            reports.null_counts(df, ["data"]).select(F.lit(n).alias("table"), F.col("data").alias("n_null"))
            for n, df in t.events().items()
        ]
    )


@query
def null_values_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    names = ["diagnosi", "labs", "instrumental", "rx_other"]
    return timeline.union_all(
        [reports.code_null_report(getattr(t, n)).withColumn("table", F.lit(n)) for n in names]
    )


@query
def null_atc_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    drugs = stages.raw(spark, sf_dir).rx_drug
    return reports.code_null_report(drugs, "descrizionefarmaco", "codiceatc", "n_rows")


@query
def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    columns = {n: "codiceatc" if n == "rx_drug" else "codiceamd" for n in config.EVENT_TABLES}
    return timeline.union_all(
        [
            reports.code_pair_counts(getattr(t, n), c).select(
                F.lit(n).alias("table"), F.col(c).alias("code"), "n_rows"
            )
            for n, c in columns.items()
        ]
    )


@query
def code_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.code_pair_counts(stages.raw(spark, sf_dir).labs_calc, "codicestitch", "codiceamd")


@query
def null_code_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.null_code_in_set(stages.raw(spark, sf_dir).labs_calc)


# --- leakage, balance, splits --------------------------------------------------------------------


@query
def truncate_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    lasts = leakage.last_event_by_label(t.registry, timeline.event_timeline(t))
    return _dates_by_table(leakage.truncate_negative_history(t, lasts))


@query
def strip_positive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    lasts = leakage.last_event_by_label(t.registry, timeline.event_timeline(t))
    return leakage.strip_positive_recent_codes(t.diagnosi, lasts)


@query
def leakage_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    return leakage.remove_leakage(t, timeline.event_timeline(t)).diagnosi


@query
def class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.class_sizes(stages.clean(spark, sf_dir).registry)


@query
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.undersample_registry(stages.clean(spark, sf_dir).registry).select(*KEY, "label")


@query
def undersample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates_by_table(balance.undersample(stages.clean(spark, sf_dir)))


@query
def oversample_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.oversample_registry(stages.clean(spark, sf_dir).registry)


def _all_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """All columns of several event tables in one; measured values as whole thousandths."""
    texts, numbers = ("codiceamd", "codicestitch", "codiceatc", "descrizionefarmaco"), ("quantita", "idpasto")
    parts = []
    for name, df in tables.items():
        columns = [F.lit(name).alias("table"), *[F.col(c) for c in (*KEY, "data")]]
        for kind, wanted in (("string", texts), ("double", numbers)):
            columns += [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c in wanted]
        value = F.col("valore") if "valore" in df.columns else F.lit(None)
        if dict(df.dtypes).get("valore") == "double":
            value = F.round(value * 1000).cast("long")
        parts.append(df.select(*columns, value.cast("string").alias("valore")))
    return union_all(parts)


@query
def oversample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    copies = balance.copies_of(t.registry)
    return _all_columns({n: balance.synthetic_events(df, t.registry, n, copies=copies) for n, df in t.events().items()})


@query
def oversample_events_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    copies = balance.copies_of(t.registry)
    events = t.events().items()
    return _all_columns({n: balance.synthetic_events(df, t.registry, n, exact=True, copies=copies) for n, df in events})


@query
def balanced_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.balanced(spark, sf_dir).registry


@query
def balanced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_columns(stages.balanced(spark, sf_dir).events())


@query
def numbered_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.raw(spark, sf_dir).labs_calc.select(*KEY, "codicestitch")
    numbered = skew.expand_copies(skew.collapse_copies(rows), index="number")
    return numbered.withColumn("duplicated", F.col("number") > 1)


@query
def balanced_rows_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_rows(stages.balanced(spark, sf_dir), "balanced")


@query
def split_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = stages.raw(spark, sf_dir).registry
    return balance.split_patients(registry).select(*KEY, "split")


@query
def split_sizes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = stages.raw(spark, sf_dir).registry
    return balance.split_exactly(registry).select(*KEY, "split")


@query
def checked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.require_two_labels(stages.clean(spark, sf_dir).registry).select(*KEY, "label")


@query
def checked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose values must be numbers once they are encoded."""
    return quality.require_numeric(flat_features(spark, sf_dir))


@query
def split_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = stages.raw(spark, sf_dir).registry
    test = balance.split_patients(registry, config.SPLIT_80_20).filter(F.col("split") == "test")
    return balance.complement(registry, test).select(*KEY)


# --- profiles ------------------------------------------------------------------------------------


@query
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    events = source(spark, sf_dir, "events")
    return profile.histogram_per_code(events, "event_type", "value").withColumns(_long("bin_no"))


@query
def stream_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return profile.value_counts(source(spark, sf_dir, "events"), "event_type")


@query
def age_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.age_groups(stages.raw(spark, sf_dir).registry).withColumns(_long("bin_no"))


@query
def age_groups_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.age_groups(stages.clean(spark, sf_dir).registry).withColumns(_long("bin_no"))


@query
def age_group_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.age_pyramid(stages.raw(spark, sf_dir).registry).withColumns(_long("bin_no"))


@query
def share_by_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.share_by(stages.raw(spark, sf_dir).registry, "idcentro"))


@query
def patients_by_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(stages.raw(spark, sf_dir).registry, "sesso")


def _kept_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    return cut(distinct.patient_bitmaps(t.events(), distinct.patient_numbers(t)))


@query
def patients_per_code_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_patients(_kept_bitmaps(spark, sf_dir), ["table", "code"])


@query
def patients_per_table_and_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with any code of a class (its first four characters) in any table, from the kept bitmaps alone."""
    kept = _kept_bitmaps(spark, sf_dir).withColumn("code_class", F.substring("code", 1, 4))
    per_class = distinct.distinct_patients(kept, ["code_class"]).select(F.lit("code").alias("kind"), F.col("code_class").alias("value"), "n_patients")
    per_table = distinct.distinct_patients(kept, ["table"]).select(F.lit("table").alias("kind"), F.col("table").alias("value"), "n_patients")
    return per_class.unionByName(per_table)


@query
def patients_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    columns = {n: "codiceatc" if n == "rx_drug" else "codiceamd" for n in config.EVENT_TABLES}
    return timeline.union_all(
        [
            profile.patients_per(getattr(t, n), c, ordered=False).select(
                F.lit(n).alias("table"), F.col(c).alias("code"), "n_patients"
            )
            for n, c in columns.items()
        ]
    )


@query
def patients_per_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.patients_per_code(stages.raw(spark, sf_dir).labs_calc, "codicestitch")


@query
def patients_per_code_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.patients_per(stages.raw(spark, sf_dir).labs_calc, "codicestitch", "codiceamd")


@query
def patients_per_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.patients_per(stages.raw(spark, sf_dir).rx_nondiab, "valore")


@query
def wanted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = profile.patients_per_code(stages.raw(spark, sf_dir).diagnosi)
    return profile.pick_codes(counts, config.CARDIO_CODES)


@query
def values_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value frequencies: target codes of the diagnoses, all codes of the two other coded tables."""
    t = stages.raw(spark, sf_dir)
    tables = {"diagnosi": cohort.with_codes(t.diagnosi), "instrumental": t.instrumental, "rx_other": t.rx_other}
    return union_all([profile.values_per_code(df).withColumn("table", F.lit(n)) for n, df in tables.items()])


@query
def histogram_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram_per_code(stages.raw(spark, sf_dir).labs).withColumns(_long("bin_no"))


@query
def histogram_per_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    calculated = stages.raw(spark, sf_dir).labs_calc
    return profile.histogram_per_code(calculated, "codicestitch").withColumns(_long("bin_no"))


# --- features ------------------------------------------------------------------------------------


@query
def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.flat_features(stages.clean(spark, sf_dir)))


@query
def encode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.raw(spark, sf_dir)
    events = features.event_rows(t, config.FEATURE_ORDER, config.FLAT_KIND, config.FLAT_EXTRA)
    order = ["src", "data", *KEY]
    return features.first_seen_codes(events, features.CODE_COLUMNS, order)


@query
def encode_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = features.event_rows(stages.raw(spark, sf_dir), config.MACRO_MICRO_ORDER)
    values = events.select(
        F.col("valore_num").isNull().cast("int").alias("is_text"),
        F.col("valore_num").alias("num"),
        F.col("valore_txt").alias("txt"),
    ).filter(F.col("num").isNotNull() | F.col("txt").isNotNull())
    return features.sorted_codes(values)


@query
def elapsed_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.elapsed_features(stages.clean(spark, sf_dir))).withColumns(
        _long("days_since_previous", "step", "total")
    )


@query
def age_fraction_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.age_fraction(stages.clean(spark, sf_dir)).registry)


@query
def age_fraction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.age_fraction(stages.clean(spark, sf_dir))
    return _rounded(
        timeline.union_all(
            [df.select(F.lit(n).alias("table"), *KEY, "delta_data") for n, df in t.events().items()]
        )
    )


@query
def macro_micro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.macro_micro_features(stages.clean(spark, sf_dir)))


@query
def macro_micro_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    return _rounded(features.macro_micro_features(t, per_split=True, ordered=False))


# --- sequences -----------------------------------------------------------------------------------


def _readings(tables: Tables) -> DataFrame:
    """A narrow event table whose order inside a patient is plain: date, table, code, value."""
    events = features.event_rows(tables)
    value = F.coalesce(F.col("valore_txt"), F.col("valore_num").cast("string"), F.lit("~"))
    code = F.coalesce("codiceamd", "codicestitch", "codiceatc", F.lit("~"))
    return events.select(*KEY, "data", "src", code.alias("code"), value.alias("value"))


def _cap(tables: Tables) -> Column:
    return sequences.sequence_cap(sequences.table_lengths(tables)).select("cap").scalar()


@query
def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.history_lengths(_readings(stages.clean(spark, sf_dir)))


@query
def sequence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = sequences.table_lengths(stages.clean(spark, sf_dir))
    capped = sequences.sequence_cap(lengths)
    over = sequences.over_cap(lengths, capped.select("cap").scalar())
    return capped.withColumn("n_over", over.scalar())


@query
def keep_last_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    steps = sequences.steps_of(sequences.distinct_events(_readings(t)), ["src", "code"], _cap(t))
    return steps.select(*KEY, "data", "src", "code", "value", "step").withColumns(_long("src"))


@query
def drop_first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    events = sequences.distinct_events(_readings(t))
    steps = sequences.steps_of(events, ["src", "code"], _cap(t), "drop_first_k")
    return steps.select(*KEY, "data", "src", "code", "value", "step").withColumns(_long("src"))


# Entries of a step vector: the flat features without patient, label and date; those of elapsed time have no `extra`.
FLAT_WIDTH, ELAPSED_WIDTH = 13, 12


def _described(arrays: DataFrame, width: int = FLAT_WIDTH) -> DataFrame:
    """Arrays of step vectors of `width` entries (one row a patient and part) told by their length and by sums, one of
    them weighted by place and column. Steps are summed as rows, in compiled code."""
    key = [c for c in arrays.columns if c in (*KEY, "part")]
    others = [c for c in arrays.columns if c not in (*key, "steps")]
    steps = arrays.select(*key, *others, F.posexplode_outer("steps").alias("_place", "_step"))
    entries = [F.col("_step")[j].cast("double") for j in range(width)]
    zero = F.lit(0).cast("long")

    def tenths(x: Column) -> Column:  # half away from zero
        return (F.signum(x) * F.floor(F.abs(x * 10) + 0.5)).cast("long")

    total = reduce(add, entries)
    in_order = reduce(add, [tenths(x) * (j + 1) for j, x in enumerate(entries)]) * (F.col("_place") + 1)
    return steps.groupBy(*key).agg(
        *[F.any_value(c).alias(c) for c in others],
        F.count("_place").alias("n_steps"),
        F.coalesce(F.sum(F.array_size("_step").cast("long")), zero).alias("n_entries"),
        F.round(F.coalesce(F.sum(total), F.lit(0.0)), 2).alias("total"),
        F.coalesce(F.sum(in_order), zero).alias("in_order"),
    )


@query
def flat_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    arrays = sequences.flat_sequences(features.flat_features(t), _cap(t)).withColumns(_long("part", "label"))
    return _described(arrays)


def _padded(tables: Tables, part_steps: int) -> DataFrame:
    longest = sequences.sequence_cap(sequences.table_lengths(tables)).select("longest").scalar()
    rows = features.flat_features(tables)
    arrays = sequences.flat_sequences(rows, pad_to=longest, part_steps=part_steps)
    return _described(arrays.withColumns(_long("part", "label")))


@query
def left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(stages.clean(spark, sf_dir), sequences.PART_STEPS)


@query
def left_pad_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(stages.clean(spark, sf_dir), 7)


@query
def balanced_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(prepare.sequence_inputs(stages.balanced(spark, sf_dir)).withColumns(_long("part", "label")))


def _elapsed(tables: Tables, length: int) -> DataFrame:
    arrays = sequences.elapsed_sequences(features.elapsed_rows(features.elapsed_events(tables)), length)
    summed = F.aggregate("elapsed", F.lit(0.0), lambda a, x: a + x)
    return _described(
        arrays.withColumns(
            {
                "elapsed_sum": F.round(summed, 3),
                "n_elapsed": F.size("elapsed").cast("long"),
                "n_labels": F.size("labels").cast("long"),
            }
        ).drop("elapsed", "labels"),
        ELAPSED_WIDTH,
    )


@query
def elapsed_last_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elapsed(stages.clean(spark, sf_dir), 512)


@query
def elapsed_last_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elapsed(stages.clean(spark, sf_dir), 16)


@query
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = stages.raw(spark, sf_dir).registry
    n_batches = F.floor(registry.agg(F.count(F.lit(1))).scalar() / 7)
    return sequences.batch_ids(registry.select(*KEY), n_batches)


# --- texts ---------------------------------------------------------------------------------------


@query
def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    return history.history_text(t, amd_codes(spark), atc_codes(spark)).withColumns(_long("part", "label"))


@query
def history_text_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stages.clean(spark, sf_dir)
    texts = history.history_text(t, amd_codes(spark), atc_codes(spark), max_words=512)
    return text_records(texts.withColumns(_long("label", "part")))


@query
def longest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    return history.longest_texts(docs, 100, position="doc_id").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words")
    )


# --- metrics -------------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    score = hash_uniform(SEED, "score", F.col("doc_id"))
    return source(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").alias("truth"),
        F.col("toxic").alias("truth_toxic"),
        (score * 1.4 - 0.2).alias("score"),
        hash_uniform(SEED, "score2", F.col("doc_id")).alias("score2"),
    )


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_predictions(spark, sf_dir)))


@query
def argmax_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.argmax_accuracy(_predictions(spark, sf_dir), ["score", "score2"]))


@query
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc(_predictions(spark, sf_dir)))


@query
def auc_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = {"score": "truth", "score2": "truth_toxic"}
    return _rounded(metrics.auc_micro_macro(_predictions(spark, sf_dir), classes))
