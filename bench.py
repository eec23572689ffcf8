"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from vitaline.plans import stages  # noqa: E402
from vitaline.plans.catalog import QUERIES  # noqa: E402
from vitaline.session import forget, tune  # noqa: E402

HEADLINE = [
    "label_cohort",
    "label_after_repair",
    "cohort_rows_per_table",
    "daily_rollup",
    "history_span_filter",
    "plausible_events",
    "fill_group_mean",
    "fill_weighted",
    "null_profile",
    "patients_per_code",
    "histogram_per_code",
    "truncate_negative",
    "leakage_removed",
    "undersample",
    "oversample_events",
    "split_patients",
    "flat_features",
    "elapsed_decay",
    "age_fraction_events",
    "macro_micro_features",
    "keep_last_steps",
    "flat_sequences",
    "elapsed_last_512",
    "history_text",
    "longest_texts",
    "auc",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vitaline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    if "spark.checkpoint.dir" not in dict(spark.sparkContext.getConf().getAll()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitaline-bench-"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm up

    def write(name):
        # every column of every row is computed, none is kept
        return lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    if not names:
        seconds["stage_clean"] = timed(lambda: stages.clean(spark, sf_dir))
        seconds["stage_balanced"] = timed(lambda: stages.balanced(spark, sf_dir))
    else:
        stages.clean(spark, sf_dir)
    for name in names or HEADLINE:
        seconds[name] = timed(write(name))
    patients = stages.clean(spark, sf_dir).registry.count()
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
        "clean_patients": patients,
    }
    if "history_text" in seconds:
        line["history_text_patients_per_sec"] = round(patients / seconds["history_text"], 1)
    print(json.dumps(line))
    forget(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
