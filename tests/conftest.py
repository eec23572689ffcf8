from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


def make_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("vitaline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vitaline.session import tune

    return tune(spark)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    from vitaline.session import forget

    forget(session)
    session.stop()


@pytest.fixture(autouse=True)
def interpret_small_plans(request, spark):
    """Hand-made rows are too few to be worth compiling plans for; registered queries run compiled."""
    compiled = "test_registered" in request.node.nodeid
    spark.conf.set("spark.sql.codegen.wholeStage", str(compiled).lower())
    yield
