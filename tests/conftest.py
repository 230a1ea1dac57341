import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def t(spark, sf):
    from jobscope.plans.views import Tables

    return Tables(spark, sf)


@pytest.fixture
def same():
    """Assert that two frames hold the same rows."""

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        key = lambda r: tuple((x is None, str(x)) for x in r)
        left = sorted((tuple(r) for r in a.select(*cols).collect()), key=key)
        right = sorted((tuple(r) for r in b.select(*cols).collect()), key=key)
        assert len(left) == len(right)
        assert left == right
        assert left

    return check
