"""Registry of queries: name -> (function of Tables, SQL of the other engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.plans.views import Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn

    return add


def r6(df: DataFrame) -> DataFrame:
    """Round doubles to six places: the engines differ in the last digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
