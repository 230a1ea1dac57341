"""Writers: appends and partition overwrites, never a rewrite of a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_ledger(df: DataFrame, path: str, by: str = "day") -> None:
    """Append admitted rows, partitioned by finish ``day`` or ``month``.

    The rebalance hint gathers a date's rows into few files and splits a busy
    date over several writers.
    """
    pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[by]
    rows = df.withColumn("finish_date", F.date_format("finish_ts", pattern))
    rows.hint("rebalance", "finish_date").write.mode("append").partitionBy("finish_date").parquet(path)


def write_models(models: DataFrame, path: str) -> None:
    """Replace the models of the keys in ``models``; other keys stay."""
    models.repartition("program", "ref").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("program", "ref").parquet(path)


def write_weekly_report(report: DataFrame, path: str, end: dt.date) -> None:
    """Report under year and week-ending date; a second run replaces the week."""
    report.withColumns({"year": F.lit(end.year), "week_ending": F.lit(end.isoformat())}).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("year", "week_ending").parquet(path)
