"""What the sizing of jobs saved, per job and per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions.jobs import step_of
from jobscope.scale import attach, one_value
from jobscope.session import as_written

# fixed value: dollars per GB and hour
RATE = 0.0013


def _category() -> Column:
    status = F.substring("status", 1, 3)
    tag = (
        F.when(status == "COM", "")
        .when(status.startswith("OO"), F.concat(F.lit("-"), F.substring(status, 3, 1)))
        .otherwise(F.concat(F.lit("-"), status))
    )
    last4 = F.expr("right(cast(job_id as string), 4)")
    return F.concat(step_of(F.col("flag")), F.lit("-"), last4, tag)


def _floor0(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast("bigint"))


def _to_top(df: DataFrame, run: Sequence[str], default: str, out: str) -> DataFrame:
    if not run:
        return df.withColumn(out, one_value(df, F.max(default)) - F.col(default))
    top = df.groupBy(*run).agg(F.max(default).alias("_top"))
    # one row per run: written first, so that a small table is broadcast
    return attach(df, as_written(top), run).withColumn(out, F.col("_top") - F.col(default)).drop("_top")


def savings_mem(ledger: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Memory used, wasted and saved per job of a run."""
    margin = 2 * F.col("extra_mem")
    rows = ledger.select(
        "job_id", *run,
        _category().alias("category"),
        _floor0(F.col("mem_used") + margin).alias("used"),
        _floor0(F.col("mem_alloc") - F.col("mem_used") - margin).alias("wasted"),
        _floor0(F.col("mem_default") - F.col("mem_alloc")).alias("saved2"),
        _floor0(F.col("mem_default")).alias("default_mem"),
    )
    return _to_top(rows, run, "default_mem", "saved1")


def savings_time(ledger: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Core-minutes used, wasted and saved per job of a run."""
    core = F.col("core")
    rows = ledger.select(
        "job_id", *run,
        _category().alias("category"),
        _floor0(F.col("min_used") * core).alias("used"),
        _floor0((F.col("min_alloc") - F.col("min_used")) * core).alias("wasted"),
        _floor0((F.col("min_default") - F.col("min_alloc")) * core).alias("saved"),
        _floor0(F.col("min_default") * core).alias("default_time"),
    )
    return _to_top(rows, run, "default_time", "to_top")


def savings_cost(usage: DataFrame, savings: DataFrame, default_mem: int = 4096) -> DataFrame:
    """Dollars saved per job; usage as given by usage_vs_request, savings by savings_mem."""
    per_job = usage.groupBy("job_id").agg(
        F.max("saved_mb").alias("_saved"), F.max("mem_mb").alias("_used"), F.count(F.lit(1)).alias("minutes")
    )

    def dollars(mb: Column) -> Column:
        return F.lit(RATE) * mb / 1024 * F.col("minutes") / 60

    return per_job.select(
        "job_id",
        "minutes",
        dollars(F.col("_saved")).alias("job_dynamic"),
        dollars(default_mem - F.col("_used")).alias("job_split"),
        dollars(one_value(savings, F.sum("saved2"))).alias("run_dynamic"),
        dollars(one_value(savings, F.sum("saved1"))).alias("run_split"),
    )
