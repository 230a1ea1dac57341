"""Partition choice and retry sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: a policy names at most this many partitions
MAX_PARTITIONS = 20


def policy_rows(policy: DataFrame) -> list:
    """Policy rows by ordinal. A policy is configuration: more rows are an error."""
    rows = policy.orderBy("ordinal").limit(MAX_PARTITIONS + 1).collect()
    if len(rows) > MAX_PARTITIONS:
        raise ValueError(f"a partition policy has at most {MAX_PARTITIONS} rows")
    return [r for r in rows if r["name"]]


def _clip(value: Column, limit: int | None) -> Column:
    return value if limit is None else F.least(value, F.lit(limit).cast("bigint"))


def assign_partition(
    jobs: DataFrame,
    policy: DataFrame,
    mem: str = "mem",
    minutes: str = "minutes",
    partition: str = "partition_name",
    hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Partition for each job, with memory and time clipped to its limits.

    A named special partition is kept. Otherwise the first general partition
    whose time limit holds the job is taken, else the last one. The policy
    becomes a chain of conditions, so there is no join and it also runs on
    streams. ``hook`` replaces the rule by the site's own.
    """
    if hook is not None:
        return hook(jobs)
    rows = policy_rows(policy)
    general = [r for r in rows if r["kind"] == "general"]
    special = [r for r in rows if r["kind"] == "special"]
    m, t, p = F.col(mem), F.col(minutes), F.col(partition)

    def target(r) -> Column:
        return F.struct(
            F.lit(r["name"]).alias("partition"),
            _clip(m, r["mem_limit_mb"]).alias("mem"),
            _clip(t, r["time_limit_min"]).alias("minutes"),
        )

    cases = [(p == r["name"], target(r)) for r in special]
    for r in general[:-1]:
        fits = F.lit(True) if r["time_limit_min"] is None else t <= r["time_limit_min"]
        cases.append((fits, target(r)))
    last = target(general[-1]) if general else F.struct(p.alias("partition"), m.alias("mem"), t.alias("minutes"))
    choice = last
    for cond, value in reversed(cases):
        choice = F.when(cond, value).otherwise(choice)
    return jobs.withColumn("_to", choice).select(
        *jobs.columns,
        F.col("_to.partition").alias("to_partition"),
        F.col("_to.mem").alias("to_mem"),
        F.col("_to.minutes").alias("to_min"),
    )


def place_estimates(estimates: DataFrame, policy: DataFrame, **names) -> DataFrame:
    """Apply the policy where the estimate differs or no partition was asked for."""
    placed = assign_partition(estimates, policy, mem="est_mem", minutes="est_min", **names)
    same = (F.col("est_mem") == F.col("mem_default")) & (F.col("est_min") == F.col("min_default"))
    keep = same & F.col("partition_name").isNotNull()
    return placed.withColumns(
        {
            "to_partition": F.when(keep, F.col("partition_name")).otherwise(F.col("to_partition")),
            "to_mem": F.when(keep, F.col("est_mem")).otherwise(F.col("to_mem")),
            "to_min": F.when(keep, F.col("est_min")).otherwise(F.col("to_min")),
        }
    )


# fixed values: (below, raise to, factor in tenths); None keeps the value itself
MEM_LADDER = [(100, 100, 80), (200, 200, 50), (512, 512, 40), (1024, 1024, 30), (10240, None, 20), (51200, None, 15)]
MIN_LADDER = [(20, 20, 20), (30, 30, 40), (60, 60, 30), (120, 120, 20), (480, 480, 15)]
TOP_FACTOR = 12
HEADROOM = 12
MANY_FAILS = 3
FIRST_EXTRA_MB = 5


def _grow(value: Column, ladder, fails: Column) -> Column:
    """value x factor x 1.2 cut to a whole number, in integer hundredths."""
    v = value.cast("bigint")
    base, factor = v, F.lit(TOP_FACTOR).cast("bigint")
    for below, up, tenths in reversed(ladder):
        base = F.when(v < below, v if up is None else F.lit(up).cast("bigint")).otherwise(base)
        factor = F.when(v < below, F.lit(tenths).cast("bigint")).otherwise(factor)
    factor = F.when(fails > MANY_FAILS, factor * 4).otherwise(factor)
    return F.floor(base * factor * HEADROOM / 100).cast("bigint")


def oom_retry(jobs: DataFrame) -> DataFrame:
    """Memory for the next try of jobs that ran out of memory.

    Needs mem_alloc, mem_used, old_extra (null: none yet), recent_fails.
    """
    extra = F.greatest(
        F.coalesce(F.col("old_extra"), F.lit(FIRST_EXTRA_MB)).cast("bigint"),
        F.col("mem_alloc") - F.col("mem_used") + 1,
    )
    return jobs.withColumn("new_extra", extra).withColumn(
        "new_mem", _grow(F.col("mem_alloc"), MEM_LADDER, F.col("recent_fails")) + 2 * F.col("new_extra")
    )


def oot_retry(jobs: DataFrame) -> DataFrame:
    """Minutes for the next try of jobs that ran out of time (from minutes used)."""
    return jobs.withColumn("new_min", _grow(F.col("min_used"), MIN_LADDER, F.col("recent_fails")))


def plan_retry(jobs: DataFrame, policy: DataFrame) -> DataFrame:
    """Both rules by status, then the partition. The other resource is kept."""
    grown = oot_retry(oom_retry(jobs))
    sized = grown.withColumns(
        {
            "mem": F.when(F.col("status").isin("OOM", "OOMOOT"), F.col("new_mem")).otherwise(F.col("mem_alloc")),
            "minutes": F.when(F.col("status").isin("OOT", "OOMOOT"), F.col("new_min")).otherwise(F.col("min_alloc")),
        }
    ).filter(F.col("status").isin("OOM", "OOT", "OOMOOT"))
    return assign_partition(sized, policy)
