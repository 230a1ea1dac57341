"""Weekly efficiency per user and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.scale import HOT_ROWS, skew_join

# fixed values: (more than / at least jobs, average GB) of wasteful users
STRICT_TIERS = [(100, 20), (30, 32)]
LOOSE_TIERS = [(20, 48), (10, 96)]
LAST_TIER = (5, 200)


def user_efficiency(jobs: DataFrame, steps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requested against used resources per user.

    jobs: job_id, user_name, nodes, req_gb, hours, ncpus, cpu_hours,
    limit_hours. steps: job_id, step_no, max_rss_gb, hours.
    """
    step_rows = skew_join(
        steps.select("job_id", "step_no", "max_rss_gb", F.col("hours").alias("step_hours")),
        jobs.select("job_id", "nodes", "req_gb"),
        ["job_id"], spread=["step_no", "max_rss_gb", "step_hours"], hot_rows=hot_rows,
    )
    rss = F.col("nodes") * F.col("max_rss_gb")
    per_job = step_rows.groupBy("job_id").agg(
        F.sum(F.least(rss, F.col("req_gb")) * F.col("step_hours")).alias("_used"),
        F.max(rss).alias("_peak"),
        F.bool_or(rss > F.col("req_gb") / 2).alias("_half"),
    )
    h = F.col("hours")
    return (
        jobs.join(per_job, ["job_id"], "left")
        .groupBy("user_name")
        .agg(
            F.count(F.lit(1)).alias("njobs"),
            F.sum(h).alias("_h"),
            (F.sum(h * F.col("req_gb")) / F.sum(h)).alias("avg_req_gb"),
            (F.coalesce(F.sum("_used"), F.lit(0.0)) / F.sum(h)).alias("avg_used_gb"),
            F.coalesce(F.max("_peak"), F.lit(0.0)).alias("max_used_gb"),
            F.count_if("_half").alias("njobs_half"),
            (100 * F.sum("cpu_hours") / F.sum(F.col("ncpus") * h)).alias("core_eff"),
            (100 * F.sum(h) / F.sum("limit_hours")).alias("wall_used"),
        )
        .filter(F.col("_h") > 0)
        .drop("_h")
        .orderBy("user_name")
    )


def exclude_users(df: DataFrame, prefixes: Sequence[str], user: str = "user_name") -> DataFrame:
    """Drop users whose name starts with a listed prefix."""
    keep = F.lit(True)
    for p in prefixes:
        keep = keep & ~F.col(user).startswith(p)
    return df.filter(keep)


def exclude_interactive(df: DataFrame, partition: str = "partition_name") -> DataFrame:
    return df.filter(~F.coalesce(F.col(partition), F.lit("")).contains("interactive"))


def _tier() -> Column:
    jobs, gb, half = F.col("njobs"), F.col("avg_req_gb"), F.col("njobs_half")
    wasteful = (jobs > LAST_TIER[0]) & (gb >= LAST_TIER[1])
    for n, g in STRICT_TIERS:
        wasteful = wasteful | ((jobs > n) & (gb >= g))
    for n, g in LOOSE_TIERS:
        wasteful = wasteful | ((jobs >= n) & (gb >= g))
    rarely = half * 1000 < jobs * 5
    often = half * 1000 > jobs * 20
    return (
        F.when(rarely, F.when(wasteful, "bad").otherwise("neutral"))
        .when(often | (gb < 16), "good")
        .otherwise("neutral")
    )


def user_tier(report: DataFrame) -> DataFrame:
    """good, bad or neutral per user of a report."""
    return report.withColumn("tier", _tier())


def week_over_week(current: DataFrame, last: DataFrame, fairshare: DataFrame) -> DataFrame:
    """Action per user from this week's tier, last week's and the fair share.

    fairshare: user_name, fairshare (text ``0`` or ``1``).
    """
    before = user_tier(last).select("user_name", F.col("tier").alias("last_tier"))
    now = user_tier(current).select("user_name", "tier")
    bad = (F.col("tier") == "bad") & (F.col("fairshare") == "1")
    action = (
        F.when(bad & (F.col("last_tier") == "good"), "warn")
        .when(bad, "lower")
        .when((F.col("tier") == "good") & (F.col("fairshare") == "0"), "reset")
        .otherwise("none")
    )
    return now.join(before, ["user_name"], "left").join(fairshare, ["user_name"], "left").withColumn("action", action)


def report_recipients(report: DataFrame, directory: DataFrame, blacklist: Sequence[str] = ()) -> DataFrame:
    """Report rows with the user's full name; directory: user_name, full_name."""
    return exclude_users(report, blacklist).join(directory.select("user_name", "full_name"), ["user_name"], "left")
