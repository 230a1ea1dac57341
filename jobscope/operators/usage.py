"""Usage samples of running jobs: job_id, seq, ts, mem_mb, cpu_pct, is_marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.scale import HOT_ROWS, Running, grouped_scan, hot_from_counts, hot_keys, skew_join
from jobscope.session import as_written, cut_lineage

# fixed values
DEFAULT_MEM_MB = 4096
MONITOR_RSS_KB = 5000
MONITOR_CPU = 2.0
FALLBACK_RUN_S = 600
SECOND = 1_000_000  # microseconds
WARMUP_S = 120
LOW_MEM_MB = 100
LOW_TIME_S = 120


def usage_vs_request(samples: DataFrame, jobs: DataFrame, default_mem: int = DEFAULT_MEM_MB, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Used against reserved memory per sample; jobs: job_id, reserved_mb."""
    joined = skew_join(samples, jobs.select("job_id", "reserved_mb"), ["job_id"], spread=["seq"], hot_rows=hot_rows)
    reserved, used = F.col("reserved_mb"), F.col("mem_mb")
    return joined.withColumns(
        {
            "wasted_mb": reserved - used,
            "saved_mb": F.greatest(F.lit(0).cast("bigint"), F.lit(default_mem) - reserved),
            "mem_pct": 100.0 * used / F.when(reserved != 0, reserved),
        }
    )


def peak_usage(samples: DataFrame, acct: DataFrame, whole_seconds: bool = True) -> DataFrame:
    """Peak memory and minutes per job; acct: job_id, acct_mem, finish_ts.

    Both ends of a run count as full seconds, as an accounting export has them, or as they are.
    """
    seen = samples.groupBy("job_id").agg(
        F.max("mem_mb").alias("_peak"),
        F.min(F.when(F.col("is_marker"), F.col("ts"))).alias("_start"),
    )
    def at(c: str) -> Column:
        ts = F.col(c).cast("timestamp")
        return F.unix_micros(F.date_trunc("second", ts) if whole_seconds else ts)

    end, begin = at("finish_ts"), at("_start")
    # in microseconds, without fractions
    spent = end - F.coalesce(begin, end - FALLBACK_RUN_S * SECOND) + 59 * SECOND
    minute = F.lit(60 * SECOND)
    return acct.join(seen, ["job_id"], "left").select(
        "job_id",
        F.coalesce(F.greatest("_peak", "acct_mem"), F.lit(0).cast("bigint")).alias("peak_mem"),
        ((spent - F.pmod(spent, minute)) / minute).cast("bigint").alias("minutes"),
    )


def sample_segments(samples: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Marker rows open a new segment; the minute index restarts there."""
    hot = hot_keys(samples, ["job_id"], hot_rows)
    cut = grouped_scan(
        samples, ["job_id"], ["ts", "seq"], {"segment": Running("sum", F.col("is_marker").cast("bigint"))}, hot=hot
    )
    counted = grouped_scan(
        cut, ["job_id", "segment"], ["ts", "seq"], {"_before": Running("count", before=True)}, hot_rows, hot.within()
    )
    # the first segment has no marker row in front when monitoring began without one
    first = F.when(F.col("segment") == 0, 1).otherwise(0)
    return counted.withColumn("minute", F.col("_before") + first).drop("_before")


def running_peak(samples: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Samples that raise the job's memory above everything before."""
    scanned = grouped_scan(
        samples, ["job_id"], ["ts", "seq"], {"_before": Running("max", F.col("mem_mb"), before=True)}, hot_rows
    )
    return scanned.filter(F.col("mem_mb") > F.coalesce(F.col("_before"), F.lit(0))).drop("_before")


def _bucket_of(rank: Column, rows: Column, n: int) -> Column:
    """Number of the bucket when rows are dealt to n buckets of near equal size."""
    base, longer = F.floor(rows / n), rows % n
    head = longer * (base + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (base + 1)) + 1).otherwise(
        longer + F.floor((rank - 1 - head) / base) + 1
    )


def downsample_peaks(samples: DataFrame, n: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """At most n rows per job: each keeps the peak memory and cpu of its bucket."""
    sizes = as_written(samples.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n")))
    hot = hot_from_counts(sizes, hot_rows)
    ranked = grouped_scan(
        samples.select("job_id", "ts", "seq", "mem_mb", "cpu_pct"),
        ["job_id"], ["ts", "seq"], {"_rn": Running("count")}, hot=hot,
    )
    both = skew_join(ranked, sizes, ["job_id"], spread=["seq"], hot=hot)
    bucket = F.when(F.col("_n") > n, _bucket_of(F.col("_rn"), F.col("_n"), n)).otherwise(F.col("_rn"))
    return (
        both.withColumn("bucket", bucket.cast("bigint"))
        .groupBy("job_id", "bucket")
        .agg(F.max("mem_mb").alias("mem_mb"), F.max("cpu_pct").alias("cpu_pct"))
    )


def limit_kind() -> Column:
    """Why a sample is near a limit of its job; null when it is not.

    Uses ts, start_ts, mem_mb, total_mem, total_min.
    """
    elapsed = F.unix_timestamp("ts") - F.unix_timestamp("start_ts")
    return F.when(
        elapsed > WARMUP_S,
        F.when(F.col("total_min") * 60 - elapsed < LOW_TIME_S, "Time").when(
            F.col("total_mem") - F.col("mem_mb") < LOW_MEM_MB, "Mem"
        ),
    )


def near_limit(samples: DataFrame, jobs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First sample of each job that comes near a limit.

    jobs: job_id, start_ts, total_mem, total_min.
    """
    joined = skew_join(
        samples.select("job_id", "seq", "ts", "mem_mb"),
        jobs.select("job_id", "start_ts", "total_mem", "total_min"),
        ["job_id"], spread=["seq"], hot_rows=hot_rows,
    )
    return (
        joined.withColumn("kind", limit_kind())
        .filter(F.col("kind").isNotNull())
        .groupBy("job_id")
        .agg(F.min_by(F.struct("seq", "ts", "mem_mb", "kind"), F.struct("ts", "seq")).alias("s"))
        .select("job_id", "s.*")
    )


def process_ends(procs: DataFrame) -> DataFrame:
    """Where the walk from each process to its parents ends: job_id, tick, pid, end.

    ``end`` is root, none (a missing parent or a monitor above) or cycle (the
    ids lead back to themselves). Parents are resolved by pointer doubling, so
    a tree of depth d takes log2(d) joins; when as many steps as the largest
    tick has processes reach no end, the rest is a cycle.
    """
    ids = ["job_id", "tick"]
    links = procs.select(
        *ids, "pid",
        F.when(F.col("is_root"), None).otherwise(F.col("ppid")).alias("up"),
        F.when(F.col("is_root"), "root").alias("end"),
        "is_monitor",
    )
    above = links.select(*ids, F.col("pid").alias("up"), F.col("is_monitor").alias("_hid"))
    # one step up first: a parent that is missing or a monitor ends the walk
    links = skew_join(links, above, [*ids, "up"], "left", spread=["pid"]).select(
        *ids, "pid",
        F.when(F.col("_hid") == F.lit(False), F.col("up")).alias("up"),
        F.coalesce("end", F.when(F.coalesce("_hid", F.lit(True)), F.lit("none"))).alias("end"),
    )
    links = cut_lineage(links)
    most = links.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if links.filter(F.col("end").isNull()).isEmpty():
            break
        nxt = links.select(*ids, F.col("pid").alias("up"), F.col("up").alias("_up"), F.col("end").alias("_end"))
        links = cut_lineage(
            skew_join(links, nxt, [*ids, "up"], "left", spread=["pid"]).select(
                *ids, "pid",
                F.when(F.col("_end").isNull(), F.col("_up")).alias("up"),
                F.coalesce("end", "_end").alias("end"),
            )
        )
    return links.select(*ids, "pid", F.coalesce("end", F.lit("cycle")).alias("end"))


def process_rollup(procs: DataFrame) -> DataFrame:
    """Memory and cpu per job and tick over the process trees below its roots.

    procs: job_id, tick, pid, ppid, rss_kb, cpu_pct, cmd, is_root, is_monitor.
    The monitor counts with a constant and hides what runs below it. A cycle
    of process ids hangs below no root; ``process_ends`` names its processes.
    """
    ids = ["job_id", "tick"]
    links = process_ends(procs)
    under = links.filter(F.col("end") == "root").select(*ids, "pid")
    rss = F.when(F.col("is_monitor"), F.lit(MONITOR_RSS_KB)).otherwise(F.col("rss_kb"))
    cpu = F.when(F.col("is_monitor"), F.lit(MONITOR_CPU)).otherwise(F.col("cpu_pct"))
    return (
        procs.join(under, [*ids, "pid"], "left_semi")
        .groupBy(*ids)
        .agg(
            F.floor(F.sum(rss) / 1024).cast("bigint").alias("mem_mb"),
            F.sum(cpu).cast("bigint").alias("cpu_pct"),
            F.count(F.lit(1)).alias("procs"),
        )
    )
