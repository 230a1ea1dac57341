"""Operators on the ledger of finished jobs.

Columns used: job_id, input_size, mem_default, min_default, mem_alloc,
min_alloc, mem_used, min_used, status, user_name, program, ref, flag, core,
extra_mem, finish_ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.scale import HOT_ROWS, Running, grouped_scan, hot_keys, skew_join
from jobscope.session import as_written

KEY = ["program", "ref"]

# fixed values: ledger limits
ADMIT_CAP = 500
FAILURE_BURST = 5
STALE_NEW_ROWS = 10
NOINPUT_ENOUGH = 200
RETAIN_DAYS = 7
OVER_MIN_MB = 1024


def completed(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") == "COMPLETED")


def ledger_points(ledger: DataFrame) -> DataFrame:
    """(size, memory, minutes) of finished jobs that had input."""
    return completed(ledger).filter(F.col("input_size") != 0).select(
        *KEY, "input_size", "mem_used", "min_used"
    )


def retain_ledger(ledger: DataFrame, now: Column, days: int = RETAIN_DAYS) -> DataFrame:
    """Keep finished jobs for ever and the others for some days."""
    young = F.col("finish_ts") > now - F.expr(f"interval {int(days)} days")
    return ledger.filter(young | (F.col("status") == "COMPLETED"))


def drop_missing_input(df: DataFrame, size_text: str = "input_size", patterns=("missingInputFile",)) -> DataFrame:
    """Drop rows whose size text names a missing input, in any case."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.lower(F.coalesce(F.col(size_text).cast("string"), F.lit(""))).contains(p.lower())
    return df.filter(keep)


def delete_records(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return skew_join(ledger, ids.select("job_id").distinct(), ["job_id"], "left_anti")


def invalidate_models(models: DataFrame, ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Models left after the programs of the deleted records lose theirs."""
    touched = skew_join(ledger, ids.select("job_id").distinct(), ["job_id"], "left_semi")
    return models.join(touched.select("program").distinct(), ["program"], "left_anti")


def purge_program(ledger: DataFrame, program: str, ref: str) -> DataFrame:
    """Drop every row of exactly this program and reference."""
    same = F.col("program").eqNullSafe(program) & F.col("ref").eqNullSafe(ref)
    return ledger.filter(~same)


def admit_records(
    new: DataFrame, ledger: DataFrame, cap: int = ADMIT_CAP, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """New rows that enter the ledger when taken in finish order.

    A finished job enters if its (size, memory) is not there yet for its key
    and the key has fewer than ``cap`` distinct records, or its size is the
    largest so far. Rows turned down never hold the largest size, and a repeat
    of a row turned down would be turned down too; so rank and running maximum
    over the distinct new rows give the one-at-a-time result.
    """
    held = as_written(ledger.select(*KEY, "input_size", "mem_used").distinct(), "records")
    old = held.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_have"), F.max("input_size").alias("_max")
    )
    cand = completed(new).filter(F.col("input_size").isNotNull())
    first = (
        cand.groupBy(*KEY, "input_size", "mem_used")
        .agg(F.min_by(F.struct(*cand.columns), F.struct("finish_ts", "job_id")).alias("_row"))
        .select("_row.*")
    )
    fresh = first.join(held, [*KEY, "input_size", "mem_used"], "left_anti")
    ranked = grouped_scan(
        fresh,
        KEY,
        ["finish_ts", "job_id"],
        {
            "_before": Running("count", before=True),
            "_seen": Running("max", F.col("input_size"), before=True),
        },
        hot_rows,
    )
    top = F.greatest("_max", "_seen")
    return (
        ranked.join(as_written(old), KEY, "left")
        .filter(
            (F.coalesce(F.col("_have"), F.lit(0)) + F.col("_before") < cap)
            | (F.col("input_size") > top)
            | top.isNull()
        )
        .select(*new.columns)
    )


def over_estimated(ledger: DataFrame) -> DataFrame:
    """Finished jobs that reserved more than twice what they used."""
    moved = (F.col("mem_default") != F.col("mem_alloc")) | (F.col("min_default") != F.col("min_alloc"))
    over = (F.col("mem_alloc") > 2 * F.col("mem_used")) & (F.col("mem_used") >= OVER_MIN_MB)
    # hundredths by integer division: exact truncation to two decimals
    return (
        completed(ledger)
        .filter(moved & over)
        .withColumn("ratio_mem", F.expr("((mem_used * 100) div nullif(mem_alloc, 0)) / 100.0D"))
        .withColumn("ratio_time", F.expr("((min_used * 100) div nullif(min_alloc, 0)) / 100.0D"))
    )


def recent_failures(ledger: DataFrame, now: Column, window: str = "1 hour") -> DataFrame:
    recent = ledger.filter(
        (F.col("status") != "COMPLETED") & (F.col("finish_ts") > now - F.expr(f"interval {window}"))
    )
    return recent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("recent_fails"))


def failure_burst(
    ledger: DataFrame, now: Column, window: str = "1 hour", limit: int = FAILURE_BURST
) -> DataFrame:
    """Keys whose records should be purged and reported."""
    return recent_failures(ledger, now, window).filter(F.col("recent_fails") > limit)


def bad_nodes(failures: DataFrame) -> DataFrame:
    """Nodes on which a key failed for reasons other than memory or time.

    The set per key is bounded by the number of nodes of the cluster.
    """
    other = failures.filter(~F.col("status").isin("COMPLETED", "OOM", "OOT", "OOMOOT"))
    return (
        other.select(*KEY, "node")
        .distinct()
        .groupBy(*KEY)
        .agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"))
    )


def exclude_bad_nodes(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """(program, ref, node) candidates without the nodes that failed that key."""
    bad = failures.filter(~F.col("status").isin("COMPLETED", "OOM", "OOT", "OOMOOT"))
    return candidates.join(bad.select(*KEY, "node").distinct(), [*KEY, "node"], "left_anti")


def stale_models(models: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Models to fit again, with the reason.

    models: program, ref, fitted_at, rows, kind (``input`` or ``noinput``),
    out_of_range (a request fell outside since the fit).
    """
    fits = models.select(*KEY, "fitted_at")
    newer = (
        skew_join(ledger.select(*KEY, "finish_ts", "status", "job_id"), fits, KEY)
        .filter(F.col("finish_ts") > F.col("fitted_at"))
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("newer_rows"),
            F.count_if(F.col("status") == "COMPLETED").alias("newer_completed"),
        )
    )
    settled = F.col("fitted_at") < now - F.expr("interval 2 minutes")
    reason = (
        F.when((F.col("kind") == "noinput") & settled & (F.col("rows") < NOINPUT_ENOUGH), "noinput_growing")
        .when(F.col("out_of_range") & settled, "out_of_range")
        .when(F.col("newer_rows") > STALE_NEW_ROWS, "new_rows")
        .when(F.col("newer_completed") > 0, "admitted")
    )
    return (
        models.join(newer, KEY, "left")
        .withColumn("newer_rows", F.coalesce("newer_rows", F.lit(0).cast("bigint")))
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select(*KEY, "kind", "newer_rows", "reason")
    )


def programs(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("program").agg(F.count(F.lit(1)).alias("records")).orderBy("program")


def stable_index(ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Zero-based index within a program by job id; given before any deletion."""
    return grouped_scan(ledger, ["program"], ["job_id"], {"idx": Running("count", before=True)}, hot_rows)


# fixed value: point markers of the review grid
MARKERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def scatter_grid(
    ledger: DataFrame,
    deleted: DataFrame | None = None,
    width: int = 77,
    height: int = 22,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Input size against memory per program on a fixed character grid.

    The scale comes from all rows, so deleted rows leave the others in place.
    One row per used cell: its marker, or ``+`` where points share the cell.
    """
    x = F.coalesce(F.col("input_size").try_cast("double"), F.lit(0.0)) / (1024 * 1024)
    y = F.coalesce(F.col("mem_used").try_cast("double"), F.lit(0.0)) / 1024
    hot = hot_keys(ledger, ["program"], hot_rows)
    points = grouped_scan(
        ledger.select("program", "job_id", "input_size", "mem_used"),
        ["program"], ["job_id"], {"idx": Running("count", before=True)}, hot=hot,
    )
    points = points.withColumn("x", x).withColumn("y", y)
    span = points.groupBy("program").agg(
        *[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    )
    for c in "xy":
        flat = F.col(f"{c}_lo") == F.col(f"{c}_hi")
        lo = F.col(f"{c}_lo") - F.when(flat, 0.5).otherwise(0.0)
        hi = F.col(f"{c}_hi") + F.when(flat, 0.5).otherwise(0.0)
        span = span.withColumns({f"{c}_a": lo - (hi - lo) * 0.05, f"{c}_b": hi + (hi - lo) * 0.05})
    span = as_written(span.select("program", "x_a", "x_b", "y_a", "y_b"))
    if deleted is not None:
        points = points.join(deleted.select("job_id").distinct(), ["job_id"], "left_anti")
    placed = skew_join(points, span, ["program"], spread=["job_id"], hot=hot)

    def cell(c: str, n: int) -> Column:
        at = (F.col(c) - F.col(f"{c}_a")) / (F.col(f"{c}_b") - F.col(f"{c}_a")) * (n - 1)
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(at, 0).cast("int")))

    marker = F.when(
        F.col("idx") < len(MARKERS), F.substring(F.lit(MARKERS), F.col("idx").cast("int") + 1, F.lit(1))
    ).otherwise("*")
    return (
        placed.select("program", cell("x", width).alias("gx"), (height - 1 - cell("y", height)).alias("gy"), marker.alias("m"))
        .groupBy("program", "gx", "gy")
        .agg(F.count(F.lit(1)).alias("points"), F.min("m").alias("_m"))
        .select("program", "gx", "gy", "points", F.when(F.col("points") > 1, "+").otherwise(F.col("_m")).alias("marker"))
    )
