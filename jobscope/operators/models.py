"""Memory and run-time models per (program, ref) and the estimates they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.operators.ledger import KEY, completed, ledger_points
from jobscope.scale import HOT_ROWS, Running, attach, grouped_scan, hot_keys, skew_join
from jobscope.session import as_written

# fixed values: margins, floors and the smallest samples
EXTRA_MEM_MB = 500
EXTRA_MIN = 10
FLOOR_MEM_MB = 100
FLOOR_MIN = 10
MIN_POINTS = 3
TRUSTED_POINTS = 9
RANGE_SLACK = 0.01


def points_per_size(points: DataFrame) -> DataFrame:
    """One point per distinct size: the largest memory and the largest time."""
    return points.groupBy(*KEY, "input_size").agg(
        F.max("mem_used").alias("mem_used"), F.max("min_used").alias("min_used")
    )


def _line(y: str, prefix: str) -> list[Column]:
    x = F.col("input_size").cast("double")
    v = F.col(y).cast("double")
    n = F.regr_count(v, x)
    rest = F.regr_syy(v, x) - F.regr_sxy(v, x) * F.regr_sxy(v, x) / F.regr_sxx(v, x)
    # the difference cancels on perfect fits and may fall just below zero
    spread = F.sqrt(F.greatest(F.lit(0.0), rest) / F.when(n > 2, n - 2))
    return [
        F.regr_slope(v, x).alias(f"{prefix}_a"),
        F.regr_intercept(v, x).alias(f"{prefix}_b"),
        spread.alias(f"{prefix}_stdfit"),
        F.regr_r2(v, x).alias(f"{prefix}_r2"),
    ]


def fit_lines(per_size: DataFrame) -> DataFrame:
    """Both lines of every key in one pass, one row per (program, ref)."""
    x = F.col("input_size")
    return (
        per_size.groupBy(*KEY)
        .agg(
            *_line("mem_used", "mem"),
            *_line("min_used", "time"),
            F.count(F.lit(1)).alias("n"),
            F.min(x).alias("x_min"),
            F.max(x).alias("x_max"),
            F.avg(x).alias("x_mean"),
        )
        .filter(F.col("n") >= MIN_POINTS)
    )


def size_medians(per_size: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median size per key; no key is held in one buffer.

    The middle is where the rank from below meets the rank from above, so no row count is joined.
    """
    hot = hot_keys(per_size, KEY, hot_rows)
    sizes = per_size.select(*KEY, "input_size").withColumn("_down", -F.col("input_size"))
    up = grouped_scan(sizes, KEY, ["input_size"], {"_up": Running("count")}, hot_rows, hot)
    both = grouped_scan(up, KEY, ["_down"], {"_from_top": Running("count")}, hot_rows, hot)
    middle = F.abs(F.col("_up") - F.col("_from_top")) <= 1
    return both.filter(middle).groupBy(*KEY).agg(F.avg("input_size").alias("x_median"))


def fit_models(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Model store: one row per (program, ref, target)."""
    per_size = as_written(points_per_size(points), "points")
    lines = attach(fit_lines(per_size), size_medians(per_size, hot_rows), KEY)
    one = [
        F.struct(
            F.lit(t).alias("target"),
            *[F.col(f"{t}_{c}").alias(c) for c in ("a", "b", "stdfit", "r2")],
        )
        for t in ("mem", "time")
    ]
    return lines.select(
        *KEY, F.explode(F.array(*one)).alias("m"), "n", "x_min", "x_max", "x_mean", "x_median"
    ).select(*KEY, "m.*", "n", "x_min", "x_max", "x_mean", "x_median")


def value_counts(ledger: DataFrame) -> DataFrame:
    """How many finished jobs of a key used so many whole MB (target mem) or minutes (target time).

    Values are bounded by the partition limits, so a key has few of them however many rows it holds.
    """
    return (
        completed(ledger).select(
            *KEY,
            F.explode(
                F.array(
                    F.struct(F.lit("mem").alias("target"), F.floor("mem_used").cast("bigint").alias("value")),
                    F.struct(F.lit("time").alias("target"), F.floor("min_used").cast("bigint").alias("value")),
                )
            ).alias("v"),
        ).select(*KEY, "v.*")
        .groupBy(*KEY, "target", "value").agg(F.count(F.lit(1)).alias("c"))
    )


def upper_decile(counts: DataFrame) -> DataFrame:
    """p90_mem and p90_min of a key from its value_counts."""
    group = Window.partitionBy(*KEY, "target")
    upto = group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(upto), "rows": F.sum("c").over(group)})
    k = F.expr("(rows - 1) div 10 + 1")
    return (
        ranked.filter((F.col("rows") >= MIN_POINTS) & (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k))
        .groupBy(*KEY)
        .agg(
            F.max("rows").alias("rows"),
            F.max(F.when(F.col("target") == "mem", F.col("value"))).alias("p90_mem"),
            F.max(F.when(F.col("target") == "time", F.col("value"))).alias("p90_min"),
        )
    )


def noinput_p90(ledger: DataFrame) -> DataFrame:
    """Exact upper decile of memory and of minutes over finished jobs of a key, from counts per distinct value."""
    return upper_decile(value_counts(ledger))


def extra_mem_margin(extra: DataFrame) -> DataFrame:
    """Twice the largest extra memory seen per key."""
    return extra.groupBy(*KEY).agg((F.max("extra_mb") * 2).cast("bigint").alias("margin"))


def model_table(ledger: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Everything an estimate needs, one row per key of the ledger."""
    table = noinput_p90(ledger).join(fit_lines(points_per_size(ledger_points(ledger))), KEY, "full")
    if extra is None:
        return table.withColumn("margin", F.lit(None).cast("bigint"))
    return table.join(extra_mem_margin(extra), KEY, "full")


def score_models(requests: DataFrame, models: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Estimate per request with the reason; defaults where no model applies.

    requests: job_id, program, ref, input_size (null: missing input),
    mem_default, min_default and, if empty input files are to be told from no
    input, has_input; without it a size of 0 means no input. A key of very many
    requests is spread over several tasks; a stream of requests is joined as it is.
    """
    size = F.col("input_size")
    none = ~F.col("has_input") if "has_input" in requests.columns else size == 0

    def line(p: str, floor: int) -> Column:
        value = F.round(F.col(f"{p}_a") * size + F.col(f"{p}_b") + 2 * F.col(f"{p}_stdfit"), 6)
        return F.greatest(value.cast("bigint"), F.lit(floor).cast("bigint"))

    in_range = (size <= F.col("x_max") + RANGE_SLACK) | (F.col("n") > TRUSTED_POINTS)
    reason = (
        F.when(size.isNull(), "missing_input")
        .when(none & F.col("p90_mem").isNotNull(), "noinput_p90")
        .when(none | F.col("n").isNull(), "no_model")
        .when(in_range, "model")
        .otherwise("out_of_range")
    )
    margin = F.coalesce("margin", F.lit(EXTRA_MEM_MB).cast("bigint"))
    scored = skew_join(requests, models, KEY, "left", spread=["job_id"], hot_rows=hot_rows).withColumn("reason", reason)
    pick = F.col("reason")
    return scored.select(
        *requests.columns,
        "reason",
        F.when(pick == "model", line("mem", FLOOR_MEM_MB) + margin)
        .when(pick == "noinput_p90", F.col("p90_mem") + margin)
        .otherwise(F.col("mem_default"))
        .alias("est_mem"),
        F.when(pick == "model", line("time", FLOOR_MIN) + EXTRA_MIN)
        .when(pick == "noinput_p90", F.col("p90_min") + EXTRA_MIN)
        .otherwise(F.col("min_default"))
        .alias("est_min"),
    )


def estimate_resources(requests: DataFrame, ledger: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Fit on the ledger, then score every request."""
    return score_models(requests, model_table(ledger, extra))
