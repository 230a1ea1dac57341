"""Hot-group forms give the rows of the plain forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobscope import scale
from jobscope.operators import files, graph, intervals, ledger, models, reads, usage
from jobscope.scale import Running, grouped_scan, hot_keys, skew_join, split_hot_groups


@pytest.fixture
def large(monkeypatch):
    """No table counts as small."""
    monkeypatch.setattr(scale, "SMALL_ROWS", 0)


def _skewed(t):
    """A third of all rows in one null-keyed group, ties in the first order column."""
    e = t.events.withColumn("k", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 5))
    return e.select("k", (F.col("event_id") % 50).alias("o"), F.col("event_id").alias("id"), F.floor("value").alias("v"))


@pytest.mark.parametrize("hot_rows", [10**9, 300, 20])
def test_grouped_scan(t, same, hot_rows):
    df = _skewed(t)
    odd = F.when(F.col("id") % 7 == 0, F.col("id"))
    got = grouped_scan(
        df, ["k"], ["o", "id"],
        {
            "n": Running("count"), "n0": Running("count", before=True), "s": Running("sum", F.col("v")),
            "s0": Running("sum", F.col("v"), before=True), "hi": Running("max", F.col("v"), before=True),
            "lo": Running("min", F.col("v")), "l": Running("last", odd), "l0": Running("last", odd, before=True),
        },
        hot_rows,
    )
    w = Window.partitionBy("k").orderBy("o", "id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*",
        F.count(F.lit(1)).over(upto).alias("n"), F.count(F.lit(1)).over(before).alias("n0"),
        F.sum("v").over(upto).alias("s"), F.sum("v").over(before).alias("s0"), F.max("v").over(before).alias("hi"),
        F.min("v").over(upto).alias("lo"), F.last(odd, True).over(upto).alias("l"), F.last(odd, True).over(before).alias("l0"),
    )
    same(got, want)


def test_hot_group_is_cut(t):
    df = _skewed(t)
    n = df.filter("k is null").count()
    parts = split_hot_groups(df, ["k"], ["o", "id"], hot_keys(df, ["k"], 50).rows).groupBy("k", "_part").count()
    sizes = [r["count"] for r in parts.filter("k is null").collect()]
    assert sum(sizes) == n and len(sizes) > 3 and max(sizes) < n / 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(t, spark, same, how, large):
    left = t.events.select((F.col("user_id") % 3).alias("k"), "event_id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k bigint, x string")
    same(skew_join(left, right, ["k"], how, hot_rows=20), left.join(right, ["k"], how))


HOT = 25


@pytest.mark.parametrize(
    "run",
    [
        lambda t, **h: ledger.stable_index(t.ledger.select("job_id", "program"), **h),
        lambda t, **h: ledger.scatter_grid(t.ledger, **h),
        lambda t, **h: ledger.admit_records(
            t.ledger.filter("finish_ts >= '1998-01-01'"), t.ledger.filter("finish_ts < '1998-01-01'"), cap=12, **h
        ).select("job_id"),
        lambda t, **h: models.size_medians(models.points_per_size(ledger.ledger_points(t.ledger)), **h),
        lambda t, **h: usage.sample_segments(t.samples.withColumn("job_id", F.col("job_id") % 2), **h),
        lambda t, **h: usage.running_peak(t.samples.withColumn("job_id", F.col("job_id") % 2), **h),
        lambda t, **h: usage.downsample_peaks(t.samples.withColumn("job_id", F.col("job_id") % 2), **h),
        lambda t, **h: usage.near_limit(t.samples, t.sample_jobs, **h),
        lambda t, **h: usage.usage_vs_request(t.samples, t.sample_jobs, **h),
        lambda t, **h: graph.first_batch_hold(t.graph.withColumn("depend_on", F.lit("null")), **h),
        lambda t, **h: graph.loop_paths(t.script_lines.withColumn("line_no", F.col("script_id") * 16 + F.col("line_no")).withColumn("script_id", F.lit(1)), **h),
        lambda t, **h: graph.annotations(t.script_lines, **h),
        lambda t, **h: intervals.merge_intervals(t.peaks, **h),
        lambda t, **h: intervals.overlap_join(
            t.reads.select("frag_id", F.col("rname").alias("chrom"), "strand", F.col("pos").alias("start_pos"), F.col("mate_pos").alias("end_pos")),
            t.peaks, width=100, **h,
        ),
        lambda t, **h: files.log_digest(t.log_lines, **h),
        lambda t, **h: reads.fastq_split(t.events.select(F.lit("f").alias("file"), F.col("event_id").alias("ordinal")), **h),
    ],
)
def test_operator_with_hot_keys(t, same, run, large, monkeypatch):
    hot = run(t, hot_rows=HOT)
    monkeypatch.undo()
    same(hot, run(t))


def _folded(rows, limit):
    """Batches by walking through each folder: (dir, name, batch)."""
    out, at = [], {}
    for d, name, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if size > limit:
            out.append((d, name, None))
            continue
        batch, total = at.get(d, (0, 0))
        out.append((d, name, batch))
        at[d] = (batch + 1, 0) if total + size > limit else (batch, total + size)
    return out


def test_folders_are_chained(t, spark):
    import random

    inv = t.inventory.select("dir", "name", F.col("size_kib").cast("bigint").alias("size_kib"))
    given = [tuple(r) for r in inv.collect()]
    r = random.Random(5)
    made = [(r.choice(["a", "b", None]), f"n{i:05d}", r.choice([0, 0, 1, 2, 7, 10, 11])) for i in range(700)]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    for rows, limits in ((given, (40000,)), (made, (0, 10, 10**6))):
        frame = spark.createDataFrame(rows, "dir string, name string, size_kib bigint")
        for limit in limits:
            want = sorted(_folded(rows, limit), key=key)
            for hot_rows in (15, 10**6):
                got = files.archive_batches(frame, limit, hot_rows=hot_rows).select("dir", "name", "batch").collect()
                assert sorted((tuple(x) for x in got), key=key) == want


def test_walks_with_large_frontiers(t, same, large, monkeypatch):
    from jobscope.plans.q_graph import _state

    edges, state = graph.job_edges(t.graph), _state(t).select("job_id", "state")
    got = graph.propagate_cancel(state, edges)
    monkeypatch.undo()
    same(got, graph.propagate_cancel(state, edges))
    monkeypatch.setattr(scale, "SMALL_ROWS", 0)
    same(usage.process_rollup(t.procs), usage.process_rollup(t.procs))
