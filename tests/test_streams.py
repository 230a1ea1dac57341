"""Streams in several micro-batches give the batch result."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.operators import ledger as lg
from jobscope.operators import usage
from jobscope.sources import buckets
from jobscope.streaming import monitors as mon


@pytest.fixture
def source(spark, tmp_path):
    """A frame as a stream of several files, oldest first."""

    def make(df, by, parts=4):
        path = str(tmp_path / "in")
        rows = df.orderBy(by).collect()
        step = -(-len(rows) // parts)
        for i in range(parts):
            spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def _append(spark, tmp_path, df):
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_usage(spark, t, tmp_path, source, same):
    samples = t.samples.filter("not is_marker")
    got = _append(spark, tmp_path, mon.stream_usage(source(samples, "ts"), "1 hour", "1 day"))
    want = samples.groupBy("job_id", F.window("ts", "1 day").alias("w")).agg(
        F.sum("mem_mb").alias("mem_mb"), F.sum("cpu_pct").alias("cpu_pct"), F.count(F.lit(1)).alias("samples")
    ).select("job_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "mem_mb", "cpu_pct", "samples")
    last = samples.agg(F.max("ts") - F.expr("interval 1 hour")).scalar()
    same(got, want.filter(F.col("end_ts") <= last))


def test_one_alarm_per_job(spark, t, tmp_path, source):
    got = _append(spark, tmp_path, mon.stream_near_limit(source(t.samples, "ts"), t.sample_jobs))
    want = usage.near_limit(t.samples, t.sample_jobs)
    assert sorted(r.job_id for r in got.collect()) == sorted(r.job_id for r in want.collect())


def test_admit_takes_each_row_once(spark, t, tmp_path, source, same):
    old, new = t.ledger.filter("finish_ts < '1998-01-01'"), t.ledger.filter("finish_ts >= '1998-01-01'")
    path = str(tmp_path / "ledger")
    mon.start_ledger(old, path)
    mon.stream_admit(source(new, ["finish_ts", "job_id"]), path, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = spark.read.parquet(path).filter("batch >= 0")
    assert got.select("batch").distinct().count() == 4
    same(got.select("job_id"), lg.admit_records(new, old).select("job_id"))


def test_peak(spark, t, tmp_path, source, same):
    out = str(tmp_path / "peak")
    q = mon.stream_peak(source(t.samples, "ts")).writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).groupBy("job_id").agg(F.max("peak_mb").alias("peak_mb"))
    same(got, t.samples.groupBy("job_id").agg(F.max("mem_mb").alias("peak_mb")))


def _updates(spark, tmp_path, df):
    """Rows of every micro-batch, and the state rows after each."""
    out, rows = [], []
    q = df.writeStream.outputMode("update").foreachBatch(lambda part, i: out.append([tuple(r) for r in part.collect()])).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    for progress in q.recentProgress:
        rows.append(progress["stateOperators"][0]["numRowsTotal"])
    return out, rows


def _in_turn(spark, tmp_path, batches, schema):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_of_silent_jobs_is_gone(spark, tmp_path):
    at = lambda day, minute=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, minutes=minute)
    batches = [
        [("a", at(0), 5), ("a", at(0, 1), 9), ("b", at(0), 1)],
        [("a", at(1), 7), ("b", at(1), 3), ("c", at(1), None)],
        [("d", at(40), 2)],  # the others have been silent for longer than they may
        [("d", at(41), 4), ("e", at(41), 1)],
    ]
    stream = mon.stream_peak(_in_turn(spark, tmp_path, batches, "job_id string, ts timestamp, mem_mb bigint"), longest=dt.timedelta(days=30))
    out, state = _updates(spark, tmp_path, stream)
    rises = [sorted(x) for x in out if x]
    assert rises == [[("a", 9), ("b", 1)], [("b", 3)], [("d", 2)], [("d", 4), ("e", 1)]]
    assert max(state) >= 3 and state[-1] == 2


def test_alarm_comes_with_the_failing_job(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    fail = lambda job, minute, key="p": (job, key, "r", "OOM", at(minute))
    batches = [
        [fail(1, 0), fail(2, 1), fail(3, 2), fail(9, 3, "q"), (50, "p", "r", "COMPLETED", at(3))],
        [fail(4, 10), fail(5, 20)],
        [fail(6, 59), fail(7, 59), fail(10, 59, "q")],  # the sixth within the hour, and one more
        [fail(8, 200)],
        [fail(20 + k, 300 + k) for k in range(6)],  # again, after a pause
    ]
    stream = mon.stream_failure_alarm(_in_turn(spark, tmp_path, batches, "job_id bigint, program string, ref string, status string, finish_ts timestamp"))
    out, state = _updates(spark, tmp_path, stream)
    alarms = [[r[:3] for r in x] for x in out]
    alarms += [[]] * (5 - len(alarms))
    assert alarms[:3] == [[], [], [("p", "r", 6)]] and sorted(sum(alarms[3:], [])) == [("p", "r", 25)]
    assert max(state) == 2


def test_admit_reads_the_touched_buckets_only(spark, t, tmp_path):
    path = str(tmp_path / "ledger")
    old, new = t.ledger.filter("finish_ts < '1998-01-01'"), t.ledger.filter("finish_ts >= '1998-01-01'")
    mon.start_ledger(old, path)
    one = new.filter("program = '1-URGENT' and ref = 'ref1'")
    bucket = one.select(buckets.bucket_of()).distinct().collect()
    assert len(bucket) == 1
    read = mon.earlier_rows(one, 0, path)
    folders = {f.split("/bucket=")[1].split("/")[0] for f in read.inputFiles()}
    assert folders <= {"-1", str(bucket[0][0])} and str(bucket[0][0]) in folders
    assert read.count() == old.filter(F.pmod(F.xxhash64("program", "ref"), F.lit(buckets.BUCKETS)) == bucket[0][0]).count() > 0


def test_a_batch_that_is_run_again_changes_nothing(spark, t, tmp_path, same):
    path = str(tmp_path / "ledger")
    old, new = t.ledger.filter("finish_ts < '1998-01-01'"), t.ledger.filter("finish_ts >= '1998-01-01'")
    mon.start_ledger(old, path)
    step = mon.admit_batch(path)
    first, second = new.filter("job_id % 2 = 0"), new.filter("job_id % 2 = 1")
    step(first, 0)
    step(second, 1)
    once = spark.read.parquet(path).drop("bucket").collect()
    step(second, 1)
    step(first, 0)
    again = spark.read.parquet(path).drop("bucket").collect()
    assert sorted(map(str, once)) == sorted(map(str, again)) and len(once) > old.count()


def test_many_jobs_share_few_calls(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    batches = [
        [(j, at(0), j) for j in range(3000)] + [(None, at(0), 5)],
        [(j, at(1), j + j % 2) for j in range(1500)] + [(4000, at(1), None), (None, at(1), 6)],  # odd ones rise
        [(7, at(40), 9), (8, at(40), 3)],  # the watermark follows: the others have been silent for too long
        [(7, at(41), 1), (8, at(41), 12)],
        [(j, at(41), 1) for j in range(3)],  # known no more, so a first peak
    ]
    stream = mon.stream_peak(_in_turn(spark, tmp_path, batches, "job_id bigint, ts timestamp, mem_mb bigint"), buckets=16)
    out, state = _updates(spark, tmp_path, stream)
    rises = [sorted(x, key=str) for x in out if x]
    key = lambda rows: sorted(rows, key=str)
    assert rises == [
        key([(j, j) for j in range(3000)] + [(None, 5)]), key([(j, j + 1) for j in range(1, 1500, 2)] + [(None, 6)]),
        [(7, 9)], [(8, 12)], key([(j, 1) for j in range(3)]),
    ]
    assert max(state) <= 16  # a row per bucket, not per job


def test_alarm_ring_by_column_is_the_ring_row_by_row():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5):
        for _ in range(300):
            ring = sorted(rng.integers(0, 40, rng.integers(0, n + 1)).tolist())
            ms = np.sort(rng.integers(0, 40, rng.integers(1, 9)))
            want, held = [], ring
            for x in ms.tolist():
                want.append(held[0] if len(held) == n else np.iinfo(np.int64).min)
                held = sorted([*held, x])[-n:]
            assert mon._nth_before(np.array(ring, np.int64), ms, n).tolist() == want

