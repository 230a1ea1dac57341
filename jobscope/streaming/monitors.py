"""Streaming operators. Inputs are streaming DataFrames with a timestamp column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobscope.operators.ledger import FAILURE_BURST, KEY, admit_records, completed
from jobscope.operators.models import score_models
from jobscope.operators.policy import place_estimates
from jobscope.operators.usage import limit_kind
from jobscope.sources import buckets

PEAK_BUCKETS = 1024


def stream_usage(samples: DataFrame, watermark: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Memory and cpu per job and minute; samples behind the watermark are dropped."""
    return (
        samples.withWatermark("ts", watermark)
        .groupBy("job_id", F.window("ts", every).alias("w"))
        .agg(
            F.sum("mem_mb").alias("mem_mb"), F.sum("cpu_pct").alias("cpu_pct"), F.count(F.lit(1)).alias("samples")
        )
        .select("job_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "mem_mb", "cpu_pct", "samples")
    )


def _milliseconds(t: dt.timedelta) -> int:
    return t // dt.timedelta(milliseconds=1)


def _batch_peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest and the last sample of each job in a batch."""
    for batch in batches:
        peaks = pa.Table.from_batches([batch]).group_by("job_id").aggregate([("ts", "max"), ("_ms", "max"), ("mem_mb", "max")])
        yield from peaks.select(["job_id", "ts_max", "_ms_max", "mem_mb_max"]).rename_columns(["job_id", "ts", "_ms", "mem_mb"]).to_batches()


def stream_peak(
    samples: DataFrame, longest: dt.timedelta = dt.timedelta(days=30), watermark: str = "1 hour", buckets: int = PEAK_BUCKETS
) -> DataFrame:
    """Running peak per job, a row whenever it rises; update mode.

    State is one number per job, and is gone when the job has sent nothing for
    ``longest``, the longest time a job may be silent. Samples of a job are brought
    down to one row per batch of rows before they are shuffled. Jobs are kept by bucket of
    their id, each an Arrow table: a micro-batch calls Python once per bucket, not once per job.
    """
    fields = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    combined = samples.select("job_id", "ts", F.unix_millis("ts").alias("_ms"), "mem_mb").mapInArrow(
        _batch_peaks, f"job_id {fields['job_id']}, ts timestamp, _ms bigint, mem_mb {fields['mem_mb']}"
    )
    kept = _milliseconds(longest)
    held = to_arrow_schema(samples.select("job_id", F.col("mem_mb").alias("peak"), F.lit(0).cast("bigint").alias("last")).schema)

    def rise(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = held.empty_table()
        if state.exists:
            before = pa.ipc.open_stream(state.get[0]).read_all()
        if not state.hasTimedOut:
            new = [
                pa.Table.from_pandas(part[["job_id", "mem_mb", "_ms"]].set_axis(held.names, axis=1), held, preserve_index=False)
                for part in parts
            ]
            both = pa.concat_tables([before.append_column("old", before["peak"]), *new], promote_options="default")
            jobs = both.group_by("job_id").aggregate([("peak", "max"), ("last", "max"), ("old", "max")])
            peak, old = jobs["peak_max"], jobs["old_max"]
            rises = jobs.filter(pc.and_(pc.is_valid(peak), pc.fill_null(pc.greater(peak, old), True)))
            if rises.num_rows:
                yield rises.select(["job_id", "peak_max"]).rename_columns(["job_id", "peak_mb"]).to_pandas()
            before = jobs.select(["job_id", "peak_max", "last_max"]).rename_columns(held.names)
        now = state.getCurrentWatermarkMs()
        before = before.filter(pc.greater_equal(before["last"], now - kept))
        if not before.num_rows:
            state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, before.schema) as out:
            out.write_table(before)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(pc.min(before["last"]).as_py() + kept, now + 1))

    return combined.withWatermark("ts", watermark).withColumn("_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets))).groupBy(
        "_bucket"
    ).applyInPandasWithState(
        rise, f"job_id {fields['job_id']}, peak_mb {fields['mem_mb']}", "jobs binary", "update", GroupStateTimeout.EventTimeTimeout
    )


def stream_near_limit(samples: DataFrame, jobs: DataFrame, watermark: str = "30 days") -> DataFrame:
    """One alarm per job that comes near a limit.

    The watermark is the longest time a job may run, so a job is not
    forgotten while it can still send samples.

    jobs: job_id, start_ts, total_mem, total_min (static). The job table is
    left to the planner, which broadcasts it only when it is small.
    """
    return (
        samples.withWatermark("ts", watermark)
        .join(jobs.select("job_id", "start_ts", "total_mem", "total_min"), ["job_id"])
        .withColumn("kind", limit_kind())
        .filter(F.col("kind").isNotNull())
        .dropDuplicatesWithinWatermark(["job_id"])
        .select("job_id", "ts", "mem_mb", "kind")
    )


def stream_failure_burst(
    ledger: DataFrame,
    n: int = FAILURE_BURST,
    length: str = "1 hour",
    slide: str = "5 minutes",
    watermark: str = "1 hour",
) -> DataFrame:
    """Windows in which a key fails more than n times."""
    return (
        ledger.filter(F.col("status") != "COMPLETED")
        .withWatermark("finish_ts", watermark)
        .groupBy(*KEY, F.window("finish_ts", length, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("fails"))
        .filter(F.col("fails") > n)
        .select(*KEY, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "fails")
    )


def _nth_before(ring: np.ndarray, ms: np.ndarray, n: int) -> np.ndarray:
    """For each of the sorted times, the n-th latest of the ring's and those before it; the least number where there are fewer."""
    none, ever = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    found = np.full(len(ms), none)
    # k of them from the sorted ring, the others from the times before
    for k in range(max(0, n - len(ms)), min(n, len(ring)) + 1):
        back = n - k
        before = np.concatenate([np.full(min(back, len(ms)), none), ms[: max(0, len(ms) - back)]]) if back else np.full(len(ms), ever)
        found = np.maximum(found, np.minimum(ring[-k] if k else ever, before))
    return found


def stream_failure_alarm(
    ledger: DataFrame,
    n: int = FAILURE_BURST,
    window: dt.timedelta = dt.timedelta(hours=1),
    watermark: str = "1 hour",
) -> DataFrame:
    """The failed job with which a key passes n failures within the window; update mode.

    The alarm comes in the micro-batch of that job, and again only after the number has
    been at n or below. State per key is a ring of the last n failures' times, gone
    one window after the last of them. Jobs of a micro-batch are taken in finish order; one that comes in
    a later micro-batch than jobs that finished after it counts for those still to come.
    """
    fields = {f.name: f.dataType.simpleString() for f in ledger.schema.fields}
    length = _milliseconds(window)

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, above = state.get if state.exists else ("", False)
        ring = [int(x) for x in text.split(",") if x]
        rows = pd.concat(part[["_ms", "job_id"]] for part in parts).sort_values(["_ms", "job_id"], ignore_index=True)
        ms = rows["_ms"].to_numpy(np.int64)
        passed = _nth_before(np.array(ring, np.int64), ms, n) > ms - length
        begins = passed & ~np.append(above, passed[:-1])
        ring = sorted([*ring, *ms[-n:].tolist()])[-n:]
        state.update((",".join(map(str, ring)), bool(passed[-1])))
        state.setTimeoutTimestamp(max(ring[-1] + length, state.getCurrentWatermarkMs()) + 1)
        if begins.any():
            alarms = rows[begins]
            yield pd.DataFrame({**dict(zip(KEY, key, strict=True)), "job_id": alarms["job_id"], "alarm_ms": alarms["_ms"]})

    alarms = (
        ledger.filter(F.col("status") != "COMPLETED")
        .select(*KEY, "job_id", "finish_ts", F.unix_millis("finish_ts").alias("_ms"))
        .withWatermark("finish_ts", watermark)
        .groupBy(*KEY)
        .applyInPandasWithState(
            watch, f"{', '.join(f'{k} {fields[k]}' for k in KEY)}, job_id {fields['job_id']}, alarm_ms bigint",
            "ring string, above boolean", "update", GroupStateTimeout.EventTimeTimeout,
        )
    )
    return alarms.select(*KEY, "job_id", F.timestamp_millis("alarm_ms").alias("alarm_ts"), F.lit(n + 1).alias("fails"))


def start_ledger(ledger: DataFrame, ledger_path: str) -> None:
    """Write the rows that are there before the first micro-batch, by bucket of their key."""
    buckets.create(ledger, ledger_path)
    buckets.write_batch(ledger, ledger_path, -1)


def earlier_rows(batch: DataFrame, batch_id: int, ledger_path: str) -> DataFrame:
    """Ledger rows, of batches before this one, in the buckets of the batch's keys; no other folder is even listed."""
    return buckets.read_buckets(batch.sparkSession, ledger_path, batch.schema, buckets.touched(batch), batch_id - 1).drop("batch")


def admit_batch(ledger_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: admit a micro-batch against the ledger on disk.

    Only the buckets of the batch's keys are read. A batch has folders of its own, one in each
    bucket that it adds to, so a batch that is run again after a failure replaces its rows instead of adding them twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        buckets.write_batch(admit_records(batch, earlier_rows(batch, batch_id, ledger_path)), ledger_path, batch_id)
        batch.unpersist()

    return step


def stream_admit(ledger_stream: DataFrame, ledger_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished jobs to the ledger without repeating (program, ref, size, memory)."""
    return (
        completed(ledger_stream)
        .writeStream.foreachBatch(admit_batch(ledger_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_score(requests: DataFrame, models: DataFrame, policy: DataFrame) -> DataFrame:
    """Requests scored by the current models and placed by the policy.

    models: a written table (see as_written or write_models), so that the
    planner knows its size.
    """
    return place_estimates(score_models(requests, models), policy)
