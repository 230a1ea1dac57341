"""Streams over the given tables, run to their end and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobscope.operators import models as md
from jobscope.plans.q_ledger import ESTIMATE, PLACE, later_half
from jobscope.plans.q_usage import NEAR
from jobscope.plans.registry import ORACLES, day, query
from jobscope.plans.views import Tables
from jobscope.session import as_written, scratch_path
from jobscope.streaming import monitors as mon


class Streams(Tables):
    """Like Tables, with one given table as a stream of its file."""

    def __init__(self, t: Tables, source: str):
        super().__init__(t.spark, t.dir)
        self.source = source

    def __getattr__(self, name):
        if name == self.source:
            path = f"{self.dir}/{name}.parquet"
            schema = self.spark.read.parquet(path).schema
            return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)
        return super().__getattr__(name)


def in_batches(t, df, by, parts=4):
    """A table of the views as a stream of several micro-batches, oldest rows first; rows of one time stay together."""
    spark = t.spark
    path = scratch_path(spark, "stream-in")
    rows = as_written(df, "stream-rows")
    low, high = rows.agg(F.min(F.unix_seconds(by)), F.max(F.unix_seconds(by))).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):  # one file each, so that a micro-batch is a part; the table is read by many tasks
        part = rows.filter(F.expr(f"(unix_seconds({by}) - {low or 0}) div {step}") == i)
        part.repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def updated(t, df):
    """Rows a stream gives in update mode; a batch that is run again replaces its own folder."""
    path = scratch_path(t.spark, "stream")
    q = df.writeStream.outputMode("update").foreachBatch(
        lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/batch={i}")
    ).option("checkpointLocation", scratch_path(t.spark, "stream-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


def finished(t, df):
    """Rows a stream appends to a file sink."""
    path = scratch_path(t.spark, "stream")
    q = df.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", scratch_path(t.spark, "stream-log")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


@query("""
    select job_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as start_at, cast(sum(mem_mb) as bigint) as mem_mb, cast(sum(cpu_pct) as bigint) as cpu_pct,
     count(*) as samples_n from samples group by job_id, date_trunc('minute', ts)
    having date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from samples) - interval 10 minute""")
def stream_usage(t):
    out = finished(t, mon.stream_usage(Streams(t, "events").samples))
    return out.select("job_id", day("start_ts").alias("start_at"), "mem_mb", "cpu_pct", F.col("samples").alias("samples_n"))


@query("select job_id, max(mem_mb) as peak_mb from samples group by job_id")
def stream_peak(t):
    rises = updated(t, mon.stream_peak(in_batches(t, t.samples, "ts")))
    return rises.groupBy("job_id").agg(F.max("peak_mb").alias("peak_mb"))


@query(f"with {NEAR} select distinct job_id from f")
def stream_near_limit(t):
    return finished(t, mon.stream_near_limit(Streams(t, "events").samples, t.sample_jobs)).select("job_id")


@query("""
    with x as (select program, ref, finish_ts, cast(floor(epoch(finish_ts) / 864000) as bigint) * 864000 - k * 864000 as s
      from ledger, unnest([0, 1, 2]) u(k) where status <> 'COMPLETED')
    select program, ref, s as start_s, count(*) as fails from x where s > epoch(finish_ts) - 2592000 group by program, ref, s
    having count(*) > 5 and s + 2592000 <= (select epoch(max(finish_ts)) from ledger where status <> 'COMPLETED') - 3600""")
def stream_failure_burst(t):
    burst = mon.stream_failure_burst(Streams(t, "orders").ledger, length="30 days", slide="10 days")
    return finished(t, burst).select("program", "ref", F.unix_timestamp("start_ts").alias("start_s"), "fails")


@query("""
    with f as (select program, ref, job_id, finish_ts, lag(finish_ts, 5) over (partition by program, ref order by finish_ts, job_id) as sixth
      from ledger where status <> 'COMPLETED'),
    g as (select *, coalesce(sixth > finish_ts - interval 30 day, false) as above from f),
    h as (select *, coalesce(lag(above) over (partition by program, ref order by finish_ts, job_id), false) as before from g)
    select program, ref, job_id, strftime(finish_ts, '%Y-%m-%d %H:%M:%S') as alarm_at, 6 as fails from h where above and not before""")
def stream_failure_alarm(t):
    alarms = mon.stream_failure_alarm(in_batches(t, t.ledger, "finish_ts"), window=dt.timedelta(days=30))
    return updated(t, alarms).select("program", "ref", "job_id", day("alarm_ts").alias("alarm_at"), "fails")


@query()
def stream_admit(t):
    old, new = later_half(t.ledger)
    path = scratch_path(t.spark, "ledger-stream")
    mon.start_ledger(old, path)
    mon.stream_admit(in_batches(t, new, "finish_ts"), path, scratch_path(t.spark, "stream-log"), availableNow=True).awaitTermination()
    return t.spark.read.parquet(path).filter("batch >= 0").select("job_id", "program", "ref", "input_size", "mem_used")


# the admitted rows are those of the batch operator
ORACLES["stream_admit"] = ORACLES["admit_records"]


@query(f"""
    with {ESTIMATE}, pl as (select *, {PLACE.format(t='est_min')} as p from est)
    select job_id, reason,
     case when est_mem = mem_default and est_min = min_default and partition_name is not null then partition_name else p end as to_partition,
     cast(least(est_mem, case when p = 'highmem' then 999000 else 249000 end) as bigint) as to_mem, cast(least(est_min, 43200) as bigint) as to_min
    from pl""")
def stream_score(t):
    models = as_written(md.model_table(t.ledger, t.extra))
    scored = mon.stream_score(Streams(t, "orders").requests, models, t.policy)
    return finished(t, scored).select("job_id", "reason", "to_partition", "to_mem", "to_min")
