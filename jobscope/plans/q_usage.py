"""Usage samples and process trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import usage
from jobscope.plans.registry import day, query, r6

BY_JOB = "partition by job_id order by ts, seq"


@query("""
    select s.job_id, s.seq, reserved_mb - mem_mb as wasted_mb, greatest(0, 4096 - reserved_mb) as saved_mb,
     round(100.0::double * mem_mb / reserved_mb, 6) as mem_pct
    from samples s join sample_jobs j on s.job_id = j.job_id""")
def usage_vs_request(t):
    return r6(usage.usage_vs_request(t.samples, t.sample_jobs).select("job_id", "seq", "wasted_mb", "saved_mb", "mem_pct"))


@query("""
    with s as (select job_id, max(mem_mb) as pk, min(case when is_marker then ts end) as st from samples group by job_id)
    select j.job_id, coalesce(greatest(pk, acct_mem), 0) as peak_mem,
     cast(floor((epoch(date_trunc('second', finish_ts)) - coalesce(epoch(date_trunc('second', st)), epoch(date_trunc('second', finish_ts)) - 600) + 59) / 60) as bigint) as minutes
    from sample_jobs j left join s on j.job_id = s.job_id""")
def peak_usage(t):
    return usage.peak_usage(t.samples, t.sample_jobs)


@query(f"""
    with s as (select *, sum(case when is_marker then 1 else 0 end) over ({BY_JOB} rows unbounded preceding) as seg from samples)
    select job_id, seq, cast(seg as bigint) as segment,
     row_number() over (partition by job_id, seg order by ts, seq) - case when seg = 0 then 0 else 1 end as minute from s""")
def sample_segments(t):
    return usage.sample_segments(t.samples).select("job_id", "seq", "segment", "minute")


@query(f"""
    with s as (select *, max(mem_mb) over ({BY_JOB} rows between unbounded preceding and 1 preceding) as before from samples)
    select job_id, seq, mem_mb from s where mem_mb > coalesce(before, 0)""")
def running_peak(t):
    return usage.running_peak(t.samples).select("job_id", "seq", "mem_mb")


@query(f"""
    with s as (select *, count(*) over (partition by job_id) as n, row_number() over ({BY_JOB}) as rn, ntile(50) over ({BY_JOB}) as nt from samples)
    select job_id, cast(case when n > 50 then nt else rn end as bigint) as bucket, max(mem_mb) as mem_mb, max(cpu_pct) as cpu_pct from s group by 1, 2""")
def downsample_peaks(t):
    return usage.downsample_peaks(t.samples)


NEAR = """k as (select s.*, epoch(date_trunc('second', ts)) - epoch(start_ts) as el, total_min, total_mem
      from samples s join sample_jobs j on s.job_id = j.job_id),
    w as (select *, case when el > 120 then case when total_min * 60 - el < 120 then 'Time' when total_mem - mem_mb < 100 then 'Mem' end end as kind from k),
    f as (select *, row_number() over (partition by job_id order by ts, seq) as rn from w where kind is not null)"""


@query(f"with {NEAR} select job_id, seq, mem_mb, kind from f where rn = 1")
def near_limit(t):
    return usage.near_limit(t.samples, t.sample_jobs).drop("ts")


@query("""
    with tree as (select job_id, pid, is_monitor, rss_kb, cpu_pct from procs where is_root
      union all select p.job_id, p.pid, p.is_monitor, p.rss_kb, p.cpu_pct from procs p join tree x on p.job_id = x.job_id and p.ppid = x.pid
       where not x.is_monitor)
    select job_id, cast(0 as bigint) as tick, cast(floor(sum(case when is_monitor then 5000 else rss_kb end) / 1024) as bigint) as mem_mb,
     cast(floor(sum(case when is_monitor then 2.0::double else cpu_pct end)) as bigint) as cpu_pct, count(*) as procs
    from tree group by job_id""".replace("as procs", "as n_procs"))
def process_rollup(t):
    return usage.process_rollup(t.procs).withColumnRenamed("procs", "n_procs")


@query("""
    with tree as (select job_id, pid, is_monitor from procs where is_root
      union all select p.job_id, p.pid, p.is_monitor from procs p join tree x on p.job_id = x.job_id and p.ppid = x.pid where not x.is_monitor)
    select p.job_id, p.pid, case when x.pid is null then 'none' else 'root' end as walk_end from procs p left join tree x on p.job_id = x.job_id and p.pid = x.pid""")
def process_ends(t):
    return usage.process_ends(t.procs).select("job_id", "pid", F.col("end").alias("walk_end"))
