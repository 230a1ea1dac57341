"""Finished jobs taken up by a store: ledger, margins and models after a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import finish
from jobscope.plans.q_ledger import later_half
from jobscope.plans.registry import query, r6
from jobscope.session import scratch_path

STATES = {"OOM": "OUT_OF_MEMORY", "OOT": "TIMEOUT", "OOMOOT": "TIMEOUT OUT_OF_MEMORY", "Fail": "FAILED", "Canceled": "CANCELLED by 0"}


def _ended(t):
    """The newer jobs as they end: no usage yet, some sizes not known."""
    _, new = later_half(t.ledger)
    state = F.lit("RUNNING")
    for status, text in STATES.items():
        state = F.when(F.col("status") == status, text).otherwise(state)
    odd = F.when(F.col("job_id") % 20 == 0, "nowhere/x").otherwise(",jobSize:70")
    return new.withColumns({
        "inputs": F.when(F.col("input_size") == 0, odd).otherwise("none"), "success": F.col("status") == "COMPLETED", "acct_state": state,
        "log_tail": F.lit(None).cast("string"), "acct_mem": F.col("mem_used"),
    }).drop("status", "mem_used", "min_used")


def _store(t):
    old, _ = later_half(t.ledger)
    store = finish.Store(t.spark, scratch_path(t.spark, "store"), t.ledger.schema)
    store.create(old, t.extra)
    finish.finish_batch(store, t.inventory, t.samples)(_ended(t), 0)
    return store


FINISHED = """
    with s as (select job_id, max(mem_mb) as peak, min(case when is_marker then ts end) as start_ts from samples group by job_id),
    n as (select l.* exclude (input_size, mem_used, min_used),
      case when input_size = 0 then case when l.job_id % 20 = 0 then null else 70 end else input_size end as input_size,
      coalesce(greatest(s.peak, l.mem_used), 0) as mem_used,
      cast(floor((epoch(finish_ts) - coalesce(epoch(s.start_ts), epoch(finish_ts) - 600) + 59) / 60) as bigint) as min_used
      from ledger l left join s on l.job_id = s.job_id where finish_ts >= timestamp '1998-01-01'),
    old as (select * from ledger where finish_ts < timestamp '1998-01-01'),
    bad as (select * from n where status in ('OOM', 'OOT', 'OOMOOT')),
    lasts as (select program, ref, max(finish_ts) as t from bad group by program, ref),
    purged as (select program, ref from (select program, ref, finish_ts from bad union all select program, ref, finish_ts from old where status <> 'COMPLETED')
      join lasts using (program, ref) where finish_ts <= t and finish_ts > t - interval 1 hour group by program, ref having count(*) > 5),
    cand as (select * from n where status = 'COMPLETED' and input_size is not null),
    firsts as (select *, row_number() over (partition by program, ref, input_size, mem_used order by finish_ts, job_id) as rn from cand),
    fresh as (select f.* from firsts f where rn = 1 and not exists (select 1 from old o where o.program = f.program
      and o.ref = f.ref and o.input_size = f.input_size and o.mem_used = f.mem_used)),
    ranked as (select *, count(*) over w - 1 as before_n,
      max(input_size) over (partition by program, ref order by finish_ts, job_id rows between unbounded preceding and 1 preceding) as seen
      from fresh window w as (partition by program, ref order by finish_ts, job_id rows unbounded preceding)),
    have as (select program, ref, count(*) as n, max(input_size) as mx from (select distinct program, ref, input_size, mem_used from old) group by program, ref),
    admitted as (select r.* from ranked r left join have h on r.program = h.program and r.ref = h.ref
      where coalesce(h.n, 0) + before_n < 500 or greatest(h.mx, seen) is null or input_size > greatest(h.mx, seen)),
    after as (select * from (select job_id, program, ref, status, input_size, mem_used, min_used from old
      union all select job_id, program, ref, status, input_size, mem_used, min_used from admitted
      union all select job_id, program, ref, status, input_size, mem_used, min_used from bad) x
      where not exists (select 1 from purged p where p.program = x.program and p.ref = x.ref))"""


@query(f"{FINISHED} select job_id, program, ref, status, cast(input_size as bigint) as input_size, cast(mem_used as bigint) as mem_used, min_used from after")
def finish_jobs(t):
    return _store(t).ledger().select("job_id", "program", "ref", "status", "input_size", "mem_used", "min_used")


def _line(col, name):
    x, y = "cast(input_size as double)", f"cast({col} as double)"
    return f"round(regr_slope({y}, {x}), 6) as {name}_a, round(regr_intercept({y}, {x}), 6) as {name}_b"


@query(f"""{FINISHED},
    pts as (select program, ref, input_size, max(mem_used) as mem_used, max(min_used) as min_used from after
      where status = 'COMPLETED' and input_size <> 0 group by program, ref, input_size),
    fits as (select program, ref, {_line('mem_used', 'mem')}, {_line('min_used', 'time')}, count(*) as n, max(input_size) as x_max
      from pts group by program, ref having count(*) >= 3),
    done as (select program, ref, cast(floor(mem_used) as bigint) as v, row_number() over (partition by program, ref order by mem_used desc) as k,
      count(*) over (partition by program, ref) as c from after where status = 'COMPLETED'),
    p90 as (select program, ref, v as p90_mem from done where c >= 3 and k = (c - 1) // 10 + 1),
    margins as (select program, ref, cast(2 * max(e) as bigint) as margin from (select program, ref, extra_mb as e from extra
      union all select program, ref, mem_alloc - mem_used + 1 from bad where status in ('OOM', 'OOMOOT') and mem_alloc - mem_used + 1 > 5) group by program, ref),
    keys as (select distinct program, ref from ledger)
    select program, ref, n, cast(x_max as bigint) as x_max, mem_a, mem_b, time_a, time_b, p90_mem, margin
    from keys left join fits using (program, ref) left join p90 using (program, ref) left join margins using (program, ref)
    where n is not null or p90_mem is not null or margin is not null""")
def kept_models(t):
    made = _store(t).models()
    return r6(made.select("program", "ref", "n", "x_max", "mem_a", "mem_b", "time_a", "time_b", "p90_mem", "margin"))
