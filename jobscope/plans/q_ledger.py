"""Ledger, models, policy, savings and efficiency."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.functions import units as fu
from jobscope.operators import efficiency, ledger as lg, models as md, policy as pl, savings as sv, usage
from jobscope.plans.registry import day, query, r6
from jobscope.scale import one_value

NOW = "(select max(finish_ts) from ledger)"


def now(t):
    return one_value(t.ledger, F.max("finish_ts"))


def later_half(df):
    """Old and new rows of one table, cut by date."""
    cut = F.to_timestamp(F.lit("1998-01-01"))
    return df.filter(F.col("finish_ts") < cut), df.filter(F.col("finish_ts") >= cut)


@query("""
    select program, ref, input_size, mem_used, min_used from ledger where status = 'COMPLETED' and input_size <> 0""")
def ledger_points(t):
    return lg.ledger_points(t.ledger)


@query(f"""
    select job_id, status from ledger where status = 'COMPLETED' or finish_ts > {NOW} - interval 90 day""")
def retain_ledger(t):
    return lg.retain_ledger(t.ledger, now(t), days=90).select("job_id", "status")


@query("""
    select job_id, cast(input_size as varchar) as size_text from ledger where status <> 'Fail'""")
def drop_missing_input(t):
    text = F.when(F.col("status") == "Fail", "MissingInputFILE").otherwise(F.col("input_size").cast("string"))
    df = t.ledger.select("job_id", text.alias("size_text"))
    return lg.drop_missing_input(df, "size_text")


@query("select job_id, status, program from ledger where status not in ('Fail', 'Unknown')")
def delete_records(t):
    ids = t.ledger.filter(F.col("status").isin("Fail", "Unknown")).select("job_id")
    return lg.delete_records(t.ledger, ids).select("job_id", "status", "program")


@query("""
    with m as (select distinct program, ref from ledger),
    touched as (select distinct program from ledger where mem_used > (select 0.999 * max(mem_used) from ledger))
    select program, ref from m where program not in (select program from touched)""")
def invalidate_models(t):
    top = one_value(t.ledger, F.max("mem_used"))
    ids = t.ledger.filter(F.col("mem_used") > 0.999 * top).select("job_id")
    return lg.invalidate_models(t.ledger.select("program", "ref").distinct(), t.ledger, ids)


@query("select job_id, program, ref from ledger where not (program = '2-HIGH' and ref = 'ref1')")
def purge_program(t):
    return lg.purge_program(t.ledger, "2-HIGH", "ref1").select("job_id", "program", "ref")


@query("""
    with old as (select * from ledger where finish_ts < timestamp '1998-01-01'),
    cand as (select * from ledger where finish_ts >= timestamp '1998-01-01' and status = 'COMPLETED' and input_size is not null),
    firsts as (select *, row_number() over (partition by program, ref, input_size, mem_used order by finish_ts, job_id) as rn from cand),
    fresh as (select f.* from firsts f where rn = 1 and not exists (select 1 from old o where o.program = f.program
      and o.ref = f.ref and o.input_size = f.input_size and o.mem_used = f.mem_used)),
    ranked as (select *, count(*) over w - 1 as before_n,
      max(input_size) over (partition by program, ref order by finish_ts, job_id rows between unbounded preceding and 1 preceding) as seen
      from fresh window w as (partition by program, ref order by finish_ts, job_id rows unbounded preceding)),
    have as (select program, ref, count(*) as n, max(input_size) as mx from (select distinct program, ref, input_size, mem_used from old) group by program, ref)
    select r.job_id, r.program, r.ref, r.input_size, r.mem_used from ranked r left join have h on r.program = h.program and r.ref = h.ref
    where coalesce(h.n, 0) + before_n < 500 or greatest(h.mx, seen) is null or input_size > greatest(h.mx, seen)""")
def admit_records(t):
    old, new = later_half(t.ledger)
    return lg.admit_records(new, old).select("job_id", "program", "ref", "input_size", "mem_used")


@query("""
    select job_id, mem_alloc, mem_used, (mem_used * 100 // mem_alloc) / 100.0::double as ratio_mem,
     (min_used * 100 // nullif(min_alloc, 0)) / 100.0::double as ratio_time
    from (select * exclude (mem_used), mem_used // 2 as mem_used from ledger) l
    where status = 'COMPLETED' and (mem_default <> mem_alloc or min_default <> min_alloc)
     and mem_alloc > 2 * mem_used and mem_used >= 1024""")
def over_estimated(t):
    # the derived ledger uses two thirds of the allocation: halve that
    df = t.ledger.withColumn("mem_used", F.expr("mem_used div 2"))
    return lg.over_estimated(df).select("job_id", "mem_alloc", "mem_used", "ratio_mem", "ratio_time")


@query(f"""
    select program, ref, count(*) as recent_fails from ledger
    where status <> 'COMPLETED' and finish_ts > {NOW} - interval 60 day group by program, ref""")
def recent_failures(t):
    return lg.recent_failures(t.ledger, now(t), "60 days")


@query(f"""
    select program, ref, count(*) as recent_fails from ledger
    where status <> 'COMPLETED' and finish_ts > {NOW} - interval 60 day group by program, ref having count(*) > 5""")
def failure_burst(t):
    return lg.failure_burst(t.ledger, now(t), "60 days")


@query("""
    select program, ref, string_agg(node, ',' order by node) as nodes
    from (select distinct program, ref, node from ledger where status in ('Fail', 'Canceled', 'Unknown')) x
    group by program, ref""")
def bad_nodes(t):
    return lg.bad_nodes(t.ledger)


@query(f"""
    select distinct program, ref, node from ledger l where not exists (select 1 from ledger b where b.program = l.program
     and b.ref = l.ref and b.node = l.node and b.status in ('Fail', 'Canceled', 'Unknown') and b.finish_ts > {NOW} - interval 200 day)""")
def exclude_bad_nodes(t):
    recent = t.ledger.filter(F.col("finish_ts") > now(t) - F.expr("interval 200 days"))
    return lg.exclude_bad_nodes(t.ledger.select("program", "ref", "node").distinct(), recent)


@query(f"""
    with m as (select program, ref, max(finish_ts) - to_days(cast(count(*) % 40 as integer)) as fitted_at, count(*) as rows_n,
      case when count(*) % 3 = 0 then 'noinput' else 'input' end as kind, count(*) % 4 = 0 as out_of_range
      from ledger group by program, ref),
    newer as (select m.program, m.ref, count(*) as newer_rows, count(*) filter (where l.status = 'COMPLETED') as nc
      from m join ledger l on l.program = m.program and l.ref = m.ref and l.finish_ts > m.fitted_at group by m.program, m.ref),
    r as (select m.program, m.ref, m.kind, coalesce(n.newer_rows, 0) as newer_rows,
      case when kind = 'noinput' and fitted_at < {NOW} - interval 2 minute and rows_n < 200 then 'noinput_growing'
       when out_of_range and fitted_at < {NOW} - interval 2 minute then 'out_of_range'
       when newer_rows > 10 then 'new_rows' when nc > 0 then 'admitted' end as reason
      from m left join newer n on m.program = n.program and m.ref = n.ref)
    select * from r where reason is not null""")
def stale_models(t):
    n = F.count(F.lit(1))
    m = t.ledger.groupBy("program", "ref").agg(
        (F.max("finish_ts") - F.make_dt_interval((n % 40).cast("int"))).alias("fitted_at"),
        n.alias("rows"),
        F.when(n % 3 == 0, "noinput").otherwise("input").alias("kind"),
        (n % 4 == 0).alias("out_of_range"),
    )
    return lg.stale_models(m, t.ledger, now(t))


@query("select program, count(*) as records from ledger group by program")
def programs(t):
    return lg.programs(t.ledger)


@query("select job_id, program, row_number() over (partition by program order by job_id) - 1 as idx from ledger")
def stable_index(t):
    return lg.stable_index(t.ledger.select("job_id", "program"))


@query("""
    with p as (select program, job_id, status, input_size / 1048576.0::double as x, mem_used / 1024.0::double as y,
      row_number() over (partition by program order by job_id) - 1 as idx from ledger),
    s as (select program, min(x) as xl, max(x) as xh, min(y) as yl, max(y) as yh from p group by program),
    e as (select program, case when xl = xh then xl - 0.5::double else xl end as xl, case when xl = xh then xh + 0.5::double else xh end as xh,
      case when yl = yh then yl - 0.5::double else yl end as yl, case when yl = yh then yh + 0.5::double else yh end as yh from s),
    d as (select program, xl - (xh - xl) * 0.05::double as xa, xh + (xh - xl) * 0.05::double as xb,
      yl - (yh - yl) * 0.05::double as ya, yh + (yh - yl) * 0.05::double as yb from e),
    c as (select p.program, idx, greatest(0, least(76, cast(round_even((x - xa) / (xb - xa) * 76, 0) as int))) as gx,
      21 - greatest(0, least(21, cast(round_even((y - ya) / (yb - ya) * 21, 0) as int))) as gy
      from p join d on p.program = d.program where status <> 'Fail')
    select program, gx, gy, count(*) as points, case when count(*) > 1 then '+' else
      case when min(idx) < 36 then substr('0123456789abcdefghijklmnopqrstuvwxyz', cast(min(idx) as int) + 1, 1) else '*' end end as marker
    from c group by program, gx, gy""")
def scatter_grid(t):
    gone = t.ledger.filter(F.col("status") == "Fail")
    return lg.scatter_grid(t.ledger, gone)


PER_SIZE = """pts as (select program, ref, input_size, max(mem_used) as mem_used, max(min_used) as min_used
      from ledger where status = 'COMPLETED' and input_size <> 0 group by program, ref, input_size)"""


@query(f"with {PER_SIZE} select * from pts")
def points_per_size(t):
    return md.points_per_size(lg.ledger_points(t.ledger))


def _fit(col, target):
    x, y = "cast(input_size as double)", f"cast({col} as double)"
    return f"""select program, ref, '{target}' as target, round(regr_slope({y}, {x}), 6) as a, round(regr_intercept({y}, {x}), 6) as b,
      round(sqrt(greatest(0, regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x})) / (count(*) - 2)), 6) as stdfit,
      round(regr_r2({y}, {x}), 6) as r2, count(*) as n, min(input_size) as x_min, max(input_size) as x_max,
      round(avg(input_size), 6) as x_mean, round(median(input_size), 6) as x_median
      from pts group by program, ref having count(*) >= 3"""


@query(f"with {PER_SIZE} {_fit('mem_used', 'mem')} union all {_fit('min_used', 'time')}")
def fit_models(t):
    return r6(md.fit_models(lg.ledger_points(t.ledger)))


P90 = """c as (select * from ledger where status = 'COMPLETED'),
    rk as (select program, ref, mem_used, min_used, row_number() over (partition by program, ref order by mem_used desc) as rm,
      row_number() over (partition by program, ref order by min_used desc) as rt,
      count(*) over (partition by program, ref) as n from c),
    p90 as (select program, ref, cast(max(n) as bigint) as n_rows, max(case when rm = (n - 1) // 10 + 1 then mem_used end) as p90_mem,
      max(case when rt = (n - 1) // 10 + 1 then min_used end) as p90_min from rk where n >= 3 group by program, ref)"""


@query(f"with {P90} select program, ref, n_rows, p90_mem, p90_min from p90")
def noinput_p90(t):
    return md.noinput_p90(t.ledger).withColumnRenamed("rows", "n_rows")


@query("select program, ref, cast(2 * max(extra_mb) as bigint) as margin from extra group by program, ref")
def extra_mem_margin(t):
    return md.extra_mem_margin(t.extra)


ESTIMATE = f"""{PER_SIZE}, {P90},
    ft as (select program, ref, count(*) as n, max(input_size) as x_max,
      regr_slope(cast(mem_used as double), cast(input_size as double)) as ma, regr_intercept(cast(mem_used as double), cast(input_size as double)) as mb,
      sqrt(greatest(0, regr_syy(cast(mem_used as double), cast(input_size as double)) - power(regr_sxy(cast(mem_used as double), cast(input_size as double)), 2)
        / regr_sxx(cast(mem_used as double), cast(input_size as double))) / (count(*) - 2)) as ms,
      regr_slope(cast(min_used as double), cast(input_size as double)) as ta, regr_intercept(cast(min_used as double), cast(input_size as double)) as tb,
      sqrt(greatest(0, regr_syy(cast(min_used as double), cast(input_size as double)) - power(regr_sxy(cast(min_used as double), cast(input_size as double)), 2)
        / regr_sxx(cast(min_used as double), cast(input_size as double))) / (count(*) - 2)) as ts
      from pts group by program, ref having count(*) >= 3),
    mg as (select program, ref, cast(2 * max(extra_mb) as bigint) as margin from extra group by program, ref),
    sc as (select r.*, coalesce(mg.margin, 500) as margin, p.p90_mem, p.p90_min,
      greatest(cast(trunc(round(ma * r.input_size + mb + 2 * ms, 6)) as bigint), 100) as lm,
      greatest(cast(trunc(round(ta * r.input_size + tb + 2 * ts, 6)) as bigint), 10) as lt,
      case when r.input_size is null then 'missing_input' when r.input_size = 0 and p.p90_mem is not null then 'noinput_p90'
       when r.input_size = 0 or ft.n is null then 'no_model' when r.input_size <= ft.x_max + 0.01 or ft.n > 9 then 'model' else 'out_of_range' end as reason
      from requests r left join ft on r.program = ft.program and r.ref = ft.ref left join p90 p on r.program = p.program and r.ref = p.ref
      left join mg on r.program = mg.program and r.ref = mg.ref),
    est as (select *, case reason when 'model' then lm + margin when 'noinput_p90' then p90_mem + margin else mem_default end as est_mem,
      case reason when 'model' then lt + 10 when 'noinput_p90' then p90_min + 10 else min_default end as est_min from sc)"""


@query(f"with {ESTIMATE} select job_id, reason, cast(est_mem as bigint) as est_mem, cast(est_min as bigint) as est_min from est")
def estimate_resources(t):
    return md.estimate_resources(t.requests, t.ledger, t.extra).select("job_id", "reason", "est_mem", "est_min")


@query("""
    with m as (select program, ref, max(input_size) as x_max, count(*) as n from ledger where status = 'COMPLETED' and input_size <> 0
      group by program, ref)
    select r.job_id, cast(case when r.input_size <= x_max + 0.01 or n > 9 then greatest(cast(floor(0.01::double * r.input_size + 64) as bigint), 100) + 500
      else mem_default end as bigint) as est_mem
    from requests r left join m on r.program = m.program and r.ref = m.ref where r.input_size > 0""")
def score_models(t):
    pts = lg.ledger_points(t.ledger)
    m = pts.groupBy("program", "ref").agg(F.max("input_size").alias("x_max"), F.count(F.lit(1)).alias("n")).withColumns(
        {
            "mem_a": F.lit(0.01), "mem_b": F.lit(60.0), "mem_stdfit": F.lit(2.0), "time_a": F.lit(0.0),
            "time_b": F.lit(30.0), "time_stdfit": F.lit(0.0), "p90_mem": F.lit(None).cast("bigint"),
            "p90_min": F.lit(None).cast("bigint"), "margin": F.lit(None).cast("bigint"),
        }
    )
    return md.score_models(t.requests.filter("input_size > 0"), m).select("job_id", "est_mem")


PLACE = """case when partition_name = 'highmem' then 'highmem' when {t} <= 720 then 'short' when {t} <= 7200 then 'medium' else 'long' end"""


@query(f"""
    with q as (select job_id, partition_name, mem_default * (job_id % 90) as mem, min_default * (job_id % 400) as minutes from requests)
    select job_id, {PLACE.format(t='minutes')} as to_partition,
     cast(least(mem, case when partition_name = 'highmem' then 999000 else 249000 end) as bigint) as to_mem,
     cast(least(minutes, 43200) as bigint) as to_min from q""")
def assign_partition(t):
    jobs = t.requests.select(
        "job_id", "partition_name",
        (F.col("mem_default") * (F.col("job_id") % 90)).alias("mem"),
        (F.col("min_default") * (F.col("job_id") % 400)).alias("minutes"),
    )
    return pl.assign_partition(jobs, t.policy).select("job_id", "to_partition", "to_mem", "to_min")


@query("select job_id, 'site' as to_partition, cast(mem_default + 1 as bigint) as to_mem, min_default as to_min from requests")
def policy_hook(t):
    def site(jobs):
        return jobs.select(
            "job_id", F.lit("site").alias("to_partition"), (F.col("mem_default") + 1).alias("to_mem"),
            F.col("min_default").alias("to_min"),
        )

    return pl.assign_partition(t.requests, t.policy, hook=site)


@query(f"""
    with {ESTIMATE}, pl as (select *, {PLACE.format(t='est_min')} as p from est)
    select job_id, reason,
     case when est_mem = mem_default and est_min = min_default and partition_name is not null then partition_name else p end as to_partition,
     cast(least(est_mem, case when p = 'highmem' then 999000 else 249000 end) as bigint) as to_mem, cast(least(est_min, 43200) as bigint) as to_min
    from pl""")
def reserve_next_jobs(t):
    est = md.estimate_resources(t.requests, t.ledger, t.extra)
    return pl.place_estimates(est, t.policy).select("job_id", "reason", "to_partition", "to_mem", "to_min")


def _retry_rows(t):
    fails = lg.recent_failures(t.ledger, now(t), "30 days")
    extra = t.extra.groupBy("program", "ref").agg(F.max("extra_mb").alias("old_extra"))
    small = F.col("mem_alloc") * (F.col("job_id") % 15) / 10
    return (
        t.ledger.join(fails, ["program", "ref"], "left").join(extra, ["program", "ref"], "left")
        .withColumn("recent_fails", F.coalesce("recent_fails", F.lit(0)))
        .withColumn("mem_alloc", F.floor(small).cast("bigint"))
        .withColumn("partition_name", F.lit(None).cast("string"))
    )


RETRY = f"""f as (select program, ref, count(*) as recent_fails from ledger where status <> 'COMPLETED' and finish_ts > {NOW} - interval 30 day
      group by program, ref), x as (select program, ref, max(extra_mb) as old_extra from extra group by program, ref),
    j as (select l.* exclude (mem_alloc), cast(floor(l.mem_alloc * (l.job_id % 15) / 10) as bigint) as mem_alloc, coalesce(f.recent_fails, 0) as fails, x.old_extra
      from ledger l left join f on l.program = f.program and l.ref = f.ref left join x on l.program = x.program and l.ref = x.ref),
    g as (select *, greatest(coalesce(old_extra, 5), mem_alloc - mem_used + 1) as new_extra,
      case when mem_alloc < 100 then 800 when mem_alloc < 200 then 1000 when mem_alloc < 512 then 2048 when mem_alloc < 1024 then 3072
       when mem_alloc < 10240 then mem_alloc * 2 when mem_alloc < 51200 then mem_alloc * 1.5 else mem_alloc * 1.2 end as gm,
      case when min_used < 20 then 40 when min_used < 30 then 120 when min_used < 60 then 180 when min_used < 120 then 240
       when min_used < 480 then 720 else min_used * 1.2 end as gt, case when fails > 3 then 4 else 1 end as k from j),
    h as (select *, cast(trunc(cast(gm as decimal(18, 2)) * k * 1.2 + 2 * new_extra) as bigint) as new_mem,
      cast(trunc(cast(gt as decimal(18, 2)) * k * 1.2) as bigint) as new_min from g)"""


@query(f"with {RETRY} select job_id, cast(new_extra as bigint) as new_extra, new_mem from h where status in ('OOM', 'OOMOOT')")
def oom_retry(t):
    rows = _retry_rows(t).filter(F.col("status").isin("OOM", "OOMOOT"))
    return pl.oom_retry(rows).select("job_id", "new_extra", "new_mem")


@query(f"with {RETRY} select job_id, new_min from h where status in ('OOT', 'OOMOOT')")
def oot_retry(t):
    rows = _retry_rows(t).filter(F.col("status").isin("OOT", "OOMOOT"))
    return pl.oot_retry(rows).select("job_id", "new_min")


@query(f"""
    with {RETRY}, s as (select job_id, status, case when status in ('OOM', 'OOMOOT') then new_mem else mem_alloc end as mem,
      case when status in ('OOT', 'OOMOOT') then new_min else min_alloc end as minutes from h where status in ('OOM', 'OOT', 'OOMOOT'))
    select job_id, status, case when minutes <= 720 then 'short' when minutes <= 7200 then 'medium' else 'long' end as to_partition,
     cast(least(mem, 249000) as bigint) as to_mem, cast(least(minutes, 43200) as bigint) as to_min from s""")
def plan_retry(t):
    return pl.plan_retry(_retry_rows(t), t.policy).select("job_id", "status", "to_partition", "to_mem", "to_min")


CATEGORY = """concat(cast(job_id % 7 as varchar), '-', right(cast(job_id as varchar), 4), case status when 'COMPLETED' then ''
      when 'OOM' then '-M' when 'OOMOOT' then '-M' when 'OOT' then '-T' else concat('-', substr(status, 1, 3)) end) as category"""


@query(f"""
    select job_id, {CATEGORY}, mem_used + 2 * extra_mem as used, greatest(mem_alloc - mem_used - 2 * extra_mem, 0) as wasted,
     greatest(mem_default - mem_alloc, 0) as saved2, mem_default as default_mem,
     (select max(mem_default) from ledger) - mem_default as saved1 from ledger""")
def savings_mem(t):
    return sv.savings_mem(t.ledger)


@query(f"""
    select job_id, user_name, {CATEGORY}, min_used * core as used, greatest((min_alloc - min_used) * core, 0) as wasted,
     greatest((min_default - min_alloc) * core, 0) as saved, min_default * core as default_time,
     max(min_default * core) over (partition by user_name) - min_default * core as to_top from ledger""")
def savings_time(t):
    return sv.savings_time(t.ledger, ["user_name"])


@query("""
    with u as (select s.job_id, max(greatest(0, 4096 - reserved_mb)) as sv, max(mem_mb) as us, count(*) as minutes
      from samples s join sample_jobs j on s.job_id = j.job_id group by s.job_id),
    r as (select sum(greatest(mem_default - mem_alloc, 0)) as s2, sum((select max(mem_default) from ledger) - mem_default) as s1 from ledger)
    select job_id, minutes, round(0.0013::double * sv / 1024 * minutes / 60, 6) as job_dynamic,
     round(0.0013::double * (4096 - us) / 1024 * minutes / 60, 6) as job_split,
     round(0.0013::double * (select s2 from r) / 1024 * minutes / 60, 6) as run_dynamic,
     round(0.0013::double * (select s1 from r) / 1024 * minutes / 60, 6) as run_split from u""")
def savings_cost(t):
    used = usage.usage_vs_request(t.samples, t.sample_jobs)
    return r6(sv.savings_cost(used, sv.savings_mem(t.ledger)))


def _accounting(t):
    h = fu.elapsed_hours
    jobs = t.acct_jobs.withColumns(
        {"hours": h(F.col("elapsed")), "cpu_hours": h(F.col("total_cpu")), "limit_hours": h(F.col("time_limit"))}
    )
    return jobs, t.acct_steps.withColumn("hours", h(F.col("elapsed")))


EFF = """eff as (select * from (with s as (select j.job_id, sum(least(j.nodes * s.max_rss_gb, j.req_gb) * (s.eh + s.em / 60.0::double + s.es / 3600.0::double)) as used,
       max(j.nodes * s.max_rss_gb) as peak, bool_or(j.nodes * s.max_rss_gb > j.req_gb / 2) as half
       from acct_steps s join jobs_of j on s.job_id = j.job_id group by j.job_id)
      select user_name, count(*) as njobs, sum((eh + em / 60.0::double) * req_gb) / sum(eh + em / 60.0::double) as avg_req_gb,
       coalesce(sum(used), 0) / sum(eh + em / 60.0::double) as avg_used_gb, coalesce(max(peak), 0) as max_used_gb,
       cast(sum(case when half then 1 else 0 end) as bigint) as njobs_half,
       100 * sum(cd * 24 + eh + em / 60.0::double) / sum(ncpus * (eh + em / 60.0::double)) as core_eff,
       100 * sum(eh + em / 60.0::double) / sum(ld * 24) as wall_used
      from jobs_of j left join s on j.job_id = s.job_id group by user_name having sum(eh + em / 60.0::double) > 0) z)"""


@query("with jobs_of as (select * from acct_jobs), " + EFF + """
    select user_name, njobs, round(avg_req_gb, 6) as avg_req_gb, round(avg_used_gb, 6) as avg_used_gb, round(max_used_gb, 6) as max_used_gb,
     njobs_half, round(core_eff, 6) as core_eff, round(wall_used, 6) as wall_used from eff""")
def user_efficiency(t):
    return r6(efficiency.user_efficiency(*_accounting(t)))


@query("select job_id, user_name from acct_jobs where not starts_with(user_name, 'u1') and not starts_with(user_name, 'u40')")
def exclude_users(t):
    return efficiency.exclude_users(t.acct_jobs, ["u1", "u40"]).select("job_id", "user_name")


@query("""
    select o_orderkey as job_id, case when o_orderpriority = '5-LOW' then null else concat('short,', o_orderpriority) end as partition_name
    from orders where o_orderpriority <> '1-URGENT'""")
def exclude_interactive(t):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "interactive_long").when(
        F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("short,"), "o_orderpriority")
    )
    return efficiency.exclude_interactive(t.orders.select(F.col("o_orderkey").alias("job_id"), name.alias("partition_name")))


TIER = """case when njobs_half * 1000 < njobs * 5 then case when (njobs > 100 and avg_req_gb >= 20) or (njobs > 30 and avg_req_gb >= 32)
       or (njobs >= 20 and avg_req_gb >= 48) or (njobs >= 10 and avg_req_gb >= 96) or (njobs > 5 and avg_req_gb >= 200) then 'bad' else 'neutral' end
      when njobs_half * 1000 > njobs * 20 or avg_req_gb < 16 then 'good' else 'neutral' end"""
REPORT = """select c_custkey % 500 as u, count(*) * (1 + c_custkey % 500 % 40) as njobs, avg(c_acctbal) / 50 as avg_req_gb,
      cast(sum(case when c_acctbal < -900 + (c_custkey % 500) then 1 else 0 end) as bigint) as njobs_half from customer group by c_custkey % 500"""


def _report(t):
    u = F.col("c_custkey") % 500
    return t.customer.groupBy(u.alias("u")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("c_acctbal") / 50).alias("avg_req_gb"),
        F.sum(F.when(F.col("c_acctbal") < u - 900, 1).otherwise(0)).alias("njobs_half"),
    ).select(
        F.concat(F.lit("u"), F.col("u").cast("string")).alias("user_name"),
        (F.col("n") * (F.col("u") % 40 + 1)).alias("njobs"), "avg_req_gb", "njobs_half",
    )


@query(f"select concat('u', cast(u as varchar)) as user_name, {TIER} as tier from ({REPORT}) r")
def user_tier(t):
    return efficiency.user_tier(_report(t)).select("user_name", "tier")


@query(f"""
    with rep as ({REPORT}), cur as (select u, {TIER} as tier from rep),
    prev as (select u, {TIER} as last_tier from (select u, njobs, avg_req_gb / 3 as avg_req_gb, njobs_half * (u % 3) as njobs_half from rep where u % 10 <> 0) x)
    select concat('u', cast(cur.u as varchar)) as user_name, tier, last_tier, cast(cur.u % 2 as varchar) as fairshare,
     case when tier = 'bad' and cur.u % 2 = 1 then case when last_tier = 'good' then 'warn' else 'lower' end
      when tier = 'good' and cur.u % 2 = 0 then 'reset' else 'none' end as action
    from cur left join prev on cur.u = prev.u""")
def week_over_week(t):
    cur = _report(t)
    num = F.substring("user_name", 2, 9).cast("bigint")
    last = cur.filter(num % 10 != 0).withColumns(
        {"avg_req_gb": F.col("avg_req_gb") / 3, "njobs_half": F.col("njobs_half") * (num % 3)}
    )
    shares = cur.select("user_name", (num % 2).cast("string").alias("fairshare"))
    return efficiency.week_over_week(cur, last, shares)


@query(f"""
    select concat('u', cast(u as varchar)) as user_name, njobs, s_name as full_name from ({REPORT}) r left join supplier on s_suppkey = u
    where u not between 30 and 39 and u <> 3 and u not between 300 and 399""")
def report_recipients(t):
    names = t.supplier.select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("user_name"), F.col("s_name").alias("full_name"))
    return efficiency.report_recipients(_report(t), names, ["u3"]).select("user_name", "njobs", "full_name")
