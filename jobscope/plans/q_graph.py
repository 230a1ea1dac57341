"""Job graphs and annotated scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import graph as g
from jobscope.plans.registry import query
from jobscope.session import as_written

EDGES = """edges as (select distinct unnest(case when depend_on = 'null' then [] else string_split(depend_on, ':') end)::bigint as dep, job_id from graph)"""
STATE = """st as (select g.job_id, g.depend_on, g.flag,
      case when m.s then 'succeeded' when m.f then 'failed' when m.r then 'requeued' when q.code = 'R' then 'running' when q.code = 'PD' then 'pending' else 'unknown' end as state,
      case when m.s then 'succeeded' when m.f then 'failed' when q.code = 'R' then 'running' when q.code = 'PD' then 'pending' when m.r then 'requeued' else 'unknown' end as console
      from graph g left join (select flag, bool_or(kind = 'success') as s, bool_or(kind = 'failed') as f, bool_or(kind = 'requeued') as r from markers group by flag) m on g.flag = m.flag
      left join queue q on g.job_id = q.job_id)"""


def _state(t, order="chart"):
    return g.job_state(t.graph, t.markers, t.queue, order=order)


@query(f"with {EDGES} select dep, job_id from edges")
def job_edges(t):
    return g.job_edges(t.graph)


@query(f"with {STATE} select job_id, case when job_id > (select max(job_id) - 30 from graph) then 'requeued' else state end as state, console from st")
def job_state(t):
    top = t.graph.agg(F.max("job_id")).scalar()
    again = t.graph.filter(F.col("job_id") > top - 30).select("job_id")
    chart = g.job_state(t.graph, t.markers, t.queue, again)
    return chart.select("job_id", "state").join(
        _state(t, "console").select("job_id", F.col("state").alias("console")), ["job_id"]
    )


@query(f"""
    with {STATE}, {EDGES},
    hit as (select job_id from st where state = 'failed' union
      select e.job_id from hit h join edges e on e.dep = h.job_id join st s on s.job_id = e.job_id where s.state not in ('succeeded', 'failed', 'cancelled'))
    select job_id, case when state <> 'failed' and job_id in (select job_id from hit) then 'cancelled' else state end as state from st""")
def propagate_cancel(t):
    return g.propagate_cancel(_state(t).select("job_id", "state"), g.job_edges(t.graph))


@query(f"""
    with {STATE}, {EDGES}, fin as (select job_id from st where state = 'running')
    select e.job_id from edges e left join st s on s.job_id = e.dep left join fin f on f.job_id = e.dep group by e.job_id
    having bool_and(coalesce(s.state = 'succeeded', false) or f.job_id is not null) and bool_or(f.job_id is not null)""")
def ready_jobs(t):
    state = _state(t).select("job_id", "state")
    return g.ready_jobs(g.job_edges(t.graph), state, state.filter(F.col("state") == "running"))


@query("""
    with mp as (select job_id as old_id, job_id + 1000000000 as new_id from graph where st = 'P')
    select coalesce(a.new_id, g.job_id) as job_id, flag,
     case when depend_on = 'null' then 'null' else concat(cast(coalesce(b.new_id, cast(string_split(depend_on, ':')[1] as bigint)) as varchar),
      case when contains(depend_on, ':') then concat(':', cast(coalesce(c.new_id, cast(string_split(depend_on, ':')[2] as bigint)) as varchar)) else '' end) end as depend_on
    from graph g left join mp a on a.old_id = g.job_id left join mp b on cast(b.old_id as varchar) = string_split(depend_on, ':')[1]
     left join mp c on cast(c.old_id as varchar) = string_split(depend_on, ':')[2]""")
def replace_job(t):
    renamed = t.graph.filter(F.col("st") == "P").select(F.col("job_id").alias("old_id"), (F.col("job_id") + 1000000000).alias("new_id"))
    return g.replace_job(t.graph, renamed).select("job_id", "flag", "depend_on")


@query("select g.job_id, g.flag from graph g where g.job_id in (select job_id from queue)")
def active_jobs(t):
    return g.active_jobs(t.graph, t.queue).select("job_id", "flag")


SUMMARY = """select {k} count(*) as total, count(*) filter (where state = 'succeeded') as succ, count(*) filter (where state = 'requeued') as requeue,
      count(*) filter (where state = 'running') as running, count(*) filter (where state = 'pending') as pending,
      count(*) filter (where state = 'failed') as fail, count(*) filter (where state = 'unknown') as unknown from st {g}"""


@query(f"""
    with {STATE}, c as ({SUMMARY.format(k="split_part(flag, '.', 1) as step,", g="group by 1")})
    select *, succ + fail + requeue as done, concat(succ + fail + requeue, '/', total, ' Succ:', succ, '/', total, ' Requeue:', requeue, '/', total,
      ' Running:', running, '/', total, ' Pending:', pending, '/', total, ' Fail:', fail, '/', total, ' Unknown:', unknown, '/', total) as text,
     running = 0 and pending = 0 as finished from c""")
def run_summary(t):
    return g.run_summary(_state(t).withColumn("step", F.substring_index("flag", ".", 1)), ["step"])


@query("""
    select job_id, split_part(flag, '.', 1) as step, (rn - 1) // 5 as wave, rn > 5 as held
    from (select *, row_number() over (partition by split_part(flag, '.', 1) order by job_id) as rn from
      (select job_id, flag, case when st <> 'O' then 'null' else depend_on end as depend_on from graph) g where depend_on = 'null') x""")
def first_batch_hold(t):
    free = t.graph.withColumn("depend_on", F.when(F.col("st") != "O", "null").otherwise(F.col("depend_on")))
    return g.first_batch_hold(free).select("job_id", "step", "wave", "held")


@query(f"""
    with {EDGES}, n as (select g.job_id, g.depend_on, g.st, coalesce(m.w, false) as won, q.job_id is not null as act,
      case when g.job_id % 5 = 0 then 'null' else g.depend_on end as old_deps, split_part(g.flag, '.', 1) in ('2', '5') as again
      from graph g left join (select flag, bool_or(kind = 'success') as w from markers group by flag) m on g.flag = m.flag left join queue q on q.job_id = g.job_id),
    need as (select job_id from n where not won or again union select e.job_id from need x join edges e on e.dep = x.job_id),
    sub as (select n.job_id from n join need on need.job_id = n.job_id where not (act and old_deps = depend_on)
      union select e.job_id from sub x join edges e on e.dep = x.job_id)
    select n.job_id, case when need.job_id is null then 'skip' when sub.job_id is null then 'keep' when act then 'resubmit' else 'submit' end as action
    from n left join need on need.job_id = n.job_id left join sub on sub.job_id = n.job_id""")
def rerun_plan(t):
    prior = t.graph.join(t.queue.select("job_id", F.lit(True).alias("active")), ["job_id"], "left").select(
        "flag",
        F.when(F.col("job_id") % 5 == 0, "null").otherwise(F.col("depend_on")).alias("depend_on"),
        F.coalesce("active", F.lit(False)).alias("active"),
    )
    return g.rerun_plan(t.graph.drop("st"), t.markers, prior, rerun_steps=["2", "5"]).select("job_id", "action")


@query("""
    select concat('run', cast(o_custkey as varchar)) as folder, count(*) as jobs,
     arg_max(o_orderstatus, o_orderkey) = 'F' as dry_run, 'folder' as kind from orders group by o_custkey
    union all
    select concat('log', cast(o_custkey as varchar)), count(*) filter (where o_orderstatus <> 'P'), not bool_or(o_orderstatus = 'P'), 'file'
    from orders group by o_custkey""")
def run_catalog(t):
    o = t.orders
    job = F.concat(F.when(F.col("o_orderstatus") == "F", "0").otherwise("7"), F.col("o_orderkey").cast("string"))
    runs = o.select(
        F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("folder"),
        F.col("o_orderkey").alias("line_no"), job.alias("job_id"),
    )
    line = F.when(F.col("o_orderstatus") == "P", "run with useTmp run").otherwise(
        F.concat(F.lit("Submitted batch job "), F.col("o_orderkey").cast("string"))
    )
    logs = o.select(F.concat(F.lit("log"), F.col("o_custkey").cast("string")).alias("folder"), line.alias("line"))
    return g.run_catalog(runs, logs)


PATHS = """case when line_no between 3 and 6 then 'i' when line_no = 2 and looped then 'i' when line_no between 7 and 10 then 'i.j'
      when line_no between 11 and 13 then 'i' else '' end"""


@query(f"""
    select script_id, line_no, {PATHS} as path, cast(length(replace({PATHS}, '.', '')) as bigint) as depth
    from (select *, max(case when line_no = 2 then text <> '' end) over (partition by script_id) as looped from script_lines) s""")
def loop_paths(t):
    return g.loop_paths(t.script_lines).select("script_id", "line_no", F.array_join("loop_path", ".").alias("path"), "depth")


@query("""
    with f as (select *, string_split(substr(ltrim(text), 3), ',') as p from script_lines where starts_with(ltrim(text), '#@')),
    s as (select script_id, line_no, coalesce(p[1], '') as step, coalesce(p[2], '') as deps, replace(split_part(coalesce(p[3], ''), ':', 1), '.NoCheckpoint', '') as name,
      split_part(coalesce(p[4], ''), ':', 1) as ref, coalesce(p[5], '') as inputs, coalesce(p[6], '') as options,
      case line_no when 4 then 'i' when 8 then 'i.j' when 12 then 'i' else '' end as path from f)
    select *, case when step = '' or deps = '' or name = '' then 'missing_field' when contains(concat(name, ref, inputs), 'sbatch') then 'options_in_wrong_field'
      when options <> '' and not starts_with(options, 'sbatch') then 'bad_options' when contains(options, ' -a ') then 'job_array'
      when row_number() over (partition by script_id, step order by line_no) > 1 then 'duplicate_step' end as violation from s""")
def annotations(t):
    return g.annotations(t.script_lines).select(
        "script_id", "line_no", "step", "deps", "name", "ref", "inputs", "options",
        F.array_join("loop_path", ".").alias("path"), "violation",
    )


def _jobs(t):
    """Jobs of the loops 1..3 and 1..2 of every sound script."""
    sound = g.annotations(t.script_lines).filter("violation is null")
    steps = as_written(sound.select("script_id", "step", "deps", "loop_path"), "steps")
    i = F.explode(F.when(F.array_contains("loop_path", "i"), F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0))))
    j = F.explode(F.when(F.array_contains("loop_path", "j"), F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    jobs = steps.withColumn("i", i).withColumn("j", j).select(
        "script_id", "step",
        (F.col("script_id") * 1000 + F.col("step").cast("bigint") * 100 + F.col("i") * 10 + F.col("j")).alias("job_id"),
        F.array_compact(F.array(F.when(F.col("i") > 0, F.col("i")), F.when(F.col("j") > 0, F.col("j")))).alias("values"),
    )
    return steps, jobs


JOBS = """ok as (select s.script_id from script_lines s group by 1),
    f as (select *, string_split(substr(ltrim(text), 3), ',') as p from script_lines where starts_with(ltrim(text), '#@')),
    a as (select script_id, line_no, p[1] as step, p[2] as deps, coalesce(p[3], '') as name, coalesce(p[6], '') as options,
      case line_no when 4 then 1 when 8 then 2 when 12 then 1 else 0 end as d, row_number() over (partition by script_id, p[1] order by line_no) as rn from f),
    s as (select * from a where not (name = '' or (options <> '' and not starts_with(options, 'sbatch')) or contains(options, ' -a ') or rn > 1)),
    jb as (select script_id, step, deps, d, i, j, script_id * 1000 + cast(step as bigint) * 100 + i * 10 + j as job_id
      from s, unnest(case when d >= 1 then [1, 2, 3] else [0] end) t(i), unnest(case when d >= 2 then [1, 2] else [0] end) u(j)),
    dp as (select distinct script_id, step, d, unnest(string_split(deps, '.')) as dep_step from s),
    pr as (select x.job_id, x.script_id, x.step, dp.dep_step, y.job_id as dep_job from jb x join dp on dp.script_id = x.script_id and dp.step = x.step
      join s z on z.script_id = x.script_id and z.step = dp.dep_step
      join jb y on y.script_id = x.script_id and y.step = dp.dep_step and (least(x.d, z.d) < 1 or x.i = y.i) and (least(x.d, z.d) < 2 or x.j = y.j))"""


@query(f"""
    with {JOBS} select script_id, step, job_id, dep_step, count(*) as n_deps, min(dep_job) as first_dep, max(dep_job) as last_dep from pr
    group by script_id, step, job_id, dep_step""")
def expand_dependencies(t):
    links, _ = g.dependency_groups(*_jobs(t))
    return links.drop("loop_values")


@query(f"""
    with {JOBS} select distinct script_id, dep_step, dep_job from pr""")
def dependency_members(t):
    _, members = g.dependency_groups(*_jobs(t))
    return members.select("script_id", "dep_step", "dep_job").distinct()


# jobs of the expanded scripts with a state made from their ids
WAITS = f"""{JOBS},
    js as (select distinct job_id, case job_id % 11 when 0 then 'failed' when 1 then 'running' when 2 then 'pending' when 3 then 'unknown' else 'succeeded' end as state from jb)"""


def _expanded(t):
    steps, jobs = _jobs(t)
    jobs = as_written(jobs, "jobs")
    state = F.element_at(F.array(*[F.lit(x) for x in ("failed", "running", "pending", "unknown")]), (F.col("job_id") % 11 + 1).cast("int"))
    state = F.when(F.col("job_id") % 11 < 4, state).otherwise("succeeded")
    # both are walked several times
    links, members = g.dependency_groups(steps, jobs, kept=True)
    return links, members, jobs.select("job_id", state.alias("state")).distinct()


@query(f"""
    with {WAITS}, hit as (select job_id from js where state = 'failed' union
      select p.job_id from hit h join pr p on p.dep_job = h.job_id join js on js.job_id = p.job_id where js.state not in ('succeeded', 'failed', 'cancelled'))
    select job_id, case when state <> 'failed' and job_id in (select job_id from hit) then 'cancelled' else state end as state from js""")
def cancel_expanded(t):
    links, members, state = _expanded(t)
    return g.group_cancel(state, links, members)


@query(f"""
    with {WAITS} select p.job_id from pr p join js on js.job_id = p.dep_job group by p.job_id
    having bool_and(state in ('succeeded', 'running')) and bool_or(state = 'running')""")
def ready_expanded(t):
    links, members, state = _expanded(t)
    return g.group_ready(links, members, state, state.filter("state = 'running'"))


@query(f"""
    with {WAITS},
    n as (select job_id, state = 'succeeded' and job_id % 1000 // 100 <> 3 as done, state in ('running', 'pending') as act from js),
    need as (select job_id from n where not done union select p.job_id from need x join pr p on p.dep_job = x.job_id),
    sub as (select n.job_id from n join need on need.job_id = n.job_id where not (act and n.job_id % 5 <> 0)
      union select p.job_id from sub x join pr p on p.dep_job = x.job_id)
    select n.job_id, case when need.job_id is null then 'skip' when sub.job_id is null then 'keep' when act then 'resubmit' else 'submit' end as action
    from n left join need on need.job_id = n.job_id left join sub on sub.job_id = n.job_id""")
def rerun_expanded(t):
    """Every fifth job waited for something else the last time; step 3 is run again."""
    links, members, state = _expanded(t)
    lists = g.group_lists(links, members)
    flag = F.concat_ws(".", (F.col("job_id") % 1000).substr(1, 1), F.lit("0"), F.col("job_id"))
    jobs = as_written(state.join(lists, ["job_id"], "left").withColumn("flag", flag), "expanded")
    prior = jobs.select(
        "flag", F.when(F.col("job_id") % 5 == 0, "other").otherwise(F.col("depend_on")).alias("depend_on"),
        F.col("state").isin("running", "pending").alias("active"),
    )
    markers = jobs.filter("state = 'succeeded'").select("flag", F.lit("success").alias("kind"))
    return g.rerun_plan(
        jobs.select("job_id", "flag", "depend_on"), markers, prior, rerun_steps=["3"], groups=(links, members), columns=["job_id"]
    ).select("job_id", "action")
