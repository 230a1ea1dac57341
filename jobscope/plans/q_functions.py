"""Scalar expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.functions import jobs as fj
from jobscope.functions import units as fu
from jobscope.operators import files, reads
from jobscope.plans.registry import query, r6


@query("""
    select job_id, case when mem_text in ('4G', '4g', '4096M') then cast(4096 as bigint) else 2048 end as mem_mb,
     cast(core * 512 as bigint) as per_cpu_mb, cast(4096 as bigint) as default_mb
    from (select r.*, 1 + job_id % 4 as core from requests r) t""")
def mem_to_mb(t):
    core, none = F.col("job_id") % 4 + 1, F.lit(None).cast("string")
    return t.requests.select(
        "job_id",
        fu.mem_to_mb(F.col("mem_text"), none, core).alias("mem_mb"),
        fu.mem_to_mb(none, F.lit("512m"), core).alias("per_cpu_mb"),
        fu.mem_to_mb(none, none, core).alias("default_mb"),
    )


@query("""
    select job_id, cast(case time_text when '50' then 50 when '50:0' then 50 when '2:0:0' then 120
      when '1-02:30' then 1590 else 14400 end as bigint) as minutes,
     cast(24 * 60 * (job_id % 7) + 60 * (job_id % 20) as bigint) as day_hour
    from requests""")
def time_to_minutes(t):
    text = F.concat((F.col("job_id") % 7).cast("string"), F.lit("-"), F.lpad((F.col("job_id") % 20).cast("string"), 2, "0"))
    return t.requests.select(
        "job_id", fu.time_to_minutes(F.col("time_text")).alias("minutes"), fu.time_to_minutes(text).alias("day_hour")
    )


@query("""
    select job_id, concat(cast(min_used // 1440 as varchar), '-', lpad(cast((min_used % 1440) // 60 as varchar), 2, '0'), ':',
      lpad(cast(min_used % 60 as varchar), 2, '0'), ':00') as dhms
    from (select job_id, min_used * 37 as min_used from ledger) l""")
def minutes_to_dhms(t):
    return t.ledger.select("job_id", fu.minutes_to_dhms(F.col("min_used") * 37).alias("dhms"))


@query("""
    select job_id, round(eh + em / 60.0::double, 6) as elapsed_h, round(cd * 24 + eh + em / 60.0::double, 6) as cpu_h,
     cast(ld * 24 as double) as limit_h, round(em / 60.0::double, 6) as short_h,
     round(em / 60.0::double + eh / 3600.0::double, 6) as milli_h
    from acct_jobs""")
def elapsed_hours(t):
    mm, ss = F.lpad(F.col("em").cast("string"), 2, "0"), F.lpad(F.col("eh").cast("string"), 2, "0")
    h = fu.elapsed_hours
    return r6(
        t.acct_jobs.select(
            "job_id", h(F.col("elapsed")).alias("elapsed_h"), h(F.col("total_cpu")).alias("cpu_h"),
            h(F.col("time_limit")).alias("limit_h"), h(F.concat(mm, F.lit(":"), ss)).alias("short_h"),
            h(F.concat(mm, F.lit(":"), ss, F.lit(".250"))).alias("milli_h"),
        )
    )


@query("select job_id, req_gb from acct_jobs")
def tres_mem_gb(t):
    text = F.concat(F.lit("billing=4,cpu=8,gres/gpu=1,mem="), F.col("req_gb").cast("string"), F.lit("G,node=1"))
    return t.acct_jobs.select("job_id", fu.tres_mem_gb(text).alias("req_gb"))


@query("""
    select job_id, case status when 'Unknown' then case when job_id % 2 = 0 then 'OOM' else 'Unknown' end else status end as status
    from ledger""")
def job_status(t):
    state = F.element_at(
        F.create_map(
            *[F.lit(x) for kv in {
                "COMPLETED": "COMPLETED", "OOM": "OUT_OF_ME+", "OOT": "TIMEOUT", "OOMOOT": "TIMEOUT OUT_OF_ME+",
                "Fail": "FAILED", "Canceled": "CANCELLED+", "Unknown": "RUNNING",
            }.items() for x in kv]
        ),
        F.col("status"),
    )
    tail = F.when(
        F.col("job_id") % 2 == 0, F.lit("done\nsrun: error: n1: task 0: Out Of Memory")
    ).otherwise(F.lit("task 0: Out Of Memory\nsrun: end"))
    return t.ledger.select("job_id", fj.job_status(F.col("status") == "COMPLETED", state, tail).alias("status"))


@query("""
    select job_id, case when status = 'COMPLETED' then 2 when status in ('Fail', 'OOM', 'OOT', 'Canceled') then 1 else 0 end as code
    from ledger""")
def state_code(t):
    s = F.col("status")
    text = (
        F.when(s == "Fail", "FAILED").when(s == "OOM", "OUT_OF_MEMORY").when(s == "OOT", "TIMEOUT")
        .when(s == "Canceled", "CANCELLED by 12").when(s == "COMPLETED", "COMPLETED").when(s == "Unknown", "")
        .otherwise("RUNNING")
    )
    return t.ledger.select("job_id", fj.state_code(text).alias("code"))


@query("""
    select p_partkey, case p_partkey % 3 when 0 then p_brand when 1 then concat('tool', cast(p_partkey % 11 as varchar), '.sh')
      else concat('run_', cast(p_size as varchar), '.sh') end as program
    from part""")
def program_of(t):
    k = F.col("p_partkey")
    tool = F.concat(F.lit("/opt/bin/tool"), (k % 11).cast("string"), F.lit(".sh"))
    cmd = F.when(k % 3 == 1, F.concat(F.when(k % 2 == 0, F.lit("bash ")).otherwise(F.lit("")), tool, F.lit(" -x 1")))
    script = F.concat(F.lit("/home/run_"), F.col("p_size").cast("string"), F.lit(".sh"))
    return t.part.select("p_partkey", fj.program_of(F.when(k % 3 == 0, F.col("p_brand")), cmd, script).alias("program"))


@query("""
    select p_partkey, case when p_partkey % 3 = 0 then concat(replace(p_type, ' ', ''), '.', replace(p_name, ' ', ''), '.fq')
      when p_partkey % 3 = 1 then concat(replace(p_type, ' ', ''), '.', substr(md5(cast(p_partkey as varchar)), 1, 8))
      else concat('a-b.', cast(p_size as varchar)) end as flag
    from part""")
def job_flag(t):
    k = F.col("p_partkey")
    inputs = F.when(k % 3 == 0, F.concat(F.lit("dir/sub/"), F.col("p_name"), F.lit(".fq")))
    given = F.when(k % 3 == 2, F.concat(F.lit("a/b.."), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", fj.job_flag(given, F.col("p_type"), inputs, k).alias("flag"))


@query("""
    select p_partkey, case when p_size % 4 = 0 then 'none' else concat(p_brand, '-', replace(p_name, '/', '-')) end as ref
    from part""")
def ref_key(t):
    ref = F.when(F.col("p_size") % 4 != 0, F.concat("p_brand", F.lit("/"), "p_name"))
    return t.part.select("p_partkey", fj.ref_key(ref).alias("ref"))


@query("""
    select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority else concat('g', cast(o_custkey as varchar)) end as program,
     cast(1 + o_custkey % 8 as bigint) as threads, concat('in/', cast(o_orderkey as varchar), '.fq ref.fa') as inputs
    from orders""")
def task_properties(t):
    k = F.col("o_orderkey")
    text = F.to_json(
        F.struct(
            F.when(k % 2 == 0, F.col("o_orderpriority")).alias("rule"),
            F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("groupid"),
            (F.col("o_custkey") % 8 + 1).alias("threads"),
            F.array(F.concat(F.lit("in/"), k.cast("string"), F.lit(".fq")), F.lit("ref.fa")).alias("input"),
        )
    )
    return t.orders.select("o_orderkey", fj.task_properties(text).alias("p")).select("o_orderkey", "p.*")


@query("""
    with parts as (select o_orderkey, o_custkey % 6 as a, o_custkey % 6 + 3 as b, o_custkey % 11 as c from orders),
    x as (select o_orderkey, unnest(list_concat(range(a, b + 1), [c])) as i from parts)
    select p.o_orderkey, coalesce(string_agg(cast(i as varchar), ',' order by i), '') as picked
    from parts p left join (select distinct o_orderkey, i from x where i < 8) y on p.o_orderkey = y.o_orderkey
    group by p.o_orderkey""")
def index_list(t):
    a, c = F.col("o_custkey") % 6, F.col("o_custkey") % 11
    text = F.concat(a.cast("string"), F.lit("-"), (a + 3).cast("string"), F.lit(", "), c.cast("string"), F.lit(",x,7-2,99999999999"))
    return t.orders.select(
        "o_orderkey", F.array_join(fj.index_list(text, F.lit(8)), ",").alias("picked")
    )


@query("""
    select job_id, case when job_id % 4 = 0 then cast(job_id as bigint) end as literal_size,
     case when job_id % 4 = 0 then cast(null as bigint) else 2 + job_id % 2 end as n_refs
    from requests""")
def input_refs(t):
    k = F.col("job_id")
    text = F.when(k % 4 == 0, F.concat(F.lit(",jobSize:"), k.cast("string"))).otherwise(
        F.concat(F.lit(",a.fq b.fq"), F.when(k % 2 == 1, F.lit(",c.fq")).otherwise(F.lit("")))
    )
    return t.requests.select(
        "job_id", fj.job_size(text).alias("literal_size"),
        F.when(fj.input_refs(text).isNotNull(), F.size(fj.input_refs(text))).cast("bigint").alias("n_refs"),
    )


@query("""
    select row_id, concat('group', cast(cast(grp as int) as varchar), '/', sample, '/', library, '_', lane, '_1.fq',
      case row_id % 3 when 0 then '.gz' when 1 then '.bz2' else '' end) as link1,
     concat('group', cast(cast(grp as int) as varchar), '/', sample, '/', library, '_', lane, '_2.fq') as link2
    from sheet""")
def link_path(t):
    k = F.col("row_id")
    ext = F.when(k % 3 == 0, ".gz").when(k % 3 == 1, ".bz2").otherwise("")
    padded = F.lpad("grp", 4, "0")
    args = [padded, F.col("sample"), F.col("library"), F.col("lane")]
    return t.sheet.select(
        "row_id",
        fj.link_path(*args, 1, F.concat("read1", ext)).alias("link1"),
        fj.link_path(*args, 2, F.col("read2")).alias("link2"),
    )


@query("""
    select job_id, cast(job_id % 7 as varchar) as step, concat(cast(job_id % 7 as varchar), '.0') as identity from graph""")
def step_of(t):
    return t.graph.select("job_id", fj.step_of(F.col("flag")).alias("step"), fj.step_identity(F.col("flag")).alias("identity"))


@query("""
    select o_orderkey as script_id, concat(cast(1 + o_custkey % 30 as varchar), 'G') as mem,
     case when o_custkey % 2 = 0 then cast(1 + o_custkey % 8 as varchar) end as core,
     case when o_orderkey % 3 = 0 then '9:00:00' else concat(cast(o_custkey % 24 as varchar), ':30:00') end as time,
     o_orderpriority as name
    from orders""")
def sbatch_directives(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    texts = F.array(
        F.lit("#!/bin/bash"),
        F.concat(F.lit("#SBATCH --mem="), (c % 30 + 1).cast("string"), F.lit("G")),
        F.lit("#SBATCH --mem 99G"),
        F.when(c % 2 == 0, F.concat(F.lit("#SBATCH -c "), (c % 8 + 1).cast("string"))).otherwise(F.lit("# none")),
        F.concat(F.lit("#SBATCH --time="), (c % 24).cast("string"), F.lit(":30:00")),
        F.concat(F.lit("#SBATCH  --job-name="), F.replace("o_orderpriority", F.lit(" "), F.lit("_"))),
        F.lit("#SBATCH -J later"),
    )
    lines = t.orders.select(k.alias("script_id"), F.posexplode(texts).alias("line_no", "text"))
    cli = t.orders.select(k.alias("script_id"), F.when(k % 3 == 0, "9:00:00").alias("time"))
    out = files.sbatch_directives(lines, cli)
    names = t.orders.select(k.alias("script_id"), "o_orderpriority")
    # the blank inside a priority was replaced for the directive: put the given text back
    return out.join(names, ["script_id"]).select(
        "script_id", "mem", "core", "time",
        F.when(F.col("name") == F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.col("o_orderpriority")).alias("name"),
    )


@query("""
    select frag_id, substr(qname, 1, strpos(qname, ':') - 1) as umi,
     concat(substr(concat(substr(qname, 1, 4), 'TTGGCC'), 1, 6), substr(concat('AC', substr(qname, 1, 4), 'GG'), 1, 6)) as dual
    from reads""")
def umi_of(t):
    head = F.substring("qname", 1, 4)
    return t.reads.select(
        "frag_id", fj.umi_of(F.col("qname")).alias("umi"),
        fj.umi_extract(F.concat(head, F.lit("TTGGCC")), F.concat(F.lit("AC"), head, F.lit("GG"))).alias("dual"),
    )


@query("""
    select concat('c', cast(c_custkey as varchar)) as file, cast(1000000 + c_custkey * 1000 as bigint) as pairs,
     concat('p', cast(c_nationkey as varchar)) as part
    from customer""")
def log_metric(t):
    k = F.col("c_custkey")
    texts = F.array(
        F.lit("This is a trimming log"),
        F.concat(F.lit("Total read pairs processed:   "), F.format_number(k * 1000 + 1000000, 0)),
        F.concat(F.lit("#myMem=4G myPartition=p"), F.col("c_nationkey").cast("string"), F.lit(" myTime=1")),
    )
    lines = t.customer.select(
        F.concat(F.lit("c"), k.cast("string")).alias("file"), F.posexplode(texts).alias("line_no", "line")
    )
    pairs = files.log_metric(lines, "Total read pairs processed:\\s+([0-9,]+)", "pairs")
    return pairs.join(files.log_tag(lines, "myPartition").withColumnRenamed("value", "part"), ["file"])
