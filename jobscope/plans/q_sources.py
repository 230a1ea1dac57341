"""Readers and writers: the given tables are written in a source's own form and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobscope.operators import efficiency, ledger as lg, models as md
from jobscope.plans.q_ledger import EFF, _accounting, _fit, PER_SIZE, later_half
from jobscope.plans.q_reads import mates
from jobscope.plans.registry import day, query, r6
from jobscope.schemas import PROSEQ_SHEET
from jobscope.session import as_written, scratch_path
from jobscope.sources import readers, sinks

# fixed value: head of the ledger header
LEDGER_HEAD = "1jobID,2inputSize,3memDefault,4timeDefaut,5memAllocated,6timeAllocated"


def _write(t, lines, name):
    """lines: one text column; several lines per value are fine."""
    path = scratch_path(t.spark, name)
    lines.write.text(path)
    return path


def _record(t):
    size = F.when(F.col("status") == "Fail", "missingInputFile").otherwise(F.col("input_size").cast("string"))
    s = lambda c: F.col(c).cast("string")
    return F.concat_ws(
        ",", s("job_id"), size, s("mem_default"), s("min_default"), s("mem_alloc"), s("min_alloc"), s("mem_used"),
        s("min_used"), "status", "user_name", s("mem_used"), "program", "ref", "flag", s("core"), s("extra_mem"),
        F.lit("10"), F.lit("0.50"), F.lit("0.25"), F.date_format("finish_ts", "EEE MMM dd HH:mm:ss 'UTC' yyyy"),
        F.unix_timestamp("finish_ts").cast("string"),
    )


LEDGER_BACK = """select job_id, case when status = 'Fail' then null else input_size end as input_size, status = 'Fail' as missing_input,
     mem_alloc, min_used, status, program, ref, flag, 0.25::double as ratio_time, cast(epoch(finish_ts) as bigint) as epoch from ledger"""
LEDGER_COLS = ["job_id", "input_size", "missing_input", "mem_alloc", "min_used", "status", "program", "ref", "flag", "ratio_time", "epoch"]


@query(LEDGER_BACK)
def read_ledger(t):
    rows = t.ledger.select(_record(t).alias("value"))
    head = t.spark.createDataFrame([(LEDGER_HEAD,)], "value string")
    return readers.read_ledger(t.spark, _write(t, rows.unionByName(head), "ledger")).select(*LEDGER_COLS)


@query(LEDGER_BACK)
def read_plot_records(t):
    log = F.concat(F.lit("Job summary:\n\ndataToPlot,"), _record(t), F.lit("\nFinal mem: 1 M"))
    return readers.read_plot_records(t.spark, _write(t, t.ledger.select(log), "logs")).select(*LEDGER_COLS)


def _jobs_with_steps(t):
    """Accounting text of all jobs, read back: a row per job with its number of steps and their memory."""
    s = lambda c: F.col(c).cast("string")
    tres = F.concat(F.lit("billing=9,cpu="), s("ncpus"), F.lit(",mem="), s("req_gb"), F.lit("G,node="), s("nodes"))
    job = F.concat_ws("|", s("nodes"), "user_name", F.lit(""), "elapsed", s("ncpus"), "total_cpu", "time_limit", tres)
    step = lambda i: F.concat(F.lit("1||"), (i * 0.5).cast("string"), F.lit("G|00:30:00|1|00:10:00||cpu=1"))
    steps = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("job_id") % 3 + 1), step)
    path = _write(t, t.acct_jobs.select(F.concat_ws("\n", job, F.array_join(steps, "\n"))), "accounting")
    jobs, parts = readers.read_accounting(t.spark, path)
    per_job = parts.groupBy("job_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("max_rss_gb").alias("rss"))
    return jobs.join(per_job, ["job_id"], "left")


@query("""
    with j as (select job_id, user_name, req_gb, nodes, eh + em / 60.0::double as h, 1 + job_id % 3 as k from acct_jobs)
    select user_name, sum(k) as steps, count(*) as jobs, round(sum(req_gb), 6) as req_gb, round(sum(h), 6) as hours, round(sum(0.5::double * k * (k + 1) / 2), 6) as rss
    from j group by user_name""".replace("sum(k) as steps", "cast(sum(k) as bigint) as steps"))
def read_accounting(t):
    return r6(
        _jobs_with_steps(t).groupBy("user_name").agg(
            F.sum("steps").alias("steps"), F.count(F.lit(1)).alias("jobs"), F.sum("req_gb").alias("req_gb"),
            F.sum("hours").alias("hours"), F.sum("rss").alias("rss"),
        )
    )


@query("""
    select user_name, nodes, round(req_gb, 6) as req_gb, round(eh + em / 60.0::double, 6) as hours, ncpus, cast(1 + job_id % 3 as bigint) as steps,
     round(0.5::double * (1 + job_id % 3) * (2 + job_id % 3) / 2, 6) as rss from acct_jobs""")
def accounting_rows(t):
    return r6(_jobs_with_steps(t).select("user_name", "nodes", "req_gb", "hours", "ncpus", "steps", "rss"))


@query("""
    select cast(user_id % 16 as varchar) as job_id, case when is_marker then 0 else seq % 60 end as minute, case when is_marker then 0 else mem_mb end as mem_mb,
     case when is_marker then 0 else 4096 - mem_mb end as wasted_mb, is_marker, case when is_marker then cast(epoch(date_trunc('second', ts)) as bigint) end as epoch
    from (select *, job_id as user_id from samples) s""")
def read_samples(t):
    s = lambda c: c.cast("string")
    row = F.when(
        F.col("is_marker"), F.concat(F.lit("0 0 0 0 0 "), s(F.unix_timestamp("ts")), F.lit(" jobID:x time:y"))
    ).otherwise(F.concat_ws(" ", s(F.col("seq") % 60), s(F.col("mem_mb")), s(4096 - F.col("mem_mb")), F.lit("0"), s(F.col("cpu_pct"))))
    path = scratch_path(t.spark, "samples")
    t.samples.select((F.col("job_id") % 16).alias("job"), row.alias("value")).repartition("job").write.partitionBy("job").text(path)
    # one folder per job here: the id comes from the folder instead of the file
    back = readers.read_samples(t.spark, f"{path}/job=*")
    return back.select("job_id", "minute", "mem_mb", "wasted_mb", "is_marker", "epoch")


@query("select cast(job_id as varchar) as job_id, depend_on, flag from graph")
def read_job_graph(t):
    row = F.concat_ws("   ", F.col("job_id").cast("string"), "depend_on", "flag", F.lit("prog none none"))
    head = F.concat(F.lit("job_id   depend_on  flag program\n\nTue Dec\n"), row)
    path = _write(t, t.graph.select(F.when(F.col("job_id") % 100 == 0, head).otherwise(row)), "graph")
    return readers.read_job_graph(t.spark, path).select("job_id", "depend_on", "flag")


@query("select grp, sample, library, lane, path, read1, nullif(read2, '') as read2 from sheet")
def read_sheet(t):
    path = scratch_path(t.spark, "sheet")
    cols = ["grp", "sample", "library", "lane", "path", "read1", "read2"]
    blank = t.spark.createDataFrame([[None] * len(cols)], ", ".join(f"{c} string" for c in cols))
    t.sheet.select(*cols).unionByName(blank).write.csv(path, header=True, emptyValue="")
    return readers.read_sheet(t.spark, path, "folders")


@query("select read1, case when read2 = '' then '-' else read2 end as read2, coalesce(sample, 'none') as sample, replace(condition, ' ', '') as condition from manifest")
def read_manifest(t):
    row = F.concat_ws(
        " \t ", "read1", F.when(F.col("read2") == "", "-").otherwise(F.col("read2")), F.coalesce("sample", F.lit("none")), F.replace("condition", F.lit(" "), F.lit(""))
    )
    return readers.read_sheet(t.spark, _write(t, t.manifest.select(F.concat(row, F.lit("\n"))), "manifest"), "rnaseq")


@query("""
    select qname, rname, pos, pos + 49 as last_pos from reads union all select qname, mate_rname, mate_pos, mate_pos + 49 from reads""")
def read_sam(t):
    m = mates(t)
    s = lambda c: F.col(c).cast("string")
    row = F.concat_ws(
        "\t", "qname", s("flag"), "rname", (F.col("pos") + 1).cast("string"), F.lit("60"), F.lit("2S20M5D25M"), F.lit("="),
        F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"),
    )
    return readers.read_sam(t.spark, _write(t, m.select(F.concat(F.lit("@CO\tx\n"), row)), "sam")).select("qname", "rname", "pos", "last_pos")


@query("select chrom, start_pos, end_pos, round(neg_log10_p, 6) as score, round(l2fc, 6) as l2fc, strand from peaks")
def read_bed(t):
    path = scratch_path(t.spark, "bed")
    t.peaks.select("chrom", "start_pos", "end_pos", "neg_log10_p", "l2fc", "strand").write.csv(path, sep="\t")
    return r6(readers.read_bed(t.spark, path))


@query("""
    select concat('r', cast(event_id as varchar)) as id, concat(repeat('ACGT', cast(1 + event_id % 5 as int)), 'N') as seq, repeat('@', cast(4 * (1 + event_id % 5) + 1 as int)) as qual from events""")
def read_fastq(t):
    n = (F.col("event_id") % 5 + 1).cast("int")
    # a quality line may begin like a read name
    rec = F.concat(
        F.lit("@r"), F.col("event_id").cast("string"), F.lit("\n"), F.repeat(F.lit("ACGT"), n), F.lit("N\n+\n"), F.repeat(F.lit("@"), n * 4 + 1)
    )
    return readers.read_fastq(t.spark, _write(t, t.events.select(rec), "fastq")).select("id", "seq", "qual")


@query("""
    select source as folder, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by source""")
def file_inventory(t):
    path = scratch_path(t.spark, "files")
    t.documents.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path, lineSep="\n")
    found = readers.file_inventory(t.spark, path, md5=True).filter(F.col("name").startswith("part-"))
    sized = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    good = F.when(F.col("size_kib") == F.ceil(F.col("length") / 1024), F.col("length"))
    return found.join(sized, ["path"]).filter(F.length("md5") == 32).groupBy(
        F.regexp_extract("dir", "source=([^/]*)$", 1).alias("folder")
    ).agg(F.sum(good).alias("bytes"))


@query("""
    select o_orderkey % 40 as part, md5(concat(string_agg(cast(o_orderkey as varchar), chr(10) order by o_orderkey), chr(10))) as md5
    from orders group by 1""")
def file_checksums(t):
    path = scratch_path(t.spark, "checked")
    rows = t.orders.select((F.col("o_orderkey") % 40).alias("part"), "o_orderkey", F.col("o_orderkey").cast("string").alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey").write.partitionBy("part").text(path)
    found = readers.file_inventory(t.spark, path, md5=True).filter(F.col("name").startswith("part-"))
    return found.select(F.regexp_extract("dir", "part=([0-9]+)$", 1).cast("bigint").alias("part"), "md5")


@query("""
    select strftime(ts, '%Y-%m-%d %H:%M:%S') as at, cast(4096 as double) as reserved_mb, cast(mem_mb as double) as used_mb,
     cast(4096 - mem_mb as double) as wasted_mb, cast(cpu_pct as double) as cpu_pct from samples""")
def read_timed_samples(t):
    s = lambda c: F.col(c).cast("string")
    row = F.concat_ws(" ", day("ts"), F.lit("4096"), s("mem_mb"), (4096 - F.col("mem_mb")).cast("string"), F.lit("1.5"), F.lit("2"), s("cpu_pct"))
    head = F.concat(F.lit("date time reserved used wasted ram cpus cpu\n"), row)
    path = _write(t, t.samples.select(F.when(F.col("seq") % 100 == 0, head).otherwise(row)), "timed")
    return readers.read_timed_samples(t.spark, path).select(day("ts").alias("at"), "reserved_mb", "used_mb", "wasted_mb", "cpu_pct")


@query("select chrom, start_pos, end_pos, round(l2fc, 6) as value from peaks")
def read_bedgraph(t):
    path = scratch_path(t.spark, "bedgraph")
    t.peaks.select("chrom", "start_pos", "end_pos", "l2fc").write.csv(path, sep="\t")
    return r6(readers.read_bed(t.spark, path, "bedgraph"))


@query("""
    select c_name as sample_name, c_mktsegment as grp, case when c_custkey % 2 = 0 then 'PRO-seq' else 'Start-seq' end as analysis_type,
     concat('f', c_custkey) as file_r1, case when c_custkey % 5 <> 0 then concat('g', c_custkey) end as file_r2 from customer""")
def read_proseq_sheet(t):
    fields = [f.split()[0] for f in PROSEQ_SHEET.split(", ")]
    k = F.col("c_custkey")
    given = {
        "sample_name": F.col("c_name"), "grp": F.col("c_mktsegment"), "analysis_type": F.when(k % 2 == 0, "PRO-seq").otherwise("Start-seq"),
        "file_r1": F.concat(F.lit("f"), k.cast("string")), "file_r2": F.when(k % 5 != 0, F.concat(F.lit("g"), k.cast("string"))),
    }
    blank = t.spark.createDataFrame([[None] * len(fields)], ", ".join(f"{f} string" for f in fields))
    path = scratch_path(t.spark, "proseq")
    t.customer.select(*[given.get(f, F.lit("x")).alias(f) for f in fields]).unionByName(blank).write.csv(path, header=True, emptyValue="")
    return readers.read_sheet(t.spark, path, "proseq").select(*given)


@query("select job_id, status, program, mem_used, cast(finish_ts as date)::varchar as finished from ledger")
def append_ledger(t):
    path = scratch_path(t.spark, "ledger-table")
    old, new = later_half(t.ledger)
    sinks.append_ledger(old, path, by="month")
    sinks.append_ledger(new, path, by="month")
    back = t.spark.read.schema(t.ledger.schema).parquet(path)
    return back.select("job_id", "status", "program", "mem_used", F.date_format("finish_ts", "yyyy-MM-dd").alias("finished"))


@query(f"""
    with {PER_SIZE} select program, ref, target, a, case when program = '2-HIGH' then n + 1 else n end as n
    from ({_fit('mem_used', 'mem')} union all {_fit('min_used', 'time')}) f""")
def write_models(t):
    path = scratch_path(t.spark, "models-table")
    models = r6(md.fit_models(lg.ledger_points(t.ledger)))
    sinks.write_models(models, path)
    sinks.write_models(models.filter("program = '2-HIGH'").withColumn("n", F.col("n") + 1), path)
    return t.spark.read.parquet(path).select("program", "ref", "target", "a", "n")


@query("with jobs_of as (select * from acct_jobs), " + EFF + """
    select '2024-01-07' as week, user_name, njobs from eff union all select '2024-01-14', user_name, njobs from eff""")
def write_weekly_report(t):
    path = scratch_path(t.spark, "reports")
    report = as_written(efficiency.user_efficiency(*_accounting(t)), "report")
    # a first report of the week, to be replaced
    sinks.write_weekly_report(efficiency.exclude_users(report, ["u1"]), path, dt.date(2024, 1, 14))
    for end in (dt.date(2024, 1, 7), dt.date(2024, 1, 14)):
        sinks.write_weekly_report(report, path, end)
    return t.spark.read.parquet(path).select(F.date_format("week_ending", "yyyy-MM-dd").alias("week"), "user_name", "njobs")


@query("""
    select concat('p', cast(l_linenumber as varchar)) as name, cast(l_linenumber as int) as ordinal, 'general' as kind,
     cast(max(l_extendedprice) as bigint) as mem_limit_mb, case when l_linenumber = 3 then null else cast(sum(l_quantity) as bigint) end as time_limit_min
    from lineitem group by l_linenumber""".replace("cast(max(l_extendedprice) as bigint)", "cast(floor(max(l_extendedprice)) as bigint)"))
def read_policy(t):
    n = F.col("l_linenumber").cast("string")
    limits = t.lineitem.groupBy("l_linenumber").agg(
        F.floor(F.max("l_extendedprice")).alias("mem"), F.sum("l_quantity").cast("bigint").alias("min")
    )
    part = lambda kind, value: F.concat(F.lit("export partition"), n, F.lit(kind), F.lit("="), value, F.lit("  # limit"))
    text = F.concat_ws(
        "\n", F.lit("# partitions"), part("Name", F.concat(F.lit("p"), n)), part("MemLimit", F.col("mem").cast("string")),
        part("TimeLimit", F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("min").cast("string"))), F.lit("export partition9Name="),
    )
    policy, _ = readers.read_policy(t.spark, _write(t, limits.select(text), "config"))
    return policy


@query("""
    select cast(floor(max(o_totalprice)) as bigint) as default_mem, cast(count(*) as bigint) as default_min, cast(max(o_custkey) as bigint) as extra_mem,
     cast(null as bigint) as extra_min, cast(min(o_orderkey) as bigint) as first_batch, cast(count(distinct o_custkey) as bigint) as failure_burst from orders""")
def policy_defaults(t):
    n = t.orders.agg(
        F.floor(F.max("o_totalprice")).alias("defaultMem"), F.count(F.lit(1)).alias("defaultTime"), F.max("o_custkey").alias("defaultExtraMem"),
        F.min("o_orderkey").alias("firstBatchCount"), F.count_distinct("o_custkey").alias("numberOfFailedJobsLastHourToRecalculateStats"),
    )
    lines = [F.concat(F.lit(f"export {c}="), F.col(c).cast("string"), F.lit(" # a default")) for c in n.columns]
    # the last assignment counts; an empty one is none
    text = F.concat_ws("\n", F.lit("export defaultMem=1"), *lines, F.lit("export defaultExtraTime="))
    return readers.read_policy(t.spark, _write(t, n.select(text), "defaults"))[1]
