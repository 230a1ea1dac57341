"""Hand-made inputs with known results."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobscope.functions import jobs as fj, stats, units as fu
from jobscope.operators import efficiency, files, graph, intervals, ledger, models, policy, reads, savings, usage
from jobscope.plans.views import Tables


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr.alias("x")).first()[0]


def each(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_units(spark):
    assert each(spark, fu.time_to_minutes, ["50", "50:0", "2:0:0", "1-02:30", "0-20", "08:30:00", None, "3-00:09:59"]) == [
        50, 50, 120, 1590, 1200, 510, 120, 4329,
    ]
    assert each(spark, fu.minutes_to_dhms, [1590, 0, 59], "bigint") == ["1-02:30:00", "0-00:00:00", "0-00:59:00"]
    hours = each(spark, fu.elapsed_hours, ["1-02:03:04", "02:03:04", "12:34.567", "05:30", "123456"])
    assert [round(h, 4) for h in hours] == [26.05, 2.0511, 0.2094, 0.0833, 0.0]
    none, core = F.lit(None).cast("string"), F.lit(4)
    assert each(spark, lambda c: fu.mem_to_mb(c, none, core), ["4G", "4g", "4096M", "2GB", "100", None]) == [4096, 4096, 4096, 2048, 100, 4096]
    assert each(spark, lambda c: fu.mem_to_mb(none, c, core), ["2G", "300M"]) == [8192, 1200]
    assert each(spark, fu.tres_mem_gb, ["billing=8,cpu=8,gres/gpu=1,mem=16G,node=1", "cpu=1", "cpu=2,mem=0.5G"]) == [16.0, None, 0.5]


def test_identity(spark):
    n = F.lit(8)
    assert each(spark, lambda c: fj.index_list(c, n), ["0,2-4,8", "", "x,1-,-2", "6-99999999999", "5-3", "3, 3"]) == [
        [0, 2, 3, 4], [], [], [6, 7], [], [3],
    ]
    assert each(spark, fj.job_size, [",jobSize:12", "a.fq", None]) == [12, None, None]
    assert each(spark, fj.input_refs, [",a.fq,b.fq", "a b", ",jobSize:1"]) == [["a.fq", "b.fq"], ["a", "b"], None]
    assert each(spark, fj.ref_key, ["a/b/c", None]) == ["a-b-c", "none"]
    null = F.lit(None).cast("string")
    flags = each(spark, lambda c: fj.job_flag(null, F.lit("p"), c, F.lit(1)), ["x/y..z w.fq", "dir/"])
    assert flags == ["p.y.zw.fq", "p."]
    assert each(spark, lambda c: fj.program_of(null, c, F.lit("/a/run.sh")), ["python3 /x/tool.py -a", "/bin/ls -l", None]) == ["tool.py", "ls", "run.sh"]
    assert each(spark, fj.state_code, ["COMPLETED", "CANCELLED by 1", "RUNNING", None]) == [2, 1, 0, 0]
    got = one(spark, fj.task_properties(F.col("t")), t='{"groupid": "g", "threads": 3, "input": ["a", "b"]}')
    assert got.asDict() == {"program": "g", "threads": 3, "inputs": "a b"}
    assert each(spark, lambda c: fj.link_path(F.lit("01"), F.lit("s"), F.lit("l"), F.lit("1"), 2, c), ["r.fq.gz", "r.fq.bz2", "r.fq"]) == [
        "group1/s/l_1_2.fq.gz", "group1/s/l_1_2.fq.bz2", "group1/s/l_1_2.fq",
    ]


def test_status_order(spark):
    no = F.lit(False)
    tails = F.lit("srun: error: task 0: Out Of Memory")
    assert each(spark, lambda c: fj.job_status(no, c, F.lit("")), ["TIMEOUT OUT_OF_ME+", "TIMEOUT", "OUT_OF_ME+", "FAILED", "CANCELLED", "x"]) == [
        "OOMOOT", "OOT", "OOM", "Fail", "Canceled", "Unknown",
    ]
    assert each(spark, lambda c: fj.job_status(no, c, tails), ["RUNNING", None]) == ["OOM", "OOM"]
    assert each(spark, lambda c: fj.job_status(F.lit(True), c, tails), ["FAILED"]) == ["COMPLETED"]


LEDGER = "job_id bigint, program string, ref string, status string, input_size bigint, mem_used double, min_used bigint"


def _model(spark):
    pts = [(1, 1465, 3.52, 1), (2, 2930, 6.38, 2), (3, 4395, 9.24, 4)]
    return spark.createDataFrame([(i, "grep", "none", "COMPLETED", s, m, t) for i, s, m, t in pts], LEDGER)


def test_estimate(spark):
    req = spark.createDataFrame(
        [(1, "grep", "none", 2930), (2, "grep", "none", 5000), (3, "other", "none", 10), (4, "grep", "none", None), (5, "grep", "none", 0)],
        "job_id bigint, program string, ref string, input_size bigint",
    ).withColumns({"mem_default": F.lit(4096).cast("bigint"), "min_default": F.lit(120).cast("bigint")})
    got = {r.job_id: (r.reason, r.est_mem, r.est_min) for r in models.estimate_resources(req, _model(spark)).collect()}
    assert got[1] == ("model", 600, 20)
    assert got[2] == ("out_of_range", 4096, 120)
    assert got[3] == ("no_model", 4096, 120)
    assert got[4] == ("missing_input", 4096, 120)
    assert got[5] == ("noinput_p90", 9 + 500, 4 + 10)
    empty = req.filter("job_id = 5").withColumn("has_input", F.lit(True))
    assert models.estimate_resources(empty, _model(spark)).first().reason == "model"


def test_fit(spark):
    mem = models.fit_models(ledger.ledger_points(_model(spark))).filter("target = 'mem'").first()
    assert math.isclose(mem.a, 0.00195221843, rel_tol=1e-6) and math.isclose(mem.b, 0.66, rel_tol=1e-6)
    assert mem.n == 3 and mem.x_median == 2930 and mem.stdfit < 1e-6


@pytest.mark.parametrize("n, rank", [(3, 1), (10, 1), (11, 2), (25, 3)])
def test_upper_decile(spark, n, rank):
    rows = [(i, "p", "r", "COMPLETED", 0, float(i), 2 * i) for i in range(1, n + 1)]
    got = models.noinput_p90(spark.createDataFrame(rows, LEDGER)).first()
    assert (got.p90_mem, got.p90_min, got.rows) == (n - rank + 1, 2 * (n - rank + 1), n)


def test_retry(spark):
    cols = "mem_alloc bigint, mem_used bigint, min_used bigint, old_extra bigint, recent_fails bigint"
    df = spark.createDataFrame([(90, 80, 25, None, 0), (2000, 1990, 500, 50, 4), (60000, 70000, 10, None, 0)], cols)
    got = [(r.new_extra, r.new_mem, r.new_min) for r in policy.oot_retry(policy.oom_retry(df)).collect()]
    assert got[0] == (11, 982, 144)
    assert got[1] == (50, 2000 * 2 * 4 * 12 // 10 + 100, 500 * 12 * 4 * 12 // 100)
    assert got[2] == (5, 60000 * 12 * 12 // 100 + 10, 48)


def test_partition(spark, sf):
    table = Tables(spark, sf).policy
    jobs = spark.createDataFrame(
        [(300000, 100, "short"), (1000, 8000, "short"), (1000, 50000, None), (2000000, 100, "highmem"), (1, 99999, "gpu_quad")],
        "mem bigint, minutes bigint, partition_name string",
    )
    got = [(r.to_partition, r.to_mem, r.to_min) for r in policy.assign_partition(jobs, table).collect()]
    assert got == [("short", 249000, 100), ("long", 1000, 8000), ("long", 1000, 43200), ("highmem", 999000, 100), ("gpu_quad", 1, 99999)]


def test_archive(spark):
    sizes = [3, 4, 9, 1, 2, 50, 8, 1]
    inv = spark.createDataFrame([("d", f"{i:02d}", s) for i, s in enumerate(sizes)], "dir string, name string, size_kib bigint")
    for hot_rows in (100, 3):
        got = {r.name: r.batch for r in files.archive_batches(inv, 10, hot_rows=hot_rows).collect()}
        assert [got[f"{i:02d}"] for i in range(8)] == [0, 0, 0, 1, 1, None, 1, 2]


def test_numeric_names_come_in_number_order(spark):
    inv = spark.createDataFrame([("d", n, 6) for n in ("10", "9", "b", "2")], "dir string, name string, size_kib bigint")
    got = {r.name: r.batch for r in files.archive_batches(inv, 10).collect()}
    assert got == {"b": 0, "2": 0, "9": 1, "10": 1}


def test_cancel(spark):
    state = spark.createDataFrame(
        [(1, "failed"), (2, "pending"), (3, "unknown"), (4, "succeeded"), (5, "pending")], "job_id bigint, state string"
    )
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 5)], "dep bigint, job_id bigint")
    got = {r.job_id: r.state for r in graph.propagate_cancel(state, edges).collect()}
    assert got == {1: "failed", 2: "cancelled", 3: "cancelled", 4: "succeeded", 5: "pending"}
    calm = state.filter("job_id > 1")
    assert {r.job_id: r.state for r in graph.propagate_cancel(calm, edges).collect()}[2] == "pending"


SCRIPT = """#!/bin/sh
#loopStart:i
for i in {1..3}; do
    #@1,0,step1,,input,sbatch -p short -c 1
    for not a loop: still the command

    #loopStart:j
    for j in {1..2}; do
        #@2,1,step2,,input,sbatch -p short
        echo two

    done
    #@3,2,step3.NoCheckpoint,,input
    echo three

done
done
for q in a b; do
    #@5,0,x,,sbatch -p short

done
#@4,3,step4,,input
#@4,3,again,,input,run
#@6,3,,,input
#@7,3,y,,in,sbatch --array=1-3"""


def test_script(spark):
    lines = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(SCRIPT.split("\n"))], "script_id bigint, line_no bigint, text string")
    ann = graph.annotations(lines)
    got = {(r.line_no): (r.step, r.name, r.loop_path, r.violation) for r in ann.collect()}
    assert got[4] == ("1", "step1", ["i"], None)
    assert got[9] == ("2", "step2", ["i", "j"], None)
    assert got[13] == ("3", "step3", ["i"], None)
    assert got[19][2:] == (["q"], "options_in_wrong_field")
    assert got[22][2:] == ([], None)
    assert got[23][3] == "bad_options" and got[24][3] == "missing_field" and got[25][3] == "job_array"

    steps = ann.filter("violation is null")
    jobs, n = [], 0
    for i in (1, 2, 3):
        jobs.append((1, f"1.{i}", "1", [i]))
        jobs += [(1, f"2.{i}.{j}", "2", [i, j]) for j in (1, 2)]
        jobs.append((1, f"3.{i}", "3", [i]))
    jobs.append((1, "4", "4", []))
    links, members = graph.dependency_groups(
        steps, spark.createDataFrame(jobs, "script_id bigint, job_id string, step string, values array<int>")
    )
    pairs = links.join(members, ["script_id", "dep_step", "loop_values"]).select("job_id", "dep_job").collect()
    want = {(f"2.{i}.{j}", f"1.{i}") for i in (1, 2, 3) for j in (1, 2)}
    want |= {(f"3.{i}", f"2.{i}.{j}") for i in (1, 2, 3) for j in (1, 2)}
    want |= {("4", f"3.{i}") for i in (1, 2, 3)}
    assert {tuple(p) for p in pairs} == want and len(pairs) == len(want)


def _pair(q, flag1, flag2, p1, p2, r1="chr1", r2="chr1"):
    return [(q, 1 + 64 + flag1, r1, p1, p1 + 9), (q, 1 + 128 + flag2, r2, p2, p2 + 9)]


def test_collapse(spark):
    rows = _pair("AA:2", 0, 16, 100, 200) + _pair("AA:1", 0, 16, 100, 200) + _pair("CC:3", 0, 16, 100, 200)
    rows += _pair("AA:4", 16, 0, 91, 209) + _pair("AA:5", 4, 8, 0, 5) + _pair("AA:6", 0, 0, 1, 1, "chr1", "chr2") + _pair("AA:7", 4, 4, 0, 0)
    pairs = reads.pair_mates(spark.createDataFrame(rows, "qname string, flag int, rname string, pos bigint, last_pos bigint"))
    kept = {(r.qname, r.start, r.stop, r.strand) for r in reads.barcode_collapse(pairs).collect()}
    assert kept == {("AA:1", 100, 209, "+"), ("CC:3", 100, 209, "+"), ("AA:4", 100, 209, "-")}
    metrics = {r.umi: (r.total_count, r.removed_count) for r in reads.collapse_metrics(pairs).collect()}
    assert metrics == {"AA": (3, 1), "CC": (1, 0)}
    assert tuple(reads.dropped_pairs(pairs).first()) == (1, 1)


def test_genomes(spark):
    n = {r.genome: r["count"] for r in reads.genome_table(spark).groupBy("genome").count().collect()}
    assert len(n) == 13 and n["hg38"] == 24 and n["mm10"] == 21 and n["canFam4"] == 39 and n["XL9_2"] == 18


def test_demux_prefers_the_longest(spark):
    codes = spark.createDataFrame(reads.BARCODES, "barcode string, sequence string")
    seqs = [s.replace("N", "C") + "ACGT" for _, s in reads.BARCODES] + ["TTTT", "AGATC"]
    got = reads.barcode_demux(spark.createDataFrame(list(enumerate(seqs)), "i int, seq string"), codes).orderBy("i")
    assert [r.barcode for r in got.collect()] == [b for b, _ in reads.BARCODES] + ["unassigned", "unassigned"]


def test_pvalues(spark):
    got = each(spark, stats.chi2_pvalue, [0.0, 3.841458820694124, 10.827566170662733, 1e6], "double")
    assert got[0] == 1.0 and math.isclose(got[1], 0.05, rel_tol=1e-9) and math.isclose(got[2], 0.001, rel_tol=1e-9) and got[3] == 0.0
    assert each(spark, stats.neg_log10, [0.0, 0.001, 1.0], "double") == [400.0, 3.0, 0.0]

    def brute(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = lambda k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row)
        return min(1.0, sum(p(k) for k in range(max(0, row + col - n), min(row, col) + 1) if p(k) <= p(a) * (1 + 1e-9)))

    tables = [(3, 1, 1, 3), (0, 10, 4, 6), (8, 2, 1, 5), (1, 0, 0, 1), (5, 200, 0, 300)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(tables)], "i int, a bigint, b bigint, c bigint, d bigint")
    out = [r[0] for r in df.orderBy("i").select(stats.fisher_pvalue(*[F.col(c) for c in "abcd"])).collect()]
    assert all(math.isclose(x, brute(*y), rel_tol=1e-9) for x, y in zip(out, tables))


def test_enrichment_pvalue_against_brute_force(t):
    from jobscope.plans.q_reads import _enriched

    for r in _enriched(t, pvalue=True).filter("ip_reads + input_reads > 0").limit(300).collect():
        if r.test == "C":
            assert math.isclose(r.p_value, math.erfc(math.sqrt(r.chi2 / 2)), rel_tol=1e-9)
        else:
            a, c = r.ip_reads, r.input_reads
            n, row, col = r.ip_total + r.input_total, r.ip_total, a + c
            p = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
            want = sum(p(k) for k in range(max(0, row + col - n), min(row, col) + 1) if p(k) <= p(a) * (1 + 1e-9))
            assert math.isclose(r.p_value, min(1.0, want), rel_tol=1e-7)


def test_near_limit(spark):
    samples = spark.createDataFrame(
        [(1, 1, 100, 950), (1, 2, 130, 950), (1, 3, 200, 980), (2, 1, 500, 1), (3, 1, 130, 10)], "job_id int, seq int, s int, mem_mb int"
    ).withColumn("ts", F.timestamp_seconds("s"))
    jobs = spark.createDataFrame([(1, 1000, 100), (2, 1000, 10), (3, 1000, 100)], "job_id int, total_mem int, total_min int").withColumn(
        "start_ts", F.timestamp_seconds(F.lit(0))
    )
    got = {(r.job_id, r.seq, r.kind) for r in usage.near_limit(samples, jobs).collect()}
    assert got == {(1, 2, "Mem"), (2, 1, "Time")}


def test_tiers(spark):
    rows = [("a", 200, 25.0, 0), ("b", 200, 5.0, 0), ("c", 10, 100.0, 0), ("d", 100, 50.0, 3), ("e", 100, 50.0, 1), ("f", 100, 5.0, 1)]
    got = {r.user_name: r.tier for r in efficiency.user_tier(spark.createDataFrame(rows, "user_name string, njobs int, avg_req_gb double, njobs_half int")).collect()}
    assert got == {"a": "bad", "b": "neutral", "c": "bad", "d": "good", "e": "neutral", "f": "good"}


def test_savings_never_negative(t):
    for df in (savings.savings_mem(t.ledger), savings.savings_time(t.ledger, ["program"])):
        nums = [c for c, k in df.dtypes if k == "bigint" and c != "job_id"]
        assert df.filter(" or ".join(f"{c} < 0" for c in nums)).isEmpty()


def test_merge_keeps_every_peak(t):
    got = intervals.merge_intervals(t.peaks)
    assert got.agg(F.sum("peaks")).first()[0] == t.peaks.count()


def test_interactive_is_left_out(spark):
    df = spark.createDataFrame([("short",), ("interactive",), (None,)], "partition_name string")
    assert [r[0] for r in efficiency.exclude_interactive(df).collect()] == ["short", None]


def test_process_trees(spark):
    rows = [
        (1, 1, 10, 1, 100 * 1024, 1.5, "slurmstepd", True, False), (1, 1, 11, 10, 50 * 1024, 50.0, "sh", False, False),
        (1, 1, 12, 11, 25 * 1024, 25.4, "tool", False, False), (1, 1, 13, 11, 999 * 1024, 99.0, "monitor", False, True),
        (1, 1, 14, 13, 777 * 1024, 77.0, "ps", False, False), (1, 1, 20, 1, 10**9, 1.0, "other", False, False),
        (1, 1, 30, 31, 1, 1.0, "cycle", False, False), (1, 1, 31, 30, 1, 1.0, "cycle", False, False),
    ]
    df = spark.createDataFrame(
        rows, "job_id int, tick int, pid int, ppid int, rss_kb bigint, cpu_pct double, cmd string, is_root boolean, is_monitor boolean"
    )
    got = usage.process_rollup(df.filter("cmd <> 'cycle'")).first()
    assert (got.mem_mb, got.cpu_pct, got.procs) == (175 + 5000 // 1024, 78, 4)
