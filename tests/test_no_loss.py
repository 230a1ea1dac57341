"""Rows that must not get lost or mixed: ids, pairs, sizes, group keys."""

from datetime import datetime

from pyspark.sql import functions as F

from jobscope.functions import stats
from jobscope.operators import files, graph, ledger, reads, usage
from jobscope.sources import readers


def test_ledger_keeps_array_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1jobID,2inputSize,3memDefault\n123_4,5,6\n7,8,9\nx,1,2\n")
    got = sorted((r.job_id if r.job_id is None else int(r.job_id), r.input_size) for r in readers.read_ledger(spark, str(tmp_path)).collect() if r.job_id is not None)
    assert got == [(7, 8), (123, 5)]
    assert readers.read_ledger(spark, str(tmp_path)).count() == 3


def test_pairs_keep_every_record(spark):
    schema = "qname string, sample string, flag int, rname string, pos bigint, last_pos bigint"
    rows = [
        ("q", "s1", 65, "c", 10, 19), ("q", "s1", 129, "c", 50, 59), ("q", "s1", 65, "c", 100, 109), ("q", "s1", 129, "c", 150, 159),
        ("q", "s2", 65, "c", 10, 19), ("o", "s1", 65, "c", 1, 2), ("n", "s1", 0, "c", 5, 6),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r.qname, r.r1_sample, r.r1_pos, r.r2_sample, r.r2_pos) for r in reads.pair_mates(frame).collect())
    assert got == [("q", "s1", 10, "s1", 50), ("q", "s1", 100, "s1", 150)]
    alone = sorted((r.qname, r.sample, r.pos) for r in reads.orphans(frame).collect())
    assert alone == [("n", "s1", 5), ("o", "s1", 1), ("q", "s2", 10)]
    places = [("q", 65, "c", 10, 19, "=", 50), ("q", 129, "c", 50, 59, "=", 10), ("q", 129, "c", 70, 79, "=", 30), ("q", 65, "c", 30, 39, "=", 70)]
    frame = spark.createDataFrame(places, "qname string, flag int, rname string, pos bigint, last_pos bigint, rnext string, mate_pos bigint")
    assert sorted((r.r1_pos, r.r2_pos) for r in reads.pair_mates(frame).collect()) == [(10, 50), (30, 70)]


def test_pairs_of_a_hot_name(spark):
    """A name (here a null one) with most rows is cut into parts; its pairs and orphans stay the same."""
    rows = [(None, "s", 65 if i % 2 else 129, "c", i // 3, i) for i in range(301)] + [("q", "s", 65, "c", 1, 2), ("q", "s", 129, "c", 3, 4), (None, "s", 129, "c", 500, 501)]
    frame = spark.createDataFrame(rows, "qname string, sample string, flag int, rname string, pos bigint, last_pos bigint")
    plain, cut = reads.pair_mates(frame), reads.pair_mates(frame, hot_rows=20)
    assert "collect_list" not in cut._jdf.queryExecution().toString()
    found = [sorted(map(str, f.collect())) for f in (plain, cut)]
    assert found[0] == found[1] and len(found[0]) == 151
    alone = [sorted((r.pos, r.flag) for r in f.collect()) for f in (reads.orphans(frame), reads.orphans(frame, hot_rows=20))]
    assert alone[0] == alone[1] and len(alone[0]) == 2


def test_archive_keeps_unknown_sizes(spark):
    frame = spark.createDataFrame([("d", "a", 1), ("d", "b", None), ("d", "c", 2)], "dir string, name string, size_kib bigint")
    got = {r.name: r.batch for r in files.archive_batches(frame).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] is None


def test_input_counts_once(spark):
    jobs = spark.createDataFrame([(1, ",f f")], "job_id bigint, inputs string")
    inventory = spark.createDataFrame([("f", 3), ("f", 3)], "path string, size_kib bigint")
    assert files.input_size(jobs, inventory).first().input_size == 3


def test_group_key_with_commas(spark):
    steps = spark.createDataFrame([("s", "1", "0", ["1", "2"]), ("s", "2", "1", ["1", "2"])], "script_id string, step string, deps string, loop_path array<string>")
    jobs = spark.createDataFrame(
        [("s", "j1", "1", ["a,b", "c"]), ("s", "j2", "1", ["a", "b,c"]), ("s", "k", "2", ["a,b", "c"])],
        "script_id string, job_id string, step string, values array<string>",
    )
    links, members = graph.dependency_groups(steps, jobs)
    assert [r.n_deps for r in links.filter(F.col("job_id") == "k").collect()] == [1]
    assert members.select("loop_values").distinct().count() == 2


def test_cycle_of_process_ids_is_named(spark):
    rows = [
        (1, 1, 10, 1, 1024, 1.0, "a", True, False), (1, 1, 11, 10, 2048, 2.0, "b", False, False),
        (1, 1, 20, 21, 9999, 9.0, "c", False, False), (1, 1, 21, 20, 9999, 9.0, "d", False, False), (1, 1, 30, 99, 9, 9.0, "e", False, False),
    ]
    procs = spark.createDataFrame(rows, "job_id int, tick int, pid int, ppid int, rss_kb bigint, cpu_pct double, cmd string, is_root boolean, is_monitor boolean")
    assert {r.pid: r.end for r in usage.process_ends(procs).collect()} == {10: "root", 11: "root", 20: "cycle", 21: "cycle", 30: "none"}
    assert [(r.mem_mb, r.procs) for r in usage.process_rollup(procs).collect()] == [(3, 2)]


def test_any_number_of_barcode_shapes(spark):
    codes = spark.createDataFrame([(f"b{n}", "A" * n) for n in range(1, 80)], "barcode string, sequence string")
    seqs = spark.createDataFrame([(1, "A" * 70 + "C"), (2, "AC"), (3, "C")], "id int, seq string")
    assert {r.id: r.barcode for r in reads.barcode_demux(seqs, codes).collect()} == {1: "b70", 2: "b1", 3: "unassigned"}


def test_cap_counts_distinct_records(spark):
    schema = "job_id bigint, program string, ref string, input_size bigint, mem_used bigint, status string, finish_ts timestamp"
    at = datetime(2024, 1, 1)
    old = spark.createDataFrame([(i, "p", "r", 5, 7, "COMPLETED", at) for i in range(3)], schema)
    new = spark.createDataFrame([(9, "p", "r", 4, 8, "COMPLETED", at)], schema)
    assert [r.job_id for r in ledger.admit_records(new, old, cap=2).collect()] == [9]


def test_far_tail_does_not_underflow(spark):
    df = spark.createDataFrame([(1500.0,)], "x double")
    assert abs(df.select(stats.chi2_neg_log10(F.col("x"))).first()[0] - 327.407256) < 1e-5
