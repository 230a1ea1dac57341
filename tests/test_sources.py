"""Readers on small files, also on files cut into many splits."""

import bz2
import datetime as dt
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from jobscope.operators import usage
from jobscope.sources import readers, sinks, text


@pytest.fixture
def tiny_splits(spark):
    """Cut plain files into splits of about 4 KB."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _fastq(n):
    # quality lines that look like names, lines of many lengths
    return "".join(f"@r{i}/1\n{'ACGT' * (i % 9 + 1)}\n+\n{'@' * (4 * (i % 9 + 1))}\n" for i in range(n))


def test_lines_of_many_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 70)}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("only\n")
    df = text.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    wrong = df.filter("file like '%a.txt'").filter(~F.col("line").startswith(F.concat(F.lit("line "), (F.col("line_no") - 1).cast("string"), F.lit(" "))))
    assert wrong.isEmpty()
    packed = text.numbered_lines(spark, str(tmp_path), hot_rows=10)
    assert df.exceptAll(packed).isEmpty() and packed.count() == 3001
    assert df.count() == 3001 and df.filter("file like '%b.txt'").first().line_no == 1


def test_fastq(spark, tmp_path, tiny_splits):
    body = _fastq(900)
    (tmp_path / "p.fastq").write_text(body)
    (tmp_path / "g.fastq.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "b.fastq.bz2").write_bytes(bz2.compress(body.encode()))
    got = readers.read_fastq(spark, str(tmp_path))
    assert got.groupBy("file").count().filter("count = 900").count() == 3
    bad = got.filter(
        (F.col("id") != F.concat(F.lit("r"), F.col("ordinal").cast("string"), F.lit("/1"))) | (F.length("seq") != F.length("qual"))
    )
    assert bad.isEmpty()


def test_accounting_follows_the_job_row(spark, tmp_path, tiny_splits):
    rows = []
    for i in range(400):
        rows.append(f"2|u{i % 3}||01:00:00|4|02:00:00|1-00:00:00|billing=4,cpu=4,mem={i + 1}G,node=2")
        rows += [f"2||{k}.5G|00:30:00|4|00:10:00||cpu=4" for k in range(i % 4)]
    (tmp_path / "acct.txt").write_text("\n".join(rows) + "\n")
    jobs, steps = readers.read_accounting(spark, str(tmp_path))
    assert jobs.count() == 400 and steps.count() == sum(i % 4 for i in range(400))
    per = steps.groupBy("job_id").count().join(jobs, "job_id")
    assert per.filter(F.col("count") != (F.col("req_gb") - 1) % 4).isEmpty()


def test_ledger_header_anywhere(spark, tmp_path):
    row = "7,{},4096,120,600,20,300,9,{},u1,310,grep,none,1.0.x,1,500,10,0.50,0.45,Tue Dec 1 10:00:00 UTC 2026,1700000000"
    lines = [row.format(100, "COMPLETED"), "1jobID,2inputSize,3memDefault", row.format("missingInputFile", "OOM"), "8,notExist,1"]
    (tmp_path / "jobRecord.txt").write_text("\n".join(lines) + "\n")
    got = readers.read_ledger(spark, str(tmp_path)).orderBy("job_id", F.desc("input_size")).collect()
    assert [(r.job_id, r.input_size, r.missing_input, r.status) for r in got] == [
        (7, 100, False, "COMPLETED"), (7, None, True, "OOM"), (8, None, True, None),
    ]
    assert got[0].ratio_time == 0.45 and got[0].epoch == 1700000000


def test_samples(spark, tmp_path):
    (tmp_path / "job_12.memCPU.txt").write_text("0 0 0 0 0 1700000000 jobID:12 time:x\n1 100 900 3096 45\n2 300 700 3096 80\n0 0 0 0 0  jobID:12 resume\n1 50 950 3096 3\n")
    got = readers.read_samples(spark, str(tmp_path))
    assert [tuple(r) for r in got.orderBy("seq").select("job_id", "minute", "mem_mb", "is_marker").collect()] == [
        ("12", 0, 0, True), ("12", 1, 100, False), ("12", 2, 300, False), ("12", 0, 0, True), ("12", 1, 50, False),
    ]
    seg = usage.sample_segments(got.drop("minute").withColumn("ts", F.lit(0))).orderBy("seq").select("segment", "minute")
    assert [tuple(r) for r in seg.collect()] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    live = readers.read_samples(spark, str(tmp_path), stream=True)
    assert live.isStreaming
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(live.schema).parquet(out).filter("job_id = '12' and not is_marker").agg(F.sum("mem_mb")).first()[0] == 450
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "99.memCpuLog").write_text("Timestamp ReservedRam(M) Ram(M)\n2024-01-02 03:04:05 1000 250.5 749.5 25.05 4 180.0\n")
    r = readers.read_timed_samples(spark, str(tmp_path / "log")).first()
    assert (r.job_id, r.ts, r.used_mb, r.cpu_pct) == ("99", dt.datetime(2024, 1, 2, 3, 4, 5), 250.5, 180.0)


def test_policy_user_copy_wins(spark, tmp_path):
    (tmp_path / "c.txt").write_text(
        "export defaultMem=4096  # in M\nexport partition1Name=short\nexport partition1MemLimit=249000  \nexport partition1TimeLimit=720 # x\n"
        "export partition2Name=\nexport partition15Name=gpu_quad\nexport partition15MemLimit=9\nexport partition15TimeLimit=\n"
    )
    (tmp_path / "u.txt").write_text("export partition1TimeLimit=60\nexport firstBatchCount=7\n")
    policy, defaults = readers.read_policy(spark, str(tmp_path / "c.txt"), str(tmp_path / "u.txt"))
    assert [tuple(r) for r in policy.orderBy("ordinal").collect()] == [
        ("short", 1, "general", 249000, 60), ("gpu_quad", 15, "special", 9, None),
    ]
    d = defaults.first()
    assert d.default_mem == 4096 and d.first_batch == 7 and d.extra_mem is None


def test_inventory_checksums(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    (tmp_path / "x y" / "f.bin").write_bytes(os.urandom(5000))
    (tmp_path / "e.gz").write_bytes(gzip.compress(b"abc"))
    got = {r.name: r for r in readers.file_inventory(spark, str(tmp_path), md5=True).collect()}
    for p in (tmp_path / "x y" / "f.bin", tmp_path / "e.gz"):
        assert got[p.name].md5 == hashlib.md5(p.read_bytes()).hexdigest()
    assert got["f.bin"].size_kib == 5 and got["e.gz"].size_kib == 1


def test_models_of_other_keys_stay(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([("a", "r", 1), ("a", "s", 1), ("b", "r", 1)], "program string, ref string, n int")
    sinks.write_models(first, path)
    sinks.write_models(spark.createDataFrame([("a", "s", 2)], "program string, ref string, n int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("program", "ref", "n").collect()) == [
        ("a", "r", 1), ("a", "s", 2), ("b", "r", 1),
    ]


def test_steps_find_their_job_across_splits_without_a_sort(spark, tmp_path):
    want = {}
    for name, jobs in (("a", 300), ("b", 7)):
        lines = ["1||7G|00:30:00|1|00:10:00||cpu=1"] * 40  # steps of no job
        for j in range(jobs):
            lines.append(f"1|u{j}||01:00:00|1|00:10:00|1-00:00:00|cpu=1,mem=2G")
            want[(name, len(lines))] = list(range(1, j % 9 + 1))
            lines += ["1||2G|00:30:00|1|00:10:00||cpu=1"] * (j % 9)
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for batch, size in (("3", "700b"), ("10000", "700b"), ("7", "128m")):
            for k, v in zip(before, (size, "1b", batch), strict=True):
                spark.conf.set(k, v)
            jobs, steps = readers.read_accounting(spark, str(tmp_path))
            got = {r.job_id: [] for r in jobs.select("job_id").collect()}
            for r in steps.collect():
                got[r.job_id].append(r.step_no)
            assert {(k.rsplit("/", 1)[1].split(".")[0], int(k.rsplit(":", 1)[1])): sorted(v) for k, v in got.items()} == want
            assert "Window" not in steps._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
