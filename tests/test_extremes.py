"""Inputs at the edge: long intervals, damaged FASTQ and SAM, reads across splits, many barcode shapes, tiny files."""

import random

import pytest
from pyspark.sql import functions as F

from jobscope.operators import files, intervals, reads
from jobscope.sources import fastq, readers

PLACED = "chrom string, strand string, start_pos bigint, end_pos bigint, i int"


def _intervals(r, n, long):
    rows = [("c1", r.choice("+-"), a, a + r.choice([1, 30, 1024, 1025, 9000])) for a in (r.randrange(200_000) for _ in range(n))]
    return [(*x, i) for i, x in enumerate(rows + long)]


def test_long_intervals_are_few_rows(spark):
    r = random.Random(1)
    a = _intervals(r, 300, [("c1", "+", 0, 248_000_000), ("c1", "-", 5, 100_000), ("c2", "+", 0, 10**12)])
    b = _intervals(r, 200, [("c1", "+", 1000, 200_000_000), ("c1", "+", 0, 1), ("c1", "-", 150_000, 2_000_000), ("c3", "+", 0, 5)])
    left, right = spark.createDataFrame(a, PLACED), spark.createDataFrame(b, PLACED)
    want = sorted((x[4], y[4]) for x in a for y in b if x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3])
    for hot in (10, 10**6):
        got = sorted((x.i, x.b_i) for x in intervals.overlap_join(left, right, hot_rows=hot, spread=["i"]).collect())
        assert got == want and len(want) > 300
    # a chromosome is at most two rows a level
    levels = left.withColumn("_level", intervals._level("start_pos", "end_pos", 1024))
    assert intervals._bins(levels, "start_pos", "end_pos", 1024).groupBy("i").count().agg(F.max("count")).first()[0] <= 2


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _read(i, r):
    n = r.choice([0, 1, 5, 40, 900])
    return f"@r{i}\n{''.join(r.choice('ACGT') for _ in range(n))}\n+{'x' if i % 7 == 0 else ''}\n{''.join(r.choice('@+I#') for _ in range(n))}\n"


def test_reads_across_splits(spark, tmp_path, tiny_splits):
    """Splits of 700 bytes: reads longer than a split, empty reads, quality lines that look like ids."""
    r = random.Random(2)
    body = [_read(i, r) for i in range(400)]
    (tmp_path / "a.fastq").write_text("".join(body))
    (tmp_path / "b.fastq").write_text("@x\nA\n+\nI\n@y\n\n+\n\n@z\nAC\n+\nII")  # no line end at the end of the file
    (tmp_path / "c.fastq").write_text("")
    got = readers.read_fastq(spark, str(tmp_path)).filter("file like '%a.fastq'").orderBy("ordinal").collect()
    want = [tuple(x.split("\n")) for x in body]
    assert [(g.ordinal, "@" + g.id, g.seq, g.qual) for g in got] == [(i, w[0], w[1], w[3]) for i, w in enumerate(want)]
    assert readers.read_fastq(spark, str(tmp_path)).filter("file like '%b.fastq'").count() == 3
    plan = fastq.read_fastq(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan  # the text itself is behind a written table, no exchange of lines


@pytest.mark.parametrize("tiny", [False, True])
def test_damaged_fastq_loses_nothing(spark, tmp_path, tiny, request):
    if tiny:
        request.getfixturevalue("tiny_splits")
    r = random.Random(3)
    body = [_read(i, r) for i in range(60)]
    lines = body[:1] + ["\n"] + body[1:20] + ["r20\nACGT\n+\nIIII\n"] + body[21:40] + ["@r40\nACGT\n+\nII\n"] + body[41:] + ["@r60\nAC\n"]
    (tmp_path / "d.fastq").write_text("".join(lines))
    with pytest.raises(Exception, match="no FASTQ read in"):
        readers.read_fastq(spark, str(tmp_path)).count()
    got = readers.read_fastq(spark, str(tmp_path), broken="keep").collect()
    assert sorted(g.id for g in got if g.id) == sorted(f"r{i}" for i in range(60) if i not in (20, 40))
    bad = "\n".join(g.broken for g in got if g.broken is not None)
    assert all(x in bad for x in ("r20", "@r40", "@r60")) and all(g.id is None for g in got if g.broken is not None)
    one_blank = "".join([body[0], "\n", body[1], body[2], "\n\n"])
    (tmp_path / "d.fastq").write_text(one_blank)
    spark.catalog.clearCache()
    assert [g.id for g in readers.read_fastq(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["r0", "r1", "r2"]


def test_short_sam_lines_are_an_error(spark, tmp_path):
    row = "q\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII"
    (tmp_path / "ok.sam").write_text(f"@HD\tx\n{row}\n\n{row}\n")
    assert readers.read_sam(spark, str(tmp_path)).count() == 2
    (tmp_path / "bad.sam").write_text(f"{row}\nq\t0\tchr1\n")
    with pytest.raises(Exception, match="no alignment in"):
        readers.read_sam(spark, str(tmp_path)).count()


def test_sizes_are_rounded_once(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"f{i}").write_text("x")
    found = readers.file_inventory(spark, str(tmp_path))
    names = ",".join(r.path for r in found.collect())
    jobs = spark.createDataFrame([(1, names), (2, "none")], "job_id bigint, inputs string")
    assert {r.job_id: r.input_size for r in files.input_size(jobs, found).collect()} == {1: 1, 2: 0}


def test_many_barcode_shapes_are_one_join(spark):
    r = random.Random(4)
    codes = {"".join(r.choice("ACGTN") for _ in range(r.randrange(1, 9))) for _ in range(120)} | {"NNN"}
    named = sorted((f"b{i}", s) for i, s in enumerate(sorted(codes)))
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 14))) for _ in range(500)] + ["ACGTACGTACGT"] * 300 + [None]

    def fits(seq, code):
        return all(c == "N" or (k < len(seq) and seq[k] == c) for k, c in enumerate(code))

    def best(seq):
        hits = [(-len(s), s.count("N"), "".join("N" if c == "N" else "-" for c in s), b) for b, s in named if seq is not None and fits(seq, s)]
        return min(hits)[3] if hits else "unassigned"

    frame = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string")
    table = spark.createDataFrame(named, "barcode string, sequence string")
    for hot in (50, 10**6):
        made = reads.barcode_demux(frame, table, hot_rows=hot)
        assert {x.i: x.barcode for x in made.collect()} == {i: best(s) for i, s in enumerate(seqs)}
    assert made.columns == ["i", "seq", "barcode"]
    plan = reads.barcode_demux(frame, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1
