"""What comes to the driver or is broadcast has a bound; results are the same on either side of it."""

import hashlib

import pytest
from pyspark.sql import functions as F

from jobscope import scale
from jobscope.operators import efficiency, files, models, reads
from jobscope.scale import Running, grouped_scan, hot_keys, skew_join
from jobscope.session import as_written, broadcast_bytes, written_bytes
from jobscope.sources import readers


def _keys(spark, sizes):
    rows = [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "k bigint, id bigint")


def test_hot_keys_have_a_bound(spark, same, monkeypatch):
    df = _keys(spark, [40, 30, 30, 30, 8, 8, 2])
    assert {r.k: r._parts for r in hot_keys(df, ["k"], 5).rows.collect()} == {0: 8, 1: 6, 2: 6, 3: 6, 4: 2, 5: 2}
    monkeypatch.setattr(scale, "MAX_HOT", 2)
    hot = hot_keys(df, ["k"], 5)
    # three keys are looked at, the third of 30 rows; what they hold is cut into two long parts
    assert hot.rows is None or sum(r._parts for r in hot.rows.collect()) <= 4
    want = grouped_scan(df, ["k"], ["id"], {"n": Running("count")}, 10**9)
    for most in (1, 2, 3, 50):
        monkeypatch.setattr(scale, "MAX_HOT", most)
        same(grouped_scan(df, ["k"], ["id"], {"n": Running("count")}, 5), want)


@pytest.mark.parametrize("threshold", ["-1", "10MB", "1"])
def test_right_side_is_judged_by_its_bytes(spark, same, threshold):
    left, right = _keys(spark, [50, 3, 1]), spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (7, "d")], "k bigint, x string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            same(skew_join(left, right, ["k"], how, hot_rows=10), left.join(right, ["k"], how))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bytes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, n in (("10485760b", 10485760), ("10MB", 10485760), ("64k", 65536), ("-1", -1), ("1g", 1 << 30), ("12", 12)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert broadcast_bytes(spark) == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    few, many = (written_bytes(as_written(spark.range(n).toDF("x"))) for n in (10, 100_000))
    assert 0 < few < many
    assert written_bytes(as_written(spark.range(0).toDF("x"))) < few


def test_medians(spark):
    rows = [("p", "r", x, 1.0, 1.0) for x in (5, 1, 9)] + [("p", None, x, 1.0, 1.0) for x in (4, 1, 8, 2)] + [("q", "r", 7, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "program string, ref string, input_size bigint, mem_used double, min_used double")
    for hot_rows in (1, 2, 10**6):
        got = {(r.program, r.ref): r.x_median for r in models.size_medians(points, hot_rows).collect()}
        assert got == {("p", "r"): 5.0, ("p", None): 3.0, ("q", "r"): 7.0}


def test_scores_with_a_hot_key(t, same, monkeypatch):
    from jobscope.operators.ledger import ledger_points

    table = models.model_table(t.ledger)
    want = models.score_models(t.requests, table)
    monkeypatch.setattr(scale, "SMALL_ROWS", 0)
    same(models.score_models(t.requests, table, hot_rows=20), want)
    assert ledger_points(t.ledger).count() > 20


def _digest(logs, error):
    out = []
    for name, lines in logs.items():
        n, size, tail = len(lines), sum(len(x.encode()) + 1 for x in lines), 10 if error else 20
        for i, x in enumerate(lines, 1):
            if size < 9000:
                out.append((name, i, x, "all"))
            else:
                out += [(name, i, x, "head")] if i <= 20 and not error else []
                out += [(name, i, x, "tail")] if i > n - tail else []
    return sorted(out)


@pytest.mark.parametrize("error", [False, True])
def test_digest(spark, error):
    logs = {
        "short": ["a", "", "ä"], "empty lines": [""] * 8999, "too many": [""] * 9000, "long": [f"line {i}" for i in range(30_000)],
        "few long lines": ["x" * 3000] * 3 + ["ä" * 10], "near both ends": ["y" * 400] * 30,
    }
    rows = [(k, i, x) for k, lines in logs.items() for i, x in enumerate(lines, 1)]
    frame = spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(5)
    want = _digest(logs, error)
    for hot_rows in (100, 10**9):
        assert sorted(tuple(r) for r in files.log_digest(frame, error, hot_rows).collect()) == want


def test_descriptor(spark):
    lines = [(f"{i} 1 read({i % 2 + 3}, ...) = 0") for i in range(60)]  # the last 50: 25 of each
    lines += ["1 2 write(9) = 1", "1 2 pread(7, x)", "1 2 read(x) = ?", "1 2 wait4(1)"]
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", 0, "futex(1)"), ("c", 0, "read(12"), ("d", 0, "read(y)")]
    got = files.read_descriptor(spark.createDataFrame(rows, "file string, line_no bigint, line string"))
    assert {tuple(r) for r in got.collect()} == {("a", "4", 24), ("c", "12", 1)}


def test_checksums_on_both_ways(spark, tmp_path, monkeypatch):
    (tmp_path / "in side").mkdir()
    given = {"a.txt": b"", "b ü.bin": bytes(range(256)) * 50, "in side/c": b"x"}
    for name, body in given.items():
        (tmp_path / name).write_bytes(body)
    want = sorted((name.split("/")[-1], len(body), hashlib.md5(body).hexdigest()) for name, body in given.items())
    for most in (64 << 20, 10, -1):
        monkeypatch.setattr(readers, "LOADED", most)
        found = readers.file_inventory(spark, str(tmp_path), md5=True)
        assert found.columns == ["path", "dir", "name", "bytes", "size_kib", "md5"]
        assert sorted((r.path.split("/")[-1], r.bytes, r.md5) for r in found.collect()) == want


def test_an_empty_input_is_no_missing_one(spark, tmp_path):
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "one.txt").write_bytes(b"x")
    inventory = readers.file_inventory(spark, str(tmp_path))
    path = {r.name: r.path for r in inventory.collect()}
    jobs = spark.createDataFrame([(1, f",{path['none.txt']}"), (2, f",{path['none.txt']} {path['one.txt']}"), (3, ",/not/there")], "job_id int, inputs string")
    got = {r.job_id: (r.input_size, r.missing_input) for r in files.input_size(jobs, inventory).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (None, True)}


def test_positions(spark):
    rows = [(f"q{i % 7}", i % 3, f"chr{i % 2}", i % 5) for i in range(200)]
    frame = spark.createDataFrame(rows, "qname string, flag int, rname string, pos bigint").repartition(6)
    got = reads.sorted_positions(reads.sort_alignments(frame)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 201))
    assert [(r.rname, r.pos, r.qname, r.flag) for r in got] == sorted((r[2], r[3], r[0], r[1]) for r in rows)
    assert reads.sorted_positions(reads.sort_alignments(frame.limit(0))).count() == 0


def test_mates_that_are_both_or_of_one_sample(spark):
    both = reads.FIRST | reads.SECOND
    rows = [("a", both, "c", 1), ("b", reads.FIRST, "c", 2), ("b", reads.SECOND, "c", 3), ("b", reads.SECOND, "c", 1), (None, reads.FIRST, "c", 5), (None, reads.SECOND, "c", 6)]
    frame = spark.createDataFrame(rows, "qname string, flag int, rname string, pos bigint")
    for hot_rows in (1, 10**6):
        pairs = {(r.qname, r.r1_pos, r.r2_pos) for r in reads.pair_mates(frame, hot_rows).collect()}
        assert pairs == {("a", 1, 1), ("b", 2, 1), (None, 5, 6)}
        assert [tuple(r) for r in reads.orphans(frame, hot_rows).collect()] == [("b", reads.SECOND, "c", 3)]


def test_interactive_partitions_go(spark):
    rows = [(1, "interactive"), (2, "short"), (3, None), (4, "my_interactive_x")]
    got = efficiency.exclude_interactive(spark.createDataFrame(rows, "job_id int, partition_name string"))
    assert sorted(r.job_id for r in got.collect()) == [2, 3]
