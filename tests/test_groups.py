"""Loops of any depth, and walks over groups of jobs instead of pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobscope.operators import graph

LINES = "script_id bigint, line_no bigint, text string"


def _walked(text):
    """(line number, loop variables) by walking through a script without annotations."""
    out, open_, covered = [], [], False
    for i, line in enumerate(text):
        code = line.lstrip(" ")
        if code.startswith("#loopStart:"):
            open_.append(code.split(":")[-1].split(" ")[0])
        elif code.startswith("for") and not covered:
            open_.append(code.split(" ")[1])
        elif code.startswith("done") and open_:
            open_.pop()
        covered = code.startswith("#loopStart:")
        out.append((i + 1, list(open_)))
    return out


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_paths_of_random_scripts(spark, hot_rows):
    r = random.Random(6)
    scripts = {k: [r.choice([f"for v{i} in x", f"  #loopStart:w{i}", "done", "done", "run"]) for i in range(90)] for k in range(6)}
    rows = [(k, i + 1, s) for k, text in scripts.items() for i, s in enumerate(text)]
    got = graph.loop_paths(spark.createDataFrame(rows, LINES), hot_rows=hot_rows)
    want = {(k, i): p for k, text in scripts.items() for i, p in _walked(text)}
    assert {(x.script_id, x.line_no): x.loop_path for x in got.collect()} == want
    assert got.columns == ["script_id", "line_no", "text", "depth", "loop_path"]
    some = graph.loop_paths(spark.createDataFrame(rows, LINES), hot_rows=hot_rows, only=F.col("line_no") % 7 == 0)
    assert {(x.script_id, x.line_no): x.loop_path for x in some.collect()} == {k: v for k, v in want.items() if k[1] % 7 == 0}


def test_five_thousand_open_loops(spark):
    rows = [(1, i + 1, f"for v{i} in x") for i in range(5000)] + [(1, 5001, "#@1,0,a,,x"), (1, 5002, "run"), (1, 5003, "")]
    got = graph.annotations(spark.createDataFrame(rows, LINES)).collect()
    assert [(x.line_no, x.depth, x.violation) for x in got] == [(5001, 5000, None)]
    assert got[0].loop_path == [f"v{i}" for i in range(5000)]


def test_repeated_line_numbers_stay(spark):
    frame = spark.createDataFrame([(1, 1, "for i in x"), (1, 2, "a"), (1, 2, "b"), (None, 1, "c")], LINES)
    assert sorted((x.text, x.loop_path) for x in graph.loop_paths(frame).collect()) == [("a", ["i"]), ("b", ["i"]), ("c", []), ("for i in x", ["i"])]


def test_submitting_commands_are_an_error(spark):
    text = ["#@1,0,a,,x", "run", "ssbatch go", "", "ssbatch outside", "#@2,1,b,,x", "# ssbatch", "run ssbatch", "", "#@3,1,c,,x", "#@4,1,d,,x", " ssbatch"]
    for hot_rows in (5, 10**6):
        got = graph.annotations(spark.createDataFrame([(1, i, s) for i, s in enumerate(text)], LINES), hot_rows=hot_rows)
        assert {x.step: x.violation for x in got.collect()} == {"1": "ssbatch_command", "2": None, "3": None, "4": "ssbatch_command"}


LINKS = "script_id int, step string, job_id bigint, dep_step string, loop_values string, n_deps bigint"
MEMBERS = "script_id int, dep_step string, loop_values string, dep_job bigint"


def _random_groups(spark, r, jobs=60, groups=14):
    members = {(g, r.randrange(jobs)) for g in range(groups) for _ in range(r.randrange(1, 6))}
    links = {(j, g) for j in range(jobs) for g in r.sample(range(groups), r.choice([0, 1, 1, 2]))}
    size = {g: sum(m[0] == g for m in members) for g in range(groups)}
    pairs = sorted({(d, j) for j, g in links for h, d in members if g == h})
    return (
        spark.createDataFrame([(1, "9", j, str(g), "", size[g]) for j, g in sorted(links)], LINKS),
        spark.createDataFrame([(1, str(g), "", d) for g, d in sorted(members)] * 2, MEMBERS),  # repeated rows change nothing
        spark.createDataFrame(pairs, "dep bigint, job_id bigint"),
    )


def test_walks_over_groups_are_walks_over_pairs(spark, same):
    r = random.Random(7)
    for _ in range(3):
        links, members, pairs = _random_groups(spark, r)
        rows = [(j, r.choice(["failed", "running", "pending", "unknown", "succeeded", "succeeded"])) for j in range(60)]
        state = spark.createDataFrame(rows, "job_id bigint, state string")
        same(graph.group_cancel(state, links, members), graph.propagate_cancel(state, pairs))
        done = state.filter("state = 'running'").select("job_id")
        most = state.withColumn("state", F.when(F.col("job_id") % 9 > 0, "succeeded").otherwise(F.col("state")))
        same(graph.group_ready(links, members, most, done, hot_rows=10), graph.ready_jobs(pairs, most, done))


def test_lists_tell_groups_apart(spark):
    members = [(1, "1", "", 5), (1, "1", "", 6), (2, "1", "", 5), (2, "1", "", 7)]
    links = [(1, "2", 10, "1", "", 2), (1, "2", 11, "1", "", 2), (2, "2", 12, "1", "", 2)]

    def lists(members):
        made = graph.group_lists(spark.createDataFrame(links, LINKS), spark.createDataFrame(members, MEMBERS))
        return {x.job_id: x.depend_on for x in made.collect()}

    first = lists(members)
    assert first[10] == first[11] != first[12]
    assert lists(members[::-1] + members[:1]) == first
    other = lists([*members[:3], (2, "1", "", 8)])
    assert other[10] == first[10] and other[12] != first[12]


def test_gather_of_many_jobs(spark):
    """10^5 jobs, then one that waits for all, then 10^5 that wait for it: edges stay in proportion."""
    n = 100_000
    ids = spark.range(n)
    members = ids.select(F.lit(1).alias("script_id"), F.lit("1").alias("dep_step"), F.lit("").alias("loop_values"), F.col("id").alias("dep_job"))
    members = members.unionByName(spark.createDataFrame([(1, "2", "", n)], MEMBERS))
    links = ids.select(
        F.lit(1).alias("script_id"), F.lit("3").alias("step"), (F.col("id") + n + 1).alias("job_id"), F.lit("2").alias("dep_step"),
        F.lit("").alias("loop_values"), F.lit(1).cast("bigint").alias("n_deps"),
    ).unionByName(spark.createDataFrame([(1, "2", n, "1", "", n)], LINKS))
    assert graph.group_edges(links, members).count() == 2 * (n + 1)
    state = spark.range(2 * n + 1).select(F.col("id").alias("job_id"), F.when(F.col("id") == 77, "failed").when(F.col("id") < n, "succeeded").otherwise("pending").alias("state"))
    got = {x.state: x["count"] for x in graph.group_cancel(state, links, members).groupBy("state").count().collect()}
    assert got == {"failed": 1, "succeeded": n - 1, "cancelled": n + 1}
    last = state.filter("job_id = 77").select("job_id")
    assert [x.job_id for x in graph.group_ready(links, members, state, last, hot_rows=1000).collect()] == [n]


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_few_loops_need_no_row_per_level(spark, hot_rows, monkeypatch):
    """Scripts with few loops and one with many, in one table and in tasks of a few lines."""
    monkeypatch.setattr(graph, "FLAT", 3)
    monkeypatch.setattr(graph, "TASK_LINES", 4)
    few = ["for a in x", "for b in x", "run", "done", "done", "done", "for c in x", "run"]
    many = [f"for v{i} in x" for i in range(6)] + ["run", "done", "run"]
    scripts = {1: few, 2: many, None: few}
    frame = spark.createDataFrame([(k, i + 1, s) for k, text in scripts.items() for i, s in enumerate(text)], LINES)
    got = {(x.script_id, x.line_no): x.loop_path for x in graph.loop_paths(frame, hot_rows=hot_rows).collect()}
    assert got == {(k, i): p for k, text in scripts.items() for i, p in _walked(text)}
    flat = graph.loop_paths(frame.filter("script_id = 1"))._jdf.queryExecution().analyzed().toString()
    assert "_level" not in flat and "collect_list" not in flat


def test_walk_writes_no_checkpoint(spark, monkeypatch):
    """Levels are written packed by column; a checkpoint of nodes takes more disk."""
    links = spark.createDataFrame([(1, "2", 2, "1", "", 1)], LINKS)
    members = spark.createDataFrame([(1, "1", "", 1)], MEMBERS)
    state = spark.createDataFrame([(1, "failed"), (2, "pending")], "job_id bigint, state string")

    def never(*args, **kwargs):
        raise AssertionError("checkpoint")

    monkeypatch.setattr(type(state), "checkpoint", never)
    assert {x.job_id: x.state for x in graph.group_cancel(state, links, members).collect()} == {1: "failed", 2: "cancelled"}


def _brute_groups(steps, jobs):
    """Sets of (script_id, job_id, dep_step, n_deps, first_dep, last_dep) and (script_id, dep_step, loop_values, dep_job), pair by pair."""
    links, members = set(), set()
    for script, step, deps, path in steps:
        for dep in {d for d in deps.split(".") if d not in ("", "0")}:
            other = [p for s, x, _, p in steps if (s, x) == (script, dep)]
            if not other or script is None:
                continue
            n = next((i for i, (a, b) in enumerate(zip(path, other[0])) if a != b), min(len(path), len(other[0])))
            text = lambda v: ",".join("\\N" if x is None else x.replace("\\", "\\\\").replace(",", "\\,") for x in v[:n])
            theirs = [(text(v), j) for s, j, x, v in jobs if (s, x) == (script, dep)]
            members |= {(script, dep, t, j) for t, j in theirs}
            for s, j, x, v in jobs:
                if (s, x) == (script, step) and (mine := [d for t, d in theirs if t == text(v)]):
                    links.add((script, j, dep, len(mine), min(mine), max(mine)))
    return links, members


@pytest.mark.parametrize("kept", [False, True])
@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_groups_of_random_scripts(spark, hot_rows, kept):
    """The same as pair by pair; scripts that fit a task need one shuffle, and no join that the driver could be asked to broadcast."""
    r = random.Random(11)
    steps, jobs = [], []
    for script in (1, 2, 3, None):
        for step in ("1", "2", "3", "4"):
            path = ["i", "j", "k"][: r.randrange(4)]
            steps.append((script, step, ".".join(r.choices(["0", "1", "2", "3", "4", "7", ""], k=3)), path))
            for _ in range(6):
                jobs.append((script, len(jobs), step, [r.choice(["a", "b", "a,b", "\\N", None]) for _ in path]))
        jobs.append((script, len(jobs), "8", ["a"]))  # of no step
    args = (
        spark.createDataFrame(steps, "script_id bigint, step string, deps string, loop_path array<string>"),
        spark.createDataFrame(jobs, "script_id bigint, job_id bigint, step string, values array<string>"),
    )
    links, members = graph.dependency_groups(*args, hot_rows=hot_rows, kept=kept)
    want = _brute_groups(steps, jobs)
    got = [(x.script_id, x.job_id, x.dep_step, x.n_deps, x.first_dep, x.last_dep) for x in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want[0]
    got = [(x.script_id, x.dep_step, x.loop_values, x.dep_job) for x in members.collect()]
    assert len(got) == len(set(got)) and set(got) == want[1]
    if hot_rows > 5 and not kept:
        plan = graph.dependency_groups(*args)[0]._jdf.queryExecution().sparkPlan().toString()
        assert not re.search(r"(Hash|Merge|Loop|Product)\w*Join", plan) and plan.count("Exchange") == 1


def test_a_level_of_a_walk_shuffles_no_edges(spark, monkeypatch):
    """Links and members lie in buckets: only the nodes that a level begins at are shuffled to them."""
    monkeypatch.setattr(graph.scale, "SMALL_ROWS", 0)
    links, members, _ = _random_groups(spark, random.Random(3))
    sides = graph.group_sides(links, members)
    for edges, keys in zip(sides, (graph.GROUP, ["job_id"])):
        step, _ = graph._under(edges, edges.select(*keys).distinct(), keys, 1)
        plan = step._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHash" not in plan and "SortMergeJoin" not in plan
        assert step._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_rerun_over_groups_is_rerun_over_pairs(spark, same):
    """Also for jobs that are there twice, and with the columns that are asked for only."""
    r = random.Random(5)
    links, members, pairs = _random_groups(spark, r)
    waits = {j: sorted(d for d, k in pairs.collect() if k == j) for j in range(60)}
    rows = [(j, f"{j % 4}.0.{j}", ":".join(map(str, waits[j])) or "null") for j in [*range(60), 7]]
    jobs = spark.createDataFrame(rows, "job_id bigint, flag string, depend_on string")
    markers = spark.createDataFrame([(f, "success") for _, f, _ in rows if r.random() < 0.8], "flag string, kind string")
    prior = spark.createDataFrame([(f, d if r.random() < 0.5 else "other", r.random() < 0.6) for _, f, d in rows[:60]], "flag string, depend_on string, active boolean")
    want = graph.rerun_plan(jobs, markers, prior, rerun_steps=["3"])
    assert want.columns == ["job_id", "flag", "depend_on", "action"]
    assert len({x.action for x in want.collect()}) > 2
    got = graph.rerun_plan(jobs, markers, prior, rerun_steps=["3"], groups=(links, members), columns=["job_id"])
    same(got, want.select("job_id", "action"))


def test_lists_stay_short(spark):
    """A list's text travels with its job through every join: it doesn't grow with the groups' names or number."""
    links = spark.createDataFrame([(1, "2", 10, str(k), "value" * 50, 1) for k in range(40)], LINKS)
    members = spark.createDataFrame([(1, str(k), "value" * 50, k + m) for k in range(40) for m in (0, 100)], MEMBERS)
    for hot_rows in (10**6, 1):
        assert [len(x.depend_on) for x in graph.group_lists(links, members, hot_rows).collect()] == [24]
