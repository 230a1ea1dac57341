"""Job graphs: edges, state, cancellation, readiness, re-runs, annotated scripts.

graph: job_id, depend_on (``null`` or ``id:id``), flag [, program, ref, inputs].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope import scale
from jobscope.functions.jobs import step_of
from jobscope.scale import HOT_ROWS, Hot, Running, attach, grouped_scan, hot_from_counts, hot_keys, skew_join
from jobscope.session import as_bucketed, as_written

# fixed values
FIRST_BATCH = 5
DONE_STATES = ["succeeded", "failed", "cancelled"]


def job_edges(graph: DataFrame) -> DataFrame:
    """(dep, job_id), one row per dependency, as text-free ids of job_id's type."""
    kind = dict(graph.dtypes)["job_id"]
    deps = F.filter(F.split("depend_on", ":"), lambda d: (F.lower(d) != "null") & (F.trim(d) != ""))
    return graph.select(F.explode(deps).alias("dep"), "job_id").select(F.col("dep").cast(kind).alias("dep"), "job_id")


def job_state(
    graph: DataFrame,
    markers: DataFrame,
    queue: DataFrame,
    requeues: DataFrame | None = None,
    order: str = "chart",
) -> DataFrame:
    """State per job. markers: flag, kind; queue: job_id, code; requeues: job_id.

    ``chart`` looks at requeue markers before the queue and lets a requeue
    record win over everything; ``console`` looks at the queue first.
    """
    marks = markers.groupBy("flag").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in ("success", "failed", "requeued")]
    )
    code = queue.groupBy("job_id").agg(F.max(F.substring("code", 1, 1)).alias("_code"))
    df = graph.join(marks, ["flag"], "left").join(code, ["job_id"], "left")
    live = [("_code", "R", "running"), ("_code", "P", "pending")]
    requeued = [("_requeued", True, "requeued")]
    cases = [("_success", True, "succeeded"), ("_failed", True, "failed")]
    cases += requeued + live if order == "chart" else live + requeued
    state = F.lit("unknown")
    for col, value, name in reversed(cases):
        state = F.when(F.col(col) == value, name).otherwise(state)
    if requeues is not None and order == "chart":
        again = requeues.select("job_id").distinct().withColumn("_again", F.lit(True))
        df = df.join(again, ["job_id"], "left")
        state = F.when(F.col("_again"), "requeued").otherwise(state)
    return df.select(*graph.columns, state.alias("state"))


def _under(edges: DataFrame, above: DataFrame, keys: Sequence[str], rows: int, hot: Hot | None = None) -> tuple[DataFrame, Hot | None]:
    """Edges that begin at a node of ``above`` (some ``rows`` of them), and the hot keys once they are known."""
    if rows <= scale.SMALL_ROWS:
        return edges.join(F.broadcast(above), list(keys), "left_semi"), hot
    hot = hot or hot_keys(edges, keys)
    # the nodes are hashed and not the edges sorted, of which there may be many more
    return skew_join(edges, above.hint("shuffle_hash"), keys, "left_semi", hot=hot), hot


def _fresh(step: DataFrame, found: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """New nodes only, each once: one grouping for both."""
    reached = _union([step.select(*keys, F.lit(False).alias("_old"))] + [d.withColumn("_old", F.lit(True)) for d in found])
    return reached.groupBy(*keys).agg(F.bool_or("_old").alias("_old")).filter(~F.col("_old")).select(*keys)


def descendants(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Every job reachable from the seeds (seeds excluded unless reached).

    One join and one grouping per level. Each level is written, packed by column, so the
    plan stays short and a lost executor does not replay the walk. edges are
    read once per level: give a written table.
    """
    found, hot = [], None
    frontier = as_written(seeds.select("job_id").distinct())
    while rows := scale.small_count(frontier):
        step, hot = _under(edges, frontier.withColumnRenamed("job_id", "dep"), ["dep"], rows, hot)
        frontier = as_written(_fresh(step, found, ["job_id"]))
        found.append(frontier)
        if len(found) == 16:
            found = [as_written(_union(found))]
    return _union(found) if found else seeds.select("job_id").limit(0)


def _union(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def propagate_cancel(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything below a failed job becomes cancelled; done jobs stop the walk.

    state: job_id, state. edges: dep, job_id.
    """
    # both are read once per level: keep them instead of what made them
    state = as_written(state)
    open_jobs = state.filter(~F.col("state").isin(DONE_STATES)).select("job_id")
    open_edges = as_written(edges.join(open_jobs, ["job_id"], "left_semi"))
    hit = descendants(state.filter(F.col("state") == "failed"), open_edges).withColumn("_hit", F.lit(True))
    return state.join(hit, ["job_id"], "left").select(
        *[c for c in state.columns if c != "state"],
        F.when(F.col("_hit"), "cancelled").otherwise(F.col("state")).alias("state"),
    )


def ready_jobs(edges: DataFrame, state: DataFrame, finished: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Direct dependants of just finished jobs whose every dependency succeeded."""
    now = finished.select(F.col("job_id").alias("dep")).distinct().withColumn("_now", F.lit(True))
    ok = state.select(F.col("job_id").alias("dep"), (F.col("state") == "succeeded").alias("_ok"))
    per_dep = skew_join(edges, ok.join(now, ["dep"], "full"), ["dep"], "left", hot_rows=hot_rows)
    done = F.coalesce("_now", F.lit(False)) | F.coalesce("_ok", F.lit(False))
    return (
        per_dep.groupBy("job_id")
        .agg(F.bool_and(done).alias("_all"), F.bool_or(F.coalesce("_now", F.lit(False))).alias("_touched"))
        .filter(F.col("_all") & F.col("_touched"))
        .select("job_id")
    )


# ---- the same over groups of jobs: links and members as dependency_groups gives them ----

GROUP = ["script_id", "dep_step", "loop_values"]


def group_edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """(dep, job_id) between nodes, each a job or a group: members lead to their group, a group to the jobs that wait for it.

    n members and m waiting jobs are n + m edges. A node is a struct of the job's id
    and the group's key, of which the other is null.
    """
    kind = links.schema["job_id"].dataType
    group = F.struct(F.lit(None).cast(kind).alias("job"), *[F.col(c) for c in GROUP])
    types = dict(links.dtypes)

    def job(c: str) -> Column:
        return F.struct(F.col(c).cast(kind).alias("job"), *[F.lit(None).cast(types[g]).alias(g) for g in GROUP])

    into = members.select(job("dep_job").alias("dep"), group.alias("job_id")).distinct()
    return into.unionByName(links.select(group.alias("dep"), job("job_id").alias("job_id")))


def group_sides(links: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links by group and members by job, in buckets: a level of a walk shuffles the nodes it begins at, not all edges."""
    kind = links.schema["job_id"].dataType
    into = members.select(F.col("dep_job").cast(kind).alias("job_id"), *GROUP).filter("job_id is not null")
    return as_bucketed(links.select(*GROUP, "job_id"), GROUP, "links"), as_bucketed(into, ["job_id"], "members")


def group_descendants(seeds: DataFrame, sides: tuple[DataFrame, DataFrame], among: DataFrame | None = None) -> DataFrame:
    """Jobs (``among`` those given) reachable from the seeds (job_id) over ``group_sides``: from jobs to their groups and on to the jobs that wait for them."""
    links, members = sides
    found, groups, hot_member, hot_link = [], [], None, None
    frontier = as_written(seeds.select(F.col("job_id").cast(links.schema["job_id"].dataType)).distinct())
    while rows := scale.small_count(frontier):
        step, hot_member = _under(members, frontier, ["job_id"], rows, hot_member)
        group = as_written(_fresh(step, groups, GROUP))
        groups.append(group)
        step, hot_link = _under(links, group, GROUP, scale.small_count(group), hot_link)
        new = _fresh(step, found, ["job_id"])
        frontier = as_written(new if among is None else new.join(among, ["job_id"], "left_semi"))
        found.append(frontier)
        if len(found) == 16:
            found, groups = [as_written(_union(found))], [as_written(_union(groups))]
    return _union(found) if found else seeds.select("job_id").limit(0)


def group_cancel(state: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """``propagate_cancel`` where jobs wait for groups: a failed member cancels all that wait for its group."""
    state = as_bucketed(state, ["job_id"], "state")
    open_jobs = state.filter(~F.col("state").isin(DONE_STATES)).select("job_id")
    sides = group_sides(links, members)
    hit = group_descendants(state.filter(F.col("state") == "failed"), sides, open_jobs).withColumn("_hit", F.lit(True))
    return state.join(hit, ["job_id"], "left").select(
        *[c for c in state.columns if c != "state"],
        F.when(F.col("_hit"), "cancelled").otherwise(F.col("state")).alias("state"),
    )


def group_ready(
    links: DataFrame, members: DataFrame, state: DataFrame, finished: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``ready_jobs`` where jobs wait for groups: each group is counted down once, for all jobs that wait for it."""
    now = finished.select(F.col("job_id").alias("dep_job")).distinct().withColumn("_now", F.lit(True))
    ok = state.select(F.col("job_id").alias("dep_job"), (F.col("state") == "succeeded").alias("_ok"))
    known = skew_join(members, ok.join(now, ["dep_job"], "full"), ["dep_job"], "left", spread=GROUP, hot_rows=hot_rows)
    just = F.coalesce("_now", F.lit(False))
    left = known.groupBy(*GROUP).agg(
        F.count_if(~(just | F.coalesce("_ok", F.lit(False)))).alias("_left"), F.bool_or(just).alias("_touched")
    )
    return (
        skew_join(links, left, GROUP, "left", ["job_id"], hot_rows)
        .groupBy("job_id")
        .agg(F.max(F.coalesce("_left", F.lit(1))).alias("_left"), F.bool_or("_touched").alias("_touched"))
        .filter("_left = 0 and _touched")
        .select("job_id")
    )


def group_lists(links: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(job_id, depend_on): one text per job that is the same only if it waits for the same jobs of the same groups.

    A group is named by its key, its size and two sums over hashes of its
    distinct members, so neither their order nor their number makes the text long.
    Names and lists go on as 16 bytes of hash: a text travels with its job through every join.
    """
    def short(text: Column) -> Column:
        return F.unhex(F.md5(text))

    def total(salt: str) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), "dep_job").cast("decimal(38,0)")).cast("string")

    if hot_keys(members, GROUP, hot_rows).rows is None:
        # one shuffle for both groupings; a hot group would lie in one task
        members = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *GROUP)
    digest = members.select(*GROUP, "dep_job").distinct().groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_n"), total("a").alias("_a"), total("b").alias("_b")
    ).select(*GROUP, short(F.to_json(F.struct(*GROUP, "_n", "_a", "_b"))).alias("_id"))
    links = links.select("job_id", *GROUP)
    named = skew_join(links, digest, GROUP, "left", ["job_id"], hot_rows, hot_keys(links, GROUP, hot_rows))
    named = named.select("job_id", F.coalesce("_id", short(F.to_json(F.struct(*GROUP)))).alias("_id"))
    # one entry per step that the job waits for
    return named.groupBy("job_id").agg(
        F.base64(short(F.to_json(F.sort_array(F.collect_set("_id"))))).alias("depend_on")
    )


def replace_job(graph: DataFrame, renamed: DataFrame) -> DataFrame:
    """Put new ids for old ones in nodes and dependency lists; renamed: old_id, new_id."""
    pairs = renamed.select(F.col("old_id").cast("string").alias("_old"), F.col("new_id").cast("string").alias("_new"))
    items = graph.select("job_id", F.posexplode(F.split("depend_on", ":")).alias("_i", "_old"))
    lists = (
        skew_join(items, pairs, ["_old"], "left", spread=["job_id"])
        .groupBy("job_id")
        # no longer than the list in the job's own row
        .agg(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("_new", "_old").alias("d")))).alias("_l"))
        .select("job_id", F.array_join(F.transform("_l", lambda x: x["d"]), ":").alias("depend_on"))
    )
    kind = dict(graph.dtypes)["job_id"]
    nodes = graph.drop("depend_on").withColumn("_old", F.col("job_id").cast("string"))
    return (
        nodes.join(lists, ["job_id"], "left")
        .join(pairs, ["_old"], "left")
        .withColumn("job_id", F.coalesce(F.col("_new").cast(kind), F.col("job_id")))
        .select(*graph.columns)
    )


def active_jobs(graph: DataFrame, queue: DataFrame) -> DataFrame:
    """Jobs of a run that are still queued, by exact id."""
    return graph.join(queue.select("job_id").distinct(), ["job_id"], "left_semi")


def run_summary(states: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Counts by state, the headline text and whether the run is over."""
    names = {"succ": "succeeded", "requeue": "requeued", "running": "running", "pending": "pending", "fail": "failed"}
    counted = states.groupBy(*run).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("state") == s).alias(n) for n, s in names.items()],
        F.count_if(~F.col("state").isin(list(names.values()))).alias("unknown"),
    )
    total = F.concat(F.lit("/"), F.col("total").cast("string"))
    pieces = [F.col("done").cast("string"), total]
    for n in ("succ", "requeue", "running", "pending", "fail", "unknown"):
        pieces += [F.lit(f" {n.capitalize()}:"), F.col(n).cast("string"), total]
    return (
        counted.withColumn("done", F.col("succ") + F.col("fail") + F.col("requeue"))
        .withColumn("text", F.concat(*pieces))
        .withColumn("finished", (F.col("running") == 0) & (F.col("pending") == 0))
    )


def first_batch_hold(graph: DataFrame, n: int = FIRST_BATCH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Jobs without dependencies: the first n of a step start, the rest wait.

    ``wave`` 0 starts at once; wave k is let go by the k-th completion.
    """
    free = graph.filter(F.lower("depend_on") == "null").withColumn("step", step_of(F.col("flag")))
    ranked = grouped_scan(free, ["step"], ["job_id"], {"_before": Running("count", before=True)}, hot_rows)
    return (
        ranked.withColumn("wave", F.floor(F.col("_before") / n).cast("bigint"))
        .withColumn("held", F.col("wave") > 0)
        .drop("_before")
    )


def rerun_plan(
    graph: DataFrame,
    markers: DataFrame,
    prior: DataFrame,
    rerun_steps: Sequence[str] = (),
    rerun_all: bool = False,
    groups: tuple[DataFrame, DataFrame] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """What to do with each job when a workflow is started again.

    prior: flag, depend_on, active (still queued or running). A job that
    succeeded and has nothing to re-run above it is skipped; a job that is
    still active is kept while its dependency list is unchanged and nothing
    above it is submitted again; all others are submitted. With ``groups``
    (links, members) these are the dependencies, and ``depend_on`` is any text
    that tells dependency lists apart, as ``group_lists`` makes it. The result has the
    graph's ``columns``, all of them unless told: texts not asked for are not written.
    """
    won = markers.filter(F.col("kind") == "success").select("flag").distinct().withColumn("_won", F.lit(True))
    old = prior.select("flag", F.col("depend_on").alias("_deps"), F.col("active").alias("_active"))
    unchanged = F.coalesce(F.col("_active"), F.lit(False)) & F.col("_deps").eqNullSafe(F.col("depend_on"))
    nodes = graph.join(won, ["flag"], "left").join(old, ["flag"], "left")
    again = F.lit(rerun_all) | step_of(F.col("flag")).isin(list(rerun_steps))
    columns = list(graph.columns if columns is None else columns)
    # by job: what the walks find is joined to it, and it stays where it lies
    nodes = as_bucketed(
        nodes.select(
            *dict.fromkeys(["job_id", *columns]), "_active", unchanged.alias("_same"), (F.col("_won").isNull() | again).alias("_seed")
        ), ["job_id"], "nodes",
    )
    edges = as_written(job_edges(graph)) if groups is None else group_sides(*groups)
    walk = descendants if groups is None else group_descendants
    seeds = nodes.filter("_seed").select("job_id")
    need = as_written(seeds.unionByName(walk(seeds, edges)).distinct()).withColumn("_need", F.lit(True))
    todo = nodes.join(need, ["job_id"], "left")
    fresh = todo.filter(F.col("_need") & ~F.col("_same")).select("job_id")
    submit = fresh.unionByName(walk(fresh, edges)).distinct().withColumn("_submit", F.lit(True))
    action = (
        F.when(F.col("_need").isNull(), "skip")
        .when(F.col("_submit").isNull(), "keep")
        .when(F.coalesce(F.col("_active"), F.lit(False)), "resubmit")
        .otherwise("submit")
    )
    return todo.join(submit, ["job_id"], "left").select(*columns, action.alias("action"))


def run_catalog(graph: DataFrame, logs: DataFrame) -> DataFrame:
    """Runs and submission logs with their job counts.

    graph: folder, line_no, job_id text; logs: folder, line.
    """
    runs = graph.groupBy("folder").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.max_by(F.col("job_id").cast("string"), "line_no").startswith("0").alias("dry_run"),
    ).withColumn("kind", F.lit("folder"))
    files = logs.groupBy("folder").agg(
        F.count_if(F.col("line").startswith("Submitted batch job")).alias("jobs"),
        (~F.bool_or(F.col("line").contains("useTmp run"))).alias("dry_run"),
    ).withColumn("kind", F.lit("file"))
    return runs.unionByName(files)


# ---- annotated scripts: script_id, line_no, text ----


def _word(text: Column) -> Column:
    return F.substring_index(F.ltrim(text), " ", 1)


# what a line is: at most one of these
NOTE, BLANK, MARK, FOR, DONE, SUBMIT = range(1, 7)
FLAT = 8  # loops of a script that are named in columns of its lines
TASK_LINES = 1_000_000


def _kinds(lines: DataFrame) -> DataFrame:
    """Lines with ``_kind`` and, where one opens a loop, its ``_name``: all that the walk needs of a text."""
    code = F.ltrim("text")
    mark = code.startswith("#loopStart:")
    kind = (
        F.when(code.startswith("#@"), NOTE).when(F.trim("text") == "", BLANK).when(mark, MARK)
        .when(code.startswith("for"), FOR).when(code.startswith("done"), DONE).when(code.startswith("ssbatch"), SUBMIT).otherwise(0)
    )
    name = F.when(mark, _word(F.substring_index(code, ":", -1))).when(
        code.startswith("for"), _word(F.substring(code, F.instr(code, " ") + 1, F.length(code)))
    )
    return lines.withColumns({"_kind": kind.cast("tinyint"), "_name": name})


def _scripts(kinds: DataFrame, hot_rows: int) -> tuple[DataFrame, Hot, DataFrame | None]:
    """Lines by script in tasks of some TASK_LINES, long scripts, and scripts with more than FLAT loops if there are any."""
    counts = kinds.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_kind").isin(MARK, FOR)).alias("_loops")
    )
    total, longest, loops = counts.agg(F.sum("_n"), F.max("_n"), F.max("_loops")).first()
    hot = hot_from_counts(counts.select("script_id", "_n"), hot_rows) if (longest or 0) > hot_rows else Hot(None)
    deep = None
    if (loops or 0) > FLAT:
        deep = as_written(counts.filter(F.col("_loops") > FLAT).select("script_id", F.lit(True).alias("_deep")), "deep")
    tasks = (total or 0) // TASK_LINES + 1
    if tasks > 1 and hot.rows is None:
        kinds = kinds.repartition(max(tasks, kinds.sparkSession.sparkContext.defaultParallelism), "script_id")
    return kinds, hot, deep


def _depths(kinds: DataFrame, hot: Hot) -> DataFrame:
    """Lines with ``depth``, whether they open a loop (``_open``) and whether they are part of a command (``_command``)."""
    order, kind = (["script_id"], ["line_no"]), F.col("_kind")

    def last_line(k: int) -> Running:
        return Running("last", F.when(kind == k, F.col("line_no")), before=True)

    seen = grouped_scan(kinds, *order, {"_note": last_line(NOTE), "_blank": last_line(BLANK), "_mark": last_line(MARK)}, hot=hot)
    command = F.col("_note").isNotNull() & (F.col("_note") > F.coalesce(F.col("_blank"), F.lit(-1)))
    covered = F.coalesce(F.col("_mark") == F.col("line_no") - 1, F.lit(False))
    opens = ((kind == MARK) | ((kind == FOR) & ~covered)) & ~command
    moves = seen.withColumns({"_command": command, "_open": opens, "_closes": (kind == DONE) & ~command}).drop("_note", "_blank", "_mark").withColumn(
        "_move", F.when(F.col("_open"), 1).when(F.col("_closes"), -1).otherwise(0).cast("bigint")
    )
    level = grouped_scan(moves, *order, {"_sum": Running("sum", F.col("_move"))}, hot=hot)
    # a stray "done" closes nothing: lift the running sum by how far it fell below zero
    low = grouped_scan(level, *order, {"_low": Running("min", F.col("_sum"))}, hot=hot)
    return low.withColumn("depth", F.col("_sum") - F.least(F.col("_low"), F.lit(0).cast("bigint"))).drop("_sum", "_low", "_move", "_closes")


def _flat_paths(depth: DataFrame, own: list[str], asked: Column, hot: Hot) -> DataFrame:
    """Paths of lines with FLAT loops around them at most: a column per level, in the order that the lines have already."""
    named = grouped_scan(
        depth, ["script_id"], ["line_no"],
        {f"_loop{k}": Running("last", F.when(F.col("_open") & (F.col("depth") == k), F.col("_name"))) for k in range(1, FLAT + 1)}, hot=hot,
    )
    path = F.slice(F.array(*[f"_loop{k}" for k in range(1, FLAT + 1)]), F.lit(1), F.col("depth").cast("int"))
    return named.filter(asked).select(*own, path.alias("loop_path"))


def _deep_paths(depth: DataFrame, own: list[str], asked: Column, hot_rows: int, hot: Hot) -> DataFrame:
    """Paths of any length: a line is a row per level around it, and on each level the last loop opened is its own."""
    # lines that are not asked for are only there to name the level they open
    around = F.when(asked, F.sequence(F.lit(0).cast("bigint"), F.col("depth"))).when(F.col("_open"), F.array("depth"))
    levels = depth.select("script_id", "line_no", "depth", F.struct(*own).alias("_own"), asked.alias("_asked"),
                          F.when(F.col("_open"), F.col("_name")).alias("_var"), F.explode(around).alias("_level"))
    levels = levels.select(
        "script_id", "line_no", "_level", "_asked", F.when(F.col("_level") == 0, F.col("_own")).alias("_own"),
        F.when(F.col("_level") == F.col("depth"), F.col("_var")).alias("_opened"),
    )
    named = grouped_scan(
        levels, ["script_id", "_level"], ["line_no"], {"_loop": Running("last", F.col("_opened"))}, hot_rows, hot.within()
    )
    # as many rows as loops around the line; rows with one line number stay rows of their own
    whole = named.filter("_asked").groupBy("script_id", "line_no").agg(
        F.collect_list("_own").alias("_lines"),
        F.sort_array(F.collect_set(F.when(F.col("_level") > 0, F.struct("_level", "_loop")))).alias("_path"),
    )
    path = F.slice(F.transform("_path", lambda x: x["_loop"]), F.lit(1), F.col("_line.depth").cast("int"))
    return whole.select(F.explode("_lines").alias("_line"), "_path").select("_line.*", path.alias("loop_path"))


def _paths(kinds: DataFrame, own: list[str], asked: Column, hot_rows: int, hot: Hot, deep: DataFrame | None) -> DataFrame:
    """Lines that are asked for with ``own`` columns and their path; scripts with many loops go their own way."""
    if deep is None:
        return _flat_paths(_depths(kinds, hot), own, asked, hot)
    marked = attach(kinds, deep, ["script_id"])
    few, many = marked.filter("_deep is null").drop("_deep"), marked.filter("_deep").drop("_deep")
    return _flat_paths(_depths(few, hot), own, asked, hot).unionByName(_deep_paths(_depths(many, hot), own, asked, hot_rows, hot))


def loop_paths(lines: DataFrame, hot_rows: int = HOT_ROWS, only: Column | None = None) -> DataFrame:
    """Every line, or those that ``only`` holds for, with the array of loop variables around it.

    ``#loopStart:v`` opens a loop and takes over the ``for`` line right below;
    ``for v`` opens one; ``done`` closes the innermost. The lines from an
    annotation to the next blank line are its command and move no loop.
    Loops may be nested to any depth.
    """
    asked = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    kinds, hot, deep = _scripts(_kinds(lines).withColumn("_asked_for", asked), hot_rows)
    return _paths(kinds, [*lines.columns, "depth"], F.col("_asked_for"), hot_rows, hot, deep)


def annotations(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Job steps of annotated scripts, with the first rule each one breaks."""
    # other lines move no loop, end no command and break no rule: they are not shuffled
    kept = lines.filter(F.ltrim("text").rlike("^(#loopStart:|for|done|#@|ssbatch|\\s*$)"))
    # of the others no text is needed
    kinds = _kinds(kept).withColumn("text", F.when(F.col("_kind") == NOTE, F.col("text")))
    kinds, hot, deep = _scripts(kinds, hot_rows)
    note = F.col("_kind") == NOTE
    found = _paths(
        kinds, [*lines.columns, "depth", "_kind"], note | ((F.col("_kind") == SUBMIT) & F.col("_command")), hot_rows, hot, deep
    )
    # read from the end: does a submitting line of a command come before the next annotation?
    ahead = grouped_scan(
        found.withColumn("_back", -F.col("line_no")), ["script_id"], ["_back"],
        {
            n: Running("min", F.when(F.col("_kind") == k, F.col("line_no")), before=True)
            for n, k in (("_submit", SUBMIT), ("_end", NOTE))
        }, hot=hot,
    )
    submits = F.coalesce(F.col("_submit") < F.col("_end"), F.col("_submit").isNotNull())
    marked = ahead.filter(note).withColumn("_submits", submits)
    part = F.split(F.regexp_replace(F.ltrim("text"), "^#@", ""), ",")

    def field(i: int) -> Column:
        return F.coalesce(F.get(part, F.lit(i)), F.lit(""))

    steps = marked.select(
        "script_id", "line_no", "depth", "loop_path",
        field(0).alias("step"), field(1).alias("deps"),
        F.regexp_replace(F.substring_index(field(2), ":", 1), "\\.NoCheckpoint$", "").alias("name"),
        F.substring_index(field(3), ":", 1).alias("ref"), field(4).alias("inputs"),
        field(5).alias("options"), "_submits",
    )
    repeated = grouped_scan(
        steps.withColumn("_id", F.col("step")), ["script_id", "_id"], ["line_no"],
        {"_before": Running("count", before=True)}, hot_rows, hot.within(),
    )
    options = F.col("options")
    rule = (
        F.when((F.col("step") == "") | (F.col("deps") == "") | (F.col("name") == ""), "missing_field")
        .when(F.concat("name", "ref", "inputs").contains("sbatch"), "options_in_wrong_field")
        .when((options != "") & ~options.startswith("sbatch"), "bad_options")
        .when(options.contains(" --array=") | options.contains(" -a "), "job_array")
        .when(F.col("_before") > 0, "duplicate_step")
        .when(F.col("_submits"), "ssbatch_command")
    )
    return repeated.withColumn("violation", rule).drop("_id", "_before", "_submits")


def _shared_prefix(a: str, b: str) -> Column:
    """Length of the common head of two arrays."""
    return F.expr(
        f"size(filter(sequence(0, least(size({a}), size({b}))),"
        f" i -> i > 0 and slice({a}, 1, i) = slice({b}, 1, i)))"
    )


def _plain_values(n: Column) -> Column:
    """The first n loop values as text: commas and backslashes inside a value are escaped and null is written out, so different lists stay different."""
    plain = F.transform(
        F.slice("values", F.lit(1), n).cast("array<string>"),
        lambda v: F.coalesce(F.regexp_replace(v, r"([\\,])", r"\\$1"), F.lit("\\N")),
    )
    return F.array_join(plain, ",")


# a row of a script while its groups are made
JOB, OFFER, ASK = range(3)


def _groups_in_place(rows: DataFrame, tasks: int, kept: bool) -> tuple[DataFrame, DataFrame]:
    """Links and members of scripts that fit into a task each: a script's rows are shuffled once, the rest is windows over finer keys.

    rows: script_id, step, deps, loop_path, job_id, values, _is_job.
    """
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    kind = {c: rows.schema[c].dataType for c in ("step", "loop_path", "job_id", "values")}
    null = {c: F.lit(None).cast(t) for c, t in kind.items()}
    deps = F.array_distinct(F.filter(F.split("deps", "\\."), lambda d: (d != "") & (d != "0")))
    own = Window.partitionBy("script_id", "step").orderBy("_is_job")
    once = (
        rows.filter("script_id is not null").repartition(tasks, "script_id")
        .withColumns({
            "_nth": F.row_number().over(own),
            "_step": F.min(F.when(~F.col("_is_job"), F.struct(F.coalesce(deps, F.array().cast("array<string>")).alias("deps"), "loop_path"))).over(own.rowsBetween(*whole)),
        })
        # a job of no step is in no group
        .filter(F.when(F.col("_is_job"), F.col("step").isNotNull() & F.col("_step").isNotNull()).otherwise(F.col("_nth") == 1))
    )

    def row(kind: int, dep_step: Column, step: Column, path: Column, job: Column, values: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("_kind"), dep_step.alias("dep_step"), step.alias("step"), path.alias("_path"), job.alias("job_id"), values.alias("values")
        )

    step, path = F.col("step"), F.col("_step.loop_path")
    offer = F.array(row(OFFER, step, null["step"], path, null["job_id"], null["values"]))
    asks = F.transform("_step.deps", lambda d: row(ASK, d, step, path, null["job_id"], null["values"]))
    job = F.array(row(JOB, step, step, null["loop_path"], F.col("job_id"), F.col("values")))
    each = once.select("script_id", F.explode(F.when(F.col("_is_job"), job).otherwise(F.concat(offer, asks))).alias("_row")).select("script_id", "_row.*")
    # what a step is asked for, on the step's own jobs
    asked = Window.partitionBy("script_id", "dep_step")
    met = each.filter("dep_step is not null").withColumn("_offer", F.max(F.when(F.col("_kind") == OFFER, F.struct("_path"))).over(asked))
    met = met.filter("_offer is not null").withColumn("_other", F.col("_offer._path")).withColumn(
        "_shared", F.when(F.col("_kind") == ASK, F.struct(_shared_prefix("_path", "_other").alias("n")))
    )
    met = met.withColumn("_gives", F.collect_set("_shared").over(asked)).filter(F.col("_kind") != OFFER)
    # what a step asks for, on the step's own jobs
    wants = F.collect_list(F.when(F.col("_kind") == ASK, F.struct("dep_step", F.col("_shared.n").alias("n"))))
    met = met.withColumn("_asks", wants.over(Window.partitionBy("script_id", "step"))).filter(F.col("_kind") == JOB)
    parts = F.concat(
        F.transform("_asks", lambda x: F.struct(F.lit(True).alias("_ask"), x["dep_step"].alias("dep_step"), x["n"].alias("_n"))),
        F.transform("_gives", lambda x: F.struct(F.lit(False).alias("_ask"), step.alias("dep_step"), x["n"].alias("_n"))),
    )
    sides = met.select("script_id", "step", "job_id", "values", F.explode(parts).alias("_part")).select(
        "script_id", "step", "job_id", "_part._ask", "_part.dep_step", _plain_values(F.col("_part._n")).alias("loop_values")
    )

    def members_of(sides: DataFrame) -> DataFrame:
        return sides.filter("not _ask").select("script_id", "dep_step", "loop_values", F.col("job_id").alias("dep_job"))

    group, member = Window.partitionBy(*GROUP), F.when(~F.col("_ask"), F.col("job_id"))
    sized = sides.withColumns({
        "n_deps": F.count_if(~F.col("_ask")).over(group), "first_dep": F.min(member).over(group), "last_dep": F.max(member).over(group),
    })
    if kept:
        sides = sized = as_written(sized, "groups")
    links = sized.filter("_ask and n_deps > 0 and loop_values is not null").select(
        *GROUP, "step", "job_id", "n_deps", "first_dep", "last_dep"
    )
    return links, members_of(sides)


def dependency_groups(
    steps: DataFrame, jobs: DataFrame, hot_rows: int = HOT_ROWS, kept: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Step dependencies expanded to jobs, as (links, members).

    steps: script_id, step, deps (``1.2``), loop_path. jobs: script_id,
    job_id, step, values (loop values, one per loop of the path).

    A job depends on the jobs of the other step that share its values on the
    loops both steps lie in: the same iteration inside one loop, all jobs of
    the iteration for an inner loop, all jobs when no loop is shared. A link
    names the group (script_id, dep_step, shared values) and its size; members
    lists the jobs of each group. A gather step over n jobs so costs n + 1
    rows, not one row per pair of jobs. With ``kept`` both are written, for those
    who read them several times.
    """
    types = {**dict(steps.dtypes), **dict(jobs.dtypes)}
    columns = ["script_id", "step", "deps", "loop_path", "job_id", "values"]

    def filled(df: DataFrame, is_job: bool) -> DataFrame:
        return df.select(*[c if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns], F.lit(is_job).alias("_is_job"))

    both = filled(steps.select("script_id", "step", "deps", "loop_path"), False).unionByName(
        filled(jobs.select("script_id", "step", "job_id", "values"), True)
    )
    counts = both.groupBy("script_id").agg(F.count(F.lit(1)).alias("_n"))
    total, longest = counts.filter("script_id is not null").agg(F.sum("_n"), F.max("_n")).first()
    if (longest or 0) <= hot_rows:
        tasks = max((total or 0) // TASK_LINES + 1, steps.sparkSession.sparkContext.defaultParallelism)
        return _groups_in_place(both, tasks, kept)

    once = steps.select("script_id", "step", "deps", "loop_path").dropDuplicates(["script_id", "step"])
    deps = F.array_distinct(F.filter(F.split("deps", "\\."), lambda d: (d != "") & (d != "0")))
    wanted = once.select("script_id", "step", F.col("loop_path").alias("_p"), F.explode(deps).alias("dep_step"))
    other = once.select("script_id", F.col("step").alias("dep_step"), F.col("loop_path").alias("_q"))
    # needed by both sides below; few bytes in a file may be many rows, which no driver should broadcast
    shared = as_written(
        wanted.join(other.hint("merge"), ["script_id", "dep_step"]).select(
            "script_id", "step", "dep_step", _shared_prefix("_p", "_q").alias("shared")
        ),
        "step-pairs",
    )
    values = _plain_values(F.col("shared"))
    asks = skew_join(
        jobs.select("script_id", "step", "job_id", "values"), shared, ["script_id", "step"], "inner", ["job_id"], hot_rows
    ).select("script_id", "step", "job_id", "dep_step", values.alias("loop_values"))
    gives = skew_join(
        jobs.select("script_id", F.col("step").alias("dep_step"), F.col("job_id").alias("dep_job"), "values"),
        shared.select("script_id", "dep_step", "shared").distinct(),
        ["script_id", "dep_step"], "inner", ["dep_job"], hot_rows,
    ).select("script_id", "dep_step", values.alias("loop_values"), "dep_job")
    sizes = gives.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_deps"), F.min("dep_job").alias("first_dep"), F.max("dep_job").alias("last_dep")
    )
    links = skew_join(asks, sizes, GROUP, "inner", ["job_id"], hot_rows)
    return (as_written(links, "links"), as_written(gives, "members")) if kept else (links, gives)
