"""Files, logs and sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.jobs import input_refs, job_size
from jobscope.scale import HOT_ROWS, Running, grouped_scan, skew_join
from jobscope.session import cut_lineage

# fixed values
ARCHIVE_LIMIT_KIB = 1048576
DIGEST_BYTES = 9000
DIGEST_LINES = 20
DIGEST_ERROR_LINES = 10
BLOCKING_CALLS = "read|write|select|poll|ppoll|epoll_wait|wait4|futex|nanosleep|clock_nanosleep"
ANALYSIS_TYPES = ["Start-seq", "PRO-seq"]


def input_size(jobs: DataFrame, inventory: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Total input size per job in KiB.

    jobs: job_id, inputs (list, ``none`` or ``,jobSize:N``); inventory: path and
    bytes, or size_kib where only that is known; the sum is rounded up, not each file. A job with a missing file gets no size and ``missing_input``. A
    file counts once per job, however often it is named or listed.
    """
    literal = job_size(F.col("inputs"))
    none = F.col("inputs").isNull() | (F.col("inputs") == "none")
    refs = F.when(~none, F.array_distinct(input_refs(F.col("inputs"))))
    wanted = jobs.select("job_id", literal.alias("_literal"), F.explode_outer(refs).alias("path"))
    length = F.col("bytes") if "bytes" in inventory.columns else F.col("size_kib") * 1024
    sized = skew_join(
        wanted, inventory.groupBy("path").agg(F.max(length).alias("_bytes")), ["path"], "left", spread=["job_id"], hot_rows=hot_rows
    )
    return sized.groupBy("job_id").agg(
        F.max("_literal").alias("_literal"),
        (F.sum("_bytes") / 1024).alias("_sum"),
        F.bool_or(F.col("path").isNotNull() & F.col("_bytes").isNull()).alias("missing_input"),
    ).select(
        "job_id",
        F.when(~F.col("missing_input"), F.coalesce(F.col("_literal"), F.ceil("_sum"), F.lit(0))).cast("bigint").alias("input_size"),
        "missing_input",
    )


def manifest_diff(source: DataFrame, restored: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed after a restore (dir, name, md5)."""
    a = source.select("dir", "name", F.col("md5").alias("_a"), F.lit(True).alias("_in_a"))
    b = restored.select("dir", "name", F.col("md5").alias("_b"), F.lit(True).alias("_in_b"))
    change = (
        F.when(F.col("_in_b").isNull(), "missing")
        .when(F.col("_in_a").isNull(), "extra")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return a.join(b, ["dir", "name"], "full").withColumn("change", change).filter("change is not null").select("dir", "name", "change")


# ---- archive batches ----


def _number_in_front(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, "^\\s*(-?[0-9]+(\\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def _batch_starts(at: DataFrame, limit: int, hot_rows: int) -> DataFrame:
    """(_dir, _pos) of the files that begin a batch; at: _dir, size_kib, _pos and running total _upto.

    Where a batch that starts at a file ends follows from running totals
    alone, so each file points to the start of the next batch. The starts that
    are really used are found from the first file by pointer doubling: after k
    rounds the first 2^k of a folder are known, and how many there can be
    follows from its total.
    """
    # as-of lookup: position of the first running total beyond the start's own limit
    none = F.lit(None).cast("bigint")
    need = at.select("_dir", (F.col("_upto") - F.col("size_kib") + limit).alias("_key"), F.col("_pos").alias("_from"), none.alias("_end"))
    ends = at.select("_dir", F.col("_upto").alias("_key"), none.alias("_from"), F.col("_pos").alias("_end"))
    both = need.unionByName(ends).withColumns({"_neg": -F.col("_key"), "_id": F.coalesce("_from", "_end")})
    # descending totals, ends before questions of a smaller key; equal totals must not count
    looked = grouped_scan(
        both.withColumn("_tie", F.when(F.col("_from").isNull(), 1).otherwise(0)),
        ["_dir"], ["_neg", "_tie", "_id"],
        {"_close": Running("min", F.col("_end"), before=True)}, hot_rows,
    )
    chain = cut_lineage(
        looked.filter("_from is not null").select(
            "_dir", F.col("_from").alias("_pos"), (F.col("_close") + 1).alias("_next"), (F.col("_from") == 1).alias("_start")
        )
    )
    closed = F.least(F.max("_pos"), F.expr(f"max(_upto) div {max(1, limit + 1)}"))
    most = at.groupBy("_dir").agg(closed.alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        found = chain.filter("_start and _next is not null").select("_dir", F.col("_next").alias("_pos"), F.lit(True).alias("_found"))
        hop = chain.select("_dir", F.col("_pos").alias("_next"), F.col("_next").alias("_then"))
        chain = cut_lineage(
            chain.join(hop, ["_dir", "_next"], "left").join(found, ["_dir", "_pos"], "left").select(
                "_dir", "_pos", F.col("_then").alias("_next"), (F.col("_start") | F.coalesce("_found", F.lit(False))).alias("_start")
            )
        )
    return chain.filter("_start").select("_dir", "_pos")


def archive_batches(inventory: DataFrame, limit: int = ARCHIVE_LIMIT_KIB, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Batch number per file of a folder, in name order (dir, name, size_kib).

    A batch is closed by the file that takes it over the limit. Files larger
    than the limit, and those of unknown size, are copied alone: batch is null. Folders of
    any length go the same way, none is read by one task alone.
    """
    base = inventory.select("dir", "name", "size_kib")
    alone = base.filter((F.col("size_kib") > limit) | F.col("size_kib").isNull()).withColumn("batch", F.lit(None).cast("bigint"))
    small = base.filter(F.col("size_kib") <= limit).withColumns(
        {
            "_num": _number_in_front(F.col("name")), "size_kib": F.col("size_kib").cast("bigint"),
            "_dir": F.coalesce(F.concat(F.lit("/"), "dir"), F.lit("")),  # files without a folder are one, too
        }
    )
    at = cut_lineage(
        grouped_scan(
            small, ["_dir"], ["_num", "name", "size_kib"],
            {"_pos": Running("count"), "_upto": Running("sum", F.col("size_kib"))}, hot_rows,
        )
    )
    starts = _batch_starts(at, limit, hot_rows).withColumn("_start", F.lit(1).cast("bigint"))
    marked = at.join(starts, ["_dir", "_pos"], "left")
    numbered = grouped_scan(marked, ["_dir"], ["_pos"], {"_n": Running("sum", F.col("_start"))}, hot_rows)
    return alone.unionByName(numbered.select("dir", "name", "size_kib", (F.col("_n") - 1).alias("batch")))


def archive_list(batches: DataFrame) -> DataFrame:
    """One row per archive, named after its first and last file."""
    first = F.struct(_number_in_front(F.col("name")), F.col("name"))
    return batches.filter("batch is not null").groupBy("dir", "batch").agg(
        F.concat(F.min_by("name", first), F.lit("-"), F.max_by("name", first)).alias("archive"),
        F.count(F.lit(1)).alias("files"),
        F.sum("size_kib").alias("size_kib"),
    )


# ---- logs: file, line_no (from 1), line ----


def log_digest(lines: DataFrame, error: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Lines to send: everything of a short log, both ends of a long one.

    ``part`` is all, head or tail; a line near both ends comes once for each.
    What may be sent is known before any join: the first lines, as a short log has
    no more than ``DIGEST_BYTES`` of them, and the last ones by a rank limit that Spark applies before
    the shuffle. The lines between them stay where they are.
    """
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("_last"), F.sum(F.octet_length("line") + 1).alias("_bytes"))
    tail = DIGEST_ERROR_LINES if error else DIGEST_LINES
    ends = lines.select("file", "line_no", "line")
    first = ends.filter(F.col("line_no") <= DIGEST_BYTES).withColumn("_end", F.lit(False))
    newest = Window.partitionBy("file").orderBy(F.desc("line_no"))
    last = ends.withColumn("_rank", F.dense_rank().over(newest)).filter(F.col("_rank") <= tail).drop("_rank").withColumn("_end", F.lit(True))
    big = F.col("_bytes") >= DIGEST_BYTES
    head = F.lit(False) if error else big & (F.col("line_no") <= DIGEST_LINES)
    part = F.when(F.col("_end"), F.when(big & (F.col("line_no") > F.col("_last") - tail), "tail")).otherwise(F.when(~big, "all").when(head, "head"))
    return (
        skew_join(first.unionByName(last), sizes, ["file"], spread=["line_no"], hot_rows=hot_rows)
        .withColumn("part", part).filter(F.col("part").isNotNull())
        .select("file", "line_no", "line", "part")
    )


def pattern_scan(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("line").rlike(pattern))


def log_metric(lines: DataFrame, pattern: str, name: str = "value") -> DataFrame:
    """Counter per file: first group of the pattern, commas removed."""
    text = F.regexp_replace(F.regexp_extract("line", pattern, 1), ",", "")
    return (
        lines.select("file", text.try_cast("bigint").alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy("file")
        .agg(F.max(name).alias(name))
    )


def log_tag(lines: DataFrame, tag: str) -> DataFrame:
    """Last ``tag=value`` per file."""
    value = F.regexp_extract("line", f"{tag}=(\\S+)", 1)
    return (
        lines.select("file", "line_no", value.alias("value"))
        .filter(F.col("value") != "")
        .groupBy("file")
        .agg(F.max_by("value", "line_no").alias("value"))
    )


def dominant_call(lines: DataFrame, n: int = 100) -> DataFrame:
    """Most frequent blocking call in the last n trace lines of each file.

    The rank filter is pushed before the shuffle, so at most n lines per file
    and task travel.
    """
    newest = Window.partitionBy("file").orderBy(F.desc("line_no"))
    tail = lines.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    bare = F.regexp_replace("line", "^[0-9]+\\s+[0-9]+\\s+", "")
    call = F.regexp_extract(bare, "^([a-zA-Z0-9_]+)", 1)
    return (
        tail.select("file", F.when(call != "", call).otherwise(bare).alias("call"))
        .filter(F.col("call").rlike(BLOCKING_CALLS))
        .groupBy("file", "call")
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("file")
        .agg(F.max_by("call", F.struct("lines", "call")).alias("call"), F.max("lines").alias("lines"))
    )


def read_descriptor(lines: DataFrame, n: int = 50) -> DataFrame:
    """File descriptor that the last n ``read(`` lines of each trace name most often: file, fd, lines.

    Of equally frequent ones it is the last as text. Lines without a number there
    count among the n, but name none. At most n lines per file and task travel.
    """
    newest = Window.partitionBy("file").orderBy(F.desc("line_no"))
    tail = (
        lines.filter(F.col("line").contains("read(")).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    )
    return (
        tail.select("file", F.regexp_extract("line", r".*read\((\d+)", 1).alias("fd"))
        .filter(F.col("fd") != "")
        .groupBy("file", "fd")
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("file")
        .agg(F.max_by("fd", F.struct("lines", "fd")).alias("fd"), F.max("lines").alias("lines"))
    )


def sbatch_directives(lines: DataFrame, cli: DataFrame | None = None) -> DataFrame:
    """Options per script from ``#SBATCH`` lines; the command line wins.

    lines: script_id, line_no, text; cli: script_id and any of the options.
    Of several lines with one option the first counts.
    """
    # fixed values: short and long option names
    names = {
        "account": ["-A"], "mem": ["--mem"], "mem_per_cpu": ["--mem-per-cpu"], "core": ["-c", "--cpus-per-task"],
        "task": ["-n", "--ntasks"], "node": ["-N", "--nodes"], "time": ["-t", "--time"], "name": ["-J", "--job-name"],
        "out": ["-o", "--output"], "err": ["-e", "--error"], "deps": ["-d", "--dependency"],
    }
    words = F.split(F.trim("text"), "\\s+")
    long_form = F.get(words, F.lit(1)).contains("=")
    opt = F.substring_index(F.get(words, F.lit(1)), "=", 1)
    value = F.when(long_form, F.expr("substring(_word, instr(_word, '=') + 1)")).otherwise(F.get(words, F.lit(2)))
    found = (
        lines.filter(F.get(words, F.lit(0)) == "#SBATCH")
        .withColumn("_word", F.get(words, F.lit(1)))
        .select("script_id", "line_no", opt.alias("_opt"), long_form.alias("_long"), value.alias("_value"))
    )

    def pick(forms: list[str]) -> Column:
        known = F.col("_opt").isin(forms)
        # a long form needs "=", except --mem and --mem-per-cpu; a short form has none
        spaced = [f for f in forms if not f.startswith("--")] + [f for f in forms if f.startswith("--mem")]
        joined = [f for f in forms if f.startswith("--")]
        ok = known & (F.col("_long") & F.col("_opt").isin(joined) | ~F.col("_long") & F.col("_opt").isin(spaced))
        return F.min_by(F.when(ok, F.col("_value")), F.when(ok, F.col("line_no")))

    wide = found.groupBy("script_id").agg(*[pick(forms).alias(n) for n, forms in names.items()])
    if cli is None:
        return wide
    given = [c for c in cli.columns if c in names]
    over = cli.select("script_id", *[F.col(c).alias(f"_cli_{c}") for c in given])
    both = wide.join(over, ["script_id"], "full")
    return both.select(
        "script_id", *[F.coalesce(f"_cli_{n}", n).alias(n) if n in given else F.col(n) for n in names]
    )


# ---- sample sheets ----


def run_metadata(manifest: DataFrame) -> DataFrame:
    """(bam, condition, label) of the manifest rows that name a sample."""
    named = manifest.filter(F.col("sample").isNotNull() & (F.col("sample") != ""))
    return named.select(
        F.concat(F.lit("mapping/"), "sample", F.lit(".dedup.Processed.out.bam")).alias("bam"),
        "condition",
        F.col("sample").alias("label"),
    )


def _broken(rules: list[tuple[Column, str, Column]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), d.alias("detail"))) for c, n, d in rules])
    )


def _missing(sheet: DataFrame, files: Column, inventory: DataFrame, rule: str) -> DataFrame:
    wanted = sheet.select("row_id", F.explode(files).alias("path")).filter(F.coalesce(F.col("path"), F.lit("")) != "")
    gone = skew_join(wanted, inventory.select("path").distinct(), ["path"], "left_anti", spread=["row_id"])
    return gone.select("row_id", F.lit(rule).alias("rule"), F.col("path").alias("detail"))


def validate_sheet(sheet: DataFrame, inventory: DataFrame, kind: str = "folders") -> DataFrame:
    """Rules broken by sheet rows as (row_id, rule, detail).

    kind ``folders``: group, sample, library, lane, path, read1, read2;
    ``proseq``: analysis_type, tss_list, file_r1, file_r2; ``rnaseq``: read1
    and read2 comma lists, sample.
    """
    empty = F.lit("")
    if kind == "folders":
        cols = ["grp", "sample", "library", "lane", "path", "read1"]
        spaces = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).contains(" "), F.lit(c)) for c in cols])), ",")
        rules = [(spaces != "", "space_in_value", spaces)]

        def full(c: str) -> Column:
            return F.when(F.coalesce(F.col(c), empty) != "", F.concat("path", F.lit("/"), c))

        missing = _missing(sheet, F.array(full("read1"), full("read2")), inventory, "missing_file")
        groups = sheet.agg(F.count_distinct("grp").alias("n")).filter("n < 2")
        extra = groups.select(
            F.lit(None).cast("bigint").alias("row_id"), F.lit("few_groups").alias("rule"), F.col("n").cast("string").alias("detail")
        )
        missing = missing.unionByName(extra)
    elif kind == "proseq":
        bad = ~F.coalesce(F.col("analysis_type"), empty).isin(ANALYSIS_TYPES)
        rules = [(bad, "analysis_type", F.coalesce(F.col("analysis_type"), empty))]
        missing = _missing(sheet, F.array("file_r1", "file_r2", "tss_list"), inventory, "missing_file")
    else:
        sheet = sheet.filter(F.coalesce(F.col("sample"), empty) != "")

        def parts(c: str) -> Column:
            return F.filter(F.split(F.coalesce(F.col(c), empty), ","), lambda x: x != "")

        n1, n2 = F.size(parts("read1")), F.size(parts("read2"))
        detail = F.concat(n1.cast("string"), F.lit("/"), n2.cast("string"))
        rules = [(n1 != n2, "unequal_reads", detail), ((n1 == n2) & (n1 == 0), "no_reads", detail)]
        missing = _missing(sheet, F.concat(parts("read1"), parts("read2")), inventory, "missing_file")
    broken = sheet.select("row_id", F.explode(_broken(rules)).alias("v")).select("row_id", "v.*")
    return broken.unionByName(missing)
