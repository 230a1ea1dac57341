"""Readers. Schemas are given, values are cast with try_cast."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope import schemas
from jobscope.functions.units import elapsed_hours, tres_mem_gb
from jobscope.scale import HOT_ROWS
from jobscope.sources.fastq import read_fastq  # noqa: F401
from jobscope.sources.text import numbered_lines, read_lines


def _typed_ledger(df: DataFrame) -> DataFrame:
    def col(f: str) -> Column:
        if f in schemas.LEDGER_LONGS:
            return F.col(f).try_cast("bigint").alias(f)
        if f in schemas.LEDGER_DOUBLES:
            return F.col(f).try_cast("double").alias(f)
        if f == "input_size":
            return F.col(f).try_cast("bigint").alias(f)
        return F.col(f)

    return df.select(
        *[col(f) for f in schemas.LEDGER_FIELDS],
        F.col("input_size").try_cast("bigint").isNull().alias("missing_input"),
        F.timestamp_seconds(F.col("epoch").try_cast("bigint")).alias("finish_ts"),
    )


HEADER_ID = r"(?i)^\s*\d*job_?id\s*$"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Job ledger: headerless comma text; a header row is dropped wherever it is.

    Every other row stays: an array task (``123_4``) has the number of its job,
    an id without a number in front is null.
    """
    raw = spark.read.schema(schemas.LEDGER_TEXT).csv(path, mode="PERMISSIVE")
    rows = raw.filter(F.col("job_id").isNull() | ~F.col("job_id").rlike(HEADER_ID))
    return _typed_ledger(rows.withColumn("job_id", F.regexp_extract("job_id", r"^\s*(\d+)", 1)))


def read_plot_records(spark: SparkSession, logs: str) -> DataFrame:
    """Ledger rows echoed into job logs as ``dataToPlot,<record>``."""
    lines = read_lines(spark, logs).filter(F.col("line").startswith("dataToPlot,"))
    part = F.split(F.col("line"), ",")
    return _typed_ledger(
        lines.select(*[F.get(part, F.lit(i + 1)).alias(f) for i, f in enumerate(schemas.LEDGER_FIELDS)])
    )


def read_accounting(spark: SparkSession, path: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Accounting export as (jobs, steps).

    A job row names its user and has no MaxRSS; the rows below it without a
    user are its steps. The export has no job id: the whole path and the line of
    the job row stand for it and are carried down to the steps.
    """
    part = F.split("line", "\\|")
    field = {f: F.coalesce(F.get(part, F.lit(i)), F.lit("")) for i, f in enumerate(schemas.ACCOUNTING_FIELDS)}
    lines = numbered_lines(spark, path, hot_rows, (field["user_name"] != "") & (field["max_rss"] == ""))
    owned = lines.select(
        "file", "line_no", F.col("last_line").alias("job_line"), F.concat_ws(":", "file", "last_line").alias("job_id"),
        *[c.alias(f) for f, c in field.items()],
    )
    is_job = F.col("job_line") == F.col("line_no")

    def gb(c: str) -> Column:
        return F.regexp_replace(c, "G$", "").try_cast("double")

    jobs = owned.filter(is_job).select(
        "job_id", "user_name",
        F.col("nodes").try_cast("bigint").alias("nodes"),
        F.coalesce(tres_mem_gb(F.col("tres")), F.lit(0.0)).alias("req_gb"),
        elapsed_hours(F.col("elapsed")).alias("hours"),
        F.col("ncpus").try_cast("bigint").alias("ncpus"),
        elapsed_hours(F.col("total_cpu")).alias("cpu_hours"),
        elapsed_hours(F.col("time_limit")).alias("limit_hours"),
    )
    steps = owned.filter((F.col("user_name") == "") & F.col("job_line").isNotNull()).select(
        "job_id", (F.col("line_no") - F.col("job_line")).alias("step_no"),
        F.coalesce(gb("max_rss"), F.lit(0.0)).alias("max_rss_gb"),
        elapsed_hours(F.col("elapsed")).alias("hours"),
    )
    return jobs, steps


def read_samples(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Usage samples ``minute used wasted saved cpu [epoch …]``; job id from the file name.

    The batch reader also gives ``seq``, the line in the file.
    """
    if stream:
        lines = spark.readStream.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
        )
    else:
        lines = numbered_lines(spark, path)
    part = F.split(F.trim("line"), "\\s+")

    def num(i: int) -> Column:
        return F.get(part, F.lit(i)).try_cast("bigint")

    return lines.filter(F.size(part) >= 5).select(
        # job_<id>.memCPU.txt, or a folder job=<id>
        F.regexp_extract("file", "/job[_=]([^./]+)[^/]*(/part-[^/]*)?$", 1).alias("job_id"),
        *([] if stream else [F.col("line_no").alias("seq")]),
        num(0).alias("minute"), num(1).alias("mem_mb"), num(2).alias("wasted_mb"),
        num(3).alias("saved_mb"), num(4).alias("cpu_pct"), num(5).alias("epoch"),
        F.col("line").rlike("^\\s*0 0 0 0 0(\\s|$)").alias("is_marker"),
    )


def read_timed_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples with date and time in front of each row."""
    part = F.split(F.trim("line"), "\\s+")

    def num(i: int) -> Column:
        return F.get(part, F.lit(i)).try_cast("double")

    return read_lines(spark, path).filter((F.size(part) >= 8) & F.col("line").rlike("^\\s*[0-9]")).select(
        F.regexp_extract(F.element_at(F.split("file", "/"), -1), "^([^.]+)", 1).alias("job_id"),
        F.concat_ws(" ", part[0], part[1]).try_cast("timestamp").alias("ts"),
        num(2).alias("reserved_mb"), num(3).alias("used_mb"), num(4).alias("wasted_mb"),
        num(5).alias("ram_pct"), num(6).alias("reserved_cpu"), num(7).alias("cpu_pct"),
    )


def read_job_graph(spark: SparkSession, path: str) -> DataFrame:
    """Job graph table; header and rows of fewer than three fields are skipped."""
    part = F.split(F.trim("line"), "\\s+")
    names = ["job_id", "depend_on", "flag", "program", "ref", "inputs", "comment"]
    return (
        read_lines(spark, path)
        .filter((F.size(part) >= 3) & (part[0] != "job_id"))
        .select("file", *[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(names)])
    )


def read_sheet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Sample sheet ``folders``, ``proseq`` (comma) or ``rnaseq`` (white space); blank rows dropped."""
    if kind == "rnaseq":
        part = F.split(F.trim("line"), "\\s+")
        fields = [f.split()[0] for f in schemas.RNASEQ_MANIFEST.split(", ")]
        return read_lines(spark, path).filter(F.trim("line") != "").select(
            *[F.get(part, F.lit(i)).alias(f) for i, f in enumerate(fields)]
        )
    schema = {"folders": schemas.SAMPLE_SHEET, "proseq": schemas.PROSEQ_SHEET}[kind]
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=True)
    return df.filter(F.trim(F.concat_ws("", *df.columns)) != "")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments from SAM text. Positions are zero-based; last_pos from the CIGAR.

    A line of too few fields is an error, never left out; blank lines are nothing.
    """
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    part = F.split("line", "\t")
    short = F.raise_error(F.concat(F.lit("no alignment in "), F.col("file"), F.lit(": "), F.substring("line", 1, 200))).cast("boolean")
    rows = (
        read_lines(spark, path)
        .filter(~F.col("line").startswith("@") & (F.trim("line") != ""))
        .filter(F.when(F.size(part) >= len(names), True).otherwise(short))
        .select(*[part[i].alias(n) for i, n in enumerate(names)])
    )
    steps = F.expr("regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)")
    span = F.aggregate(F.transform(steps, lambda s: s.cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    pos = F.col("pos").try_cast("bigint") - 1
    return rows.select(
        "qname", F.col("flag").try_cast("int").alias("flag"), "rname", pos.alias("pos"),
        (pos + span - 1).alias("last_pos"), F.col("mapq").try_cast("int").alias("mapq"), "cigar", "rnext",
        (F.col("pnext").try_cast("bigint") - 1).alias("mate_pos"), F.col("tlen").try_cast("bigint").alias("tlen"),
        "seq", "qual",
    )


def read_bed(spark: SparkSession, path: str, kind: str = "bed6") -> DataFrame:
    """Intervals; a line that does not fit the columns is an error, never left out."""
    schema = {"bed6": schemas.BED6, "bedgraph": schemas.BEDGRAPH}[kind]
    return spark.read.schema(schema).csv(path, sep="\t", mode="FAILFAST", comment="#")


LOADED = 64 << 20  # bytes of a file that a task holds


def file_inventory(spark: SparkSession, root: str, md5: bool = False) -> DataFrame:
    """(path, dir, name, bytes, size_kib[, md5]) of every file below a folder, empty ones included.

    Names that begin with a dot or an underscore are hidden from it, as from all readers of Spark.
    Contents are not loaded for the listing. Checksums of files up to ``LOADED`` bytes are
    taken by Spark's own reader, with any store and credentials the session has; larger ones are read
    in pieces by the task, so a file may be of any size.
    """
    def listed(some: DataFrame) -> DataFrame:
        return some.select(
            "path",
            F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"),
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("bytes"),
            F.ceil(F.col("length") / 1024).alias("size_kib"),
            *([F.col("md5")] if md5 else []),
        )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Spark's sources leave out files of no bytes; their names are in the listing all the same
    names = spark.createDataFrame([(_plain(p),) for p in files.inputFiles()], "path string")
    empty = names.join(files.select("path"), ["path"], "left_anti").withColumn("length", F.lit(0).cast("bigint"))
    if not md5:
        return listed(files).unionByName(listed(empty))
    # the source takes the filter: contents of large files are not loaded
    loaded = files.filter(F.col("length") <= LOADED).withColumn("md5", F.md5("content"))
    large = files.filter(F.col("length") > LOADED).drop("content").withColumn("md5", _md5_of("path"))
    nothing = empty.withColumn("md5", F.md5(F.lit(b"")))
    return listed(loaded).unionByName(listed(large)).unionByName(listed(nothing))


def _plain(uri: str) -> str:
    """A listed name as the path column has it."""
    return re.sub("^file:/+", "file:/", unquote(uri))


@F.pandas_udf(T.StringType())
def _md5_of(paths: pd.Series) -> pd.Series:
    def one(uri: str) -> str:
        if uri.startswith("file:"):
            store, place = fs.LocalFileSystem(), unquote("/" + uri[5:].lstrip("/"))
        else:
            store, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        digest = hashlib.md5()
        with store.open_input_stream(place, compression=None) as f:
            while piece := f.read(4 * 1024 * 1024):
                digest.update(piece)
        return digest.hexdigest()

    return pd.Series([one(p) for p in paths])


def read_policy(spark: SparkSession, path: str, user_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Partition policy and defaults from configuration text, as (policy, defaults).

    A value of the user's own copy replaces the shared one; empty is null.
    """
    def assignments(p: str, rank: int) -> DataFrame:
        pattern = "^\\s*export\\s+(\\w+)=([^#\\s]*)"
        return spark.read.text(p).select(
            F.regexp_extract("value", pattern, 1).alias("var"),
            F.regexp_replace(F.regexp_extract("value", pattern, 2), "\"", "").alias("val"),
            # the last assignment of a file counts
            F.struct(F.lit(rank), F.monotonically_increasing_id()).alias("rank"),
        ).filter("var != ''")

    found = assignments(path, 0)
    if user_path:
        found = found.unionByName(assignments(user_path, 1))
    settings = found.groupBy("var").agg(F.max_by("val", "rank").alias("val")).withColumn(
        "val", F.when(F.col("val") != "", F.col("val"))
    )
    named = F.regexp_extract("var", "^partition([0-9]+)(Name|MemLimit|TimeLimit)$", 1)
    kind = F.regexp_extract("var", "^partition[0-9]+(Name|MemLimit|TimeLimit)$", 1)

    def value(k: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.col("val")))

    policy = (
        settings.select(named.try_cast("int").alias("ordinal"), kind.alias("kind"), "val")
        .filter(F.col("ordinal").isNotNull())
        .groupBy("ordinal")
        .agg(
            value("Name").alias("name"),
            value("MemLimit").try_cast("bigint").alias("mem_limit_mb"),
            value("TimeLimit").try_cast("bigint").alias("time_limit_min"),
        )
        .filter(F.col("name").isNotNull())
        .withColumn("kind", F.when(F.col("ordinal") <= 10, "general").otherwise("special"))
        .select("name", "ordinal", "kind", "mem_limit_mb", "time_limit_min")
    )
    wanted = {
        "defaultMem": "default_mem", "defaultTime": "default_min", "defaultExtraMem": "extra_mem",
        "defaultExtraTime": "extra_min", "firstBatchCount": "first_batch",
        "numberOfFailedJobsLastHourToRecalculateStats": "failure_burst",
    }
    defaults = settings.agg(
        *[F.max(F.when(F.col("var") == v, F.col("val"))).try_cast("bigint").alias(n) for v, n in wanted.items()]
    )
    return policy, defaults
