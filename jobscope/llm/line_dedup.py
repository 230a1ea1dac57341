"""Lines found in many documents, counted in levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z in lower
case; runs hold its 128-bit hash and the number of documents that have it.

``LineRuns`` takes batches. A batch's hashes are merge-anti-joined against the
run of settled hashes (those already found in enough documents need no more
counting); the rest, counted and sorted, becomes a run of level 0. When a level
has ``fan_in`` runs they are merged into one run of the next level, and hashes
that reach the bound move to the settled run. All runs are Parquet in the shared
folder, so a lost executor costs a task and a later session can go on from them.

Everything is DataFrame code. Hashes travel, texts do not, but for the last
step, where each text meets the keys it loses.

Defined results: a null text is one empty line; keys of fewer than ``min_chars``
code points are never dropped; a row is a document, so repeated rows count as
often as they occur, and a line repeated inside one text counts once; without
rows there is no run and the result is empty. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import ascii_lower, fresh
from jobscope.session import as_written, scratch_path

BLANK = " \t\n\x0b\x0c\r"
BATCHES = 4
RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType())])


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def line_key(line: Column) -> Column:
    blank = [F.lit(c) for c in BLANK]
    ends = F.substring(line, 1, 1).isin(blank) | F.substring(line, -1, 1).isin(blank)
    return ascii_lower(F.when(ends, F.btrim(line, F.lit(BLANK))).otherwise(line))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of (h1, h2, n) and the settled run of (h1, h2)."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.levels: list[list[DataFrame]] = []
        self.settled_runs: list[DataFrame] = []

    def settled(self) -> DataFrame:
        """Hashes known to be in at least min_docs documents, each once."""
        runs = self.settled_runs
        if not runs:
            return self.spark.createDataFrame([], RUN)
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def _write(self, run: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(RUN).parquet(path)

    def add(self, batch: DataFrame) -> None:
        """Count a batch of (h1, h2), one row per document and distinct key."""
        counted = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self.settled_runs:
            counted = counted.join(self.settled().hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(counted, "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Compact runs: what reaches the bound is settled, the rest is one sorted run."""
        union = runs[0]
        for r in runs[1:]:
            union = union.unionByName(r)
        whole = self._write(union.groupBy("h1", "h2").agg(F.sum("n").alias("n")), "line-run")
        self.settled_runs.append(whole.filter(F.col("n") >= self.min_docs))
        return whole.filter(F.col("n") < self.min_docs)

    def finish(self) -> DataFrame:
        """Compact all levels and return the settled hashes."""
        rest = [r for level in self.levels for r in level]
        if rest:
            self._merge(rest)
            self.levels = []
        return self.settled().select("h1", "h2")


def drop_common_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = BATCHES,
    keep: list[str] | None = None,
    out: str = "lines",
) -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with a struct column ``out``.

    text: the lines that stay, joined by a line feed; n_lines before dropping; n_dropped.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    body = F.col(f"`{text}`")
    # a text is known by its hash: equal texts lose the same lines
    known = F.struct(F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("text"), body).alias("t2"))
    keyed = docs.select(known.alias("_t"), F.explode(F.array_distinct(F.transform(split_lines(body), line_key))).alias("_key"))
    path = scratch_path(spark, "lines")
    (
        keyed.filter(F.char_length("_key") >= min_chars)
        .select("_t.t1", "_t.t2", _hash(F.col("_key")).alias("_h"))
        .select("t1", "t2", "_h.h1", "_h.h2", F.pmod("t2", F.lit(batches)).cast("int").alias("batch"))
        .write.partitionBy("batch").parquet(path)
    )
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("t1", "t2", "h1", "h2")]).add("batch", T.IntegerType())
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("h1", "h2"))
    settled = as_written(runs.finish(), "common-lines")
    # which keys a text loses: a key that a third of all texts have spreads over the tasks of a skewed join
    lost = as_written(
        lines.join(settled, ["h1", "h2"])
        .groupBy("t1", "t2")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_lost")),
        "lost-lines",
    )
    # the text travels once, also where it is kept
    carried = {c: f"_k{i}" for i, c in enumerate(keep) if c != text}
    frame = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in carried.items()], body.alias("_text"), known["t1"].alias("t1"), known["t2"].alias("t2")
    ).join(lost, ["t1", "t2"], "left")
    whole = F.coalesce(F.col("_text"), F.lit(""))
    kept = F.filter(split_lines(F.col("_text")), lambda line: ~F.array_contains(F.col("_lost"), _hash(line_key(line))))
    frame = frame.select(
        *carried.values(), "_lost", F.col("_text").alias("_came"), whole.alias("_text"), F.when(F.col("_lost").isNotNull(), kept).alias("_kept")
    )
    n_lines = F.size(F.split("_text", "\n", -1)).cast("bigint")
    made = F.struct(
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(n_lines - F.size("_kept")).cast("bigint").alias("n_dropped"),
    )
    return frame.select(*[F.col(carried.get(c, "_came")).alias(c) for c in keep], made.alias(out))


def clean(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with the lines that stay as their text; columns as they came.

    A text column ``n_chars`` is left as it was: it says what was read.
    """
    out = fresh("_lines", docs.columns)
    made = drop_common_lines(docs, text=text, out=out, **options)
    return made.withColumn(text, F.when(F.col(f"`{text}`").isNull() & (F.col(out)["text"] == ""), F.col(f"`{text}`")).otherwise(F.col(out)["text"])).drop(out)
