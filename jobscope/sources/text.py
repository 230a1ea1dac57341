"""Lines with their place in the file, read in parallel splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobscope.scale import HOT_ROWS, hot_from_counts, skew_join
from jobscope.session import as_written


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as they lie, with the last ``_marked`` up to each in its split; ids rise within a task."""
    split, begin, last = None, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        at, ids = batch.column("_at").to_numpy(), batch.column("_id").to_numpy()
        file = batch.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        starts = np.append(0, 1 + np.flatnonzero((at[1:] != at[:-1]) | (code[1:] != code[:-1])))
        begins = ids[starts]
        if split == (file[0].as_py(), at[0]):
            begins[0] = begin
        marked = batch.column("_marked").fill_null(-1).to_numpy().copy()
        marked[0] = max(marked[0], last)
        marked = np.maximum.accumulate(marked)
        known = marked >= np.repeat(begins, np.diff(np.append(starts, len(ids))))
        split, begin, last = (file[-1].as_py(), at[-1]), begins[-1], marked[-1]
        yield batch.set_column(batch.schema.get_field_index("_marked"), "_marked", pa.array(marked, mask=~known))


def numbered_lines(spark: SparkSession, path: str, hot_rows: int = HOT_ROWS, mark: Column | None = None) -> DataFrame:
    """(file, line_no from 1, line) of text files, also of files of many splits.

    With ``mark``, a condition on ``line``, also ``last_line``: the number of the last line of the
    file, this one included, that it holds for. It is carried down where the lines lie, and
    from split to split by the row of each, so no lines are sorted or gathered for it.

    The row number inside a split comes from the scan itself; the number of
    lines in the earlier splits of a file is added by a join on the split. One
    row per split is all that is counted ahead. Both scans must cut the files
    alike; if they ever do not, the query fails instead of numbering wrongly.
    """

    def scan() -> DataFrame:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_at"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("line"),
        )
        return lines if mark is None else lines.withColumn("_marked", F.when(mark, F.col("_id")))

    found = [] if mark is None else [F.max("_marked").alias("_last")]
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = as_written(
        scan()
        .groupBy("file", "_at")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), *found)
        .withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumns({} if mark is None else {
            "_carry": F.last(F.col("_skip") + F.col("_last") - F.col("_first") + 1, ignorenulls=True).over(earlier)
        }),
        "splits",
    )
    # a packed file cannot be split: its lines are spread over the join
    hot = hot_from_counts(splits.select("file", "_at", "_n"), hot_rows)
    inside = F.col("_id") - F.col("_first")
    wrong = inside.isNull() | (inside < 0) | (inside >= F.col("_n"))
    number = F.when(wrong, F.raise_error(F.lit("input splits changed between scans")).cast("bigint")).otherwise(
        F.col("_skip") + inside + 1
    )
    rows, last = scan(), []
    if mark is not None:
        rows = rows.mapInArrow(_carried, rows.schema)
        last = [F.coalesce(F.col("_skip") + F.col("_marked") - F.col("_first") + 1, F.col("_carry")).alias("last_line")]
    return skew_join(rows, splits, ["file", "_at"], "left", spread=["_id"], hot=hot).select(
        "file", number.alias("line_no"), "line", *last
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) without numbers: one scan, no shuffle."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
