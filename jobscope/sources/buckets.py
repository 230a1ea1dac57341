"""Tables that micro-batches add to, stored by bucket of (program, ref) and by batch.

A batch writes folders of its own, so that a batch that is run again replaces its rows; a reader names the
buckets it needs, and no other folder is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


def bucket_of() -> Column:
    """Bucket of a key."""
    return F.pmod(F.xxhash64("program", "ref"), F.lit(BUCKETS)).cast("int")


def touched(*frames: DataFrame) -> list[int]:
    """Buckets of the keys of some frames; BUCKETS at most."""
    found: set[int] = set()
    for df in frames:
        found |= {r[0] for r in df.select(bucket_of()).distinct().collect()}
    return sorted(found)


def create(empty: DataFrame, path: str) -> None:
    """A first folder, so that there always is one to read."""
    empty.limit(0).write.mode("overwrite").parquet(f"{path}/bucket=-1/batch=-1")


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch's rows; the folders that it has already are replaced."""
    placed = rows.withColumns({"bucket": bucket_of(), "batch": F.lit(batch_id).cast("bigint")})
    placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None, upto: int) -> DataFrame:
    """Rows of batches up to ``upto`` with their batch, of some buckets (None: of all)."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    folders = path if buckets is None else f"{path}/bucket={{{','.join(map(str, [-1, *buckets]))}}}"
    return spark.read.schema(full).option("basePath", path).parquet(folders).filter(F.col("batch") <= upto).drop("bucket")
