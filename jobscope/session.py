"""Session helpers: where to cut lineage, where to put written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without the setting gets a folder of its own; elsewhere that would be a
    machine-local path which other executors cannot read, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="jobscope-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never reused."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, not on executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def as_written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read back, so that later joins are planned by the real size.

    A table below the session's broadcast threshold is broadcast, a larger one
    is shuffled; an aggregate is otherwise costed by the size of its input.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bucketed(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """Write by buckets of the keys and read back: a join or grouping on them shuffles only what it is joined with.

    Spark writes buckets to tables only. The table's name is given back at once; its files stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"jobscope_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    made = spark.table(table)
    spark.sql(f"drop table {table}")
    return made


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a written table, from the listing alone."""
    files = df.inputFiles()
    if not files:
        return 0
    folder = files[0].rsplit("/", 1)[0]
    return df.sparkSession.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0] or 0


def broadcast_bytes(spark: SparkSession) -> int:
    """The size up to which the planner broadcasts a table; -1 for never."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")
