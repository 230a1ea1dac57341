"""Names that cannot clash, given tables, counters of fixed size."""

import zlib
from collections.abc import Iterator
from contextlib import contextmanager


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Plain lower() does it for ASCII text, which is the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def remainder(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(c.cast("string").cast("binary")) % n


def fresh(name: str, taken: list[str]) -> str:
    """The name, or one made from it that no column has (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def types_of(schema) -> pa.Schema:
    """Arrow types that Spark expects back for a schema."""
    return to_arrow_schema(schema, timestamp_utc=True)


COUNTER_BLOCK = 1 << 16


def counter_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's counters (uint32) as compressed blocks."""
    parts = [zlib.compress(total[k : k + COUNTER_BLOCK].tobytes(), 1) for k in range(0, len(total), COUNTER_BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])


def sum_counters(rows: DataFrame, length: int) -> np.ndarray:
    """The sum over all tasks' counters; length, and so what the driver gets, is fixed."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.uint64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                total = total + part if len(total) else part.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "counts"])

    total = np.zeros(length, np.uint64)
    for r in rows.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.counts), np.uint64)
        total[r.block * COUNTER_BLOCK : r.block * COUNTER_BLOCK + len(part)] = part
    return total


SUM_BLOCK = 1 << 15  # sums of a row


def sum_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums (float64) in blocks."""
    flat = np.ascontiguousarray(total, float).ravel()
    parts = [flat[k : k + SUM_BLOCK].tobytes() for k in range(0, len(flat), SUM_BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "sums"])


def summed(rows: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """part(batches), an array of a fixed shape from every task, added up in Spark; that is all the driver gets."""

    def run(batches):
        yield sum_rows(part(batches))

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                here = np.frombuffer(raw)
                total = here.copy() if total is None else total + here
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect():
        here = np.frombuffer(bytes(r.sums))
        out[r.block * SUM_BLOCK : r.block * SUM_BLOCK + len(here)] = here
    return out.reshape(shape)


BLOCK_KEYS = 1 << 18
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows of a batch that goes to Python, for what is run inside: fewer, where rows are long."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def key_bits(n_keys: int) -> int:
    """Leading bits that cut so many keys into blocks of about BLOCK_KEYS; 64 blocks at least."""
    return max(6, int(np.ceil(np.log2(max(1, n_keys / BLOCK_KEYS)))))


def totals_back(rows: DataFrame, bits: int) -> DataFrame:
    """(chunk, block, totals) for rows (chunk, keys, counts): what each key of a chunk counts over all chunks.

    keys are a chunk's distinct sorted uint64, counts its uint32; both as bytes. Keys go to the
    task of their block by their leading bits and the totals come back in the
    chunk's order, so a frequent key is one entry per chunk and never a group of
    rows. Block -1 of chunk -1 - b has the number of keys and the sum of counts of block b.
    """

    def deal(batches):
        for batch in batches:
            for chunk, raw, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "counts")), strict=True):
                keys, counts = np.frombuffer(raw, np.uint64), np.frombuffer(n, np.uint32)
                if not len(keys):
                    continue
                blocks, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                ends = np.append(first[1:], len(keys))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks.astype(np.int32)), pa.array(np.full(len(blocks), chunk)),
                        pa.array([keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                        pa.array([zlib.compress(counts[a:b].tobytes(), 1) for a, b in zip(first, ends, strict=True)], pa.binary()),
                    ],
                    ["block", "chunk", "keys", "counts"],
                )

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in table.column("counts").to_pylist()])
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=counts)
        back = np.minimum(total, 2**32 - 1).astype(np.uint32)[where]
        ends = np.cumsum([0, *map(len, keys)])
        parts = [zlib.compress(back[a:b].tobytes(), 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        sums = np.array([int((total > 0).sum()), int(total.sum())], np.uint64).tobytes()
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1 - block], pa.int64()),
            "block": pa.array([*[block] * len(parts), -1], pa.int32()),
            "totals": pa.array([*parts, sums], pa.binary()),
        })

    return (
        rows.mapInArrow(deal, "block int, chunk bigint, keys binary, counts binary")
        .groupBy("block").applyInArrow(add, "chunk bigint, block int, totals binary")
    )


def in_order(blocks: pa.Table) -> np.ndarray:
    """A chunk's totals in the order of its keys."""
    rows = sorted(zip(blocks.column("block").to_pylist(), blocks.column("totals").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(zlib.decompress(x), np.uint32) for _, x in rows]])
