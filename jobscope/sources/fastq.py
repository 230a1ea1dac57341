"""FASTQ files in splits: reads are put together where they lie, only those across two splits travel.

A read is four lines: ``@`` id, sequence, ``+``, quality, the second and the fourth of one length. No other
place of a file looks like that (a sequence does not begin with ``+``), so each split finds its first read itself. Lines
before it and after the last one are pieces; the pieces between two splits' reads give the reads across the border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.scale import HOT_ROWS, Running, attach, grouped_scan
from jobscope.session import as_written

FRAMED = "file string, at bigint, idx bigint, kind string, id string, seq string, qual string, text string"
NAMES = ["file", "at", "idx", "kind", "id", "seq", "qual", "text"]


def _whole(lines: pa.Array, i: int) -> int:
    """Number of whole reads, one after the other, from line i on."""
    n = (len(lines) - i) // 4
    if not n:
        return 0
    take = lambda k: lines.take(pa.array(np.arange(i + k, i + 4 * n, 4)))
    size = lambda a: pc.binary_length(a).to_numpy(zero_copy_only=False)
    good = pc.starts_with(take(0), "@").to_numpy(zero_copy_only=False) & pc.starts_with(take(2), "+").to_numpy(zero_copy_only=False)
    good &= size(take(1)) == size(take(3))
    return n if good.all() else int(np.argmin(good))


class _Split:
    """The lines of one split, as they come."""

    def __init__(self, file: str, at: int):
        self.file, self.at, self.idx = file, at, 0
        self.head: list[str] | None = None if at == 0 else []  # None: the first read has been found, or must be the first line
        self.broken: list[str] = []
        self.rest = pa.array([], pa.string())

    def _row(self, kind: str, text: list[str]) -> pa.RecordBatch:
        null = pa.nulls(1, pa.string())
        lines = pa.array(["\n".join(text) if text else None], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file]), pa.array([self.at], pa.int64()), pa.array([self.idx], pa.int64()), pa.array([kind]), null, null, null, lines], NAMES
        )

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if self.broken:
            yield self._row("broken", self.broken)
            self.broken = []

    def add(self, lines: pa.Array, last: bool = False) -> Iterator[pa.RecordBatch]:
        lines = pa.concat_arrays([self.rest, lines])
        i = 0
        while len(lines) - i >= 4:
            n = _whole(lines, i)
            if n:
                yield from self._flush()
                if self.head:
                    yield self._row("head", self.head)
                self.head = None
                take = lambda k, i=i, n=n: lines.take(pa.array(np.arange(i + k, i + 4 * n, 4)))
                null = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([self.file] * n), pa.array(np.full(n, self.at)), pa.array(np.arange(self.idx, self.idx + n)), pa.array(["read"] * n),
                        pc.utf8_slice_codeunits(take(0), 1), take(1), take(3), null,
                    ],
                    NAMES,
                )
                self.idx += n
                i += 4 * n
                continue
            line = lines[i].as_py()
            if self.head is not None:
                self.head.append(line)
            elif line.strip() or self.broken:  # blank lines between reads are nothing
                self.broken.append(line)
            i += 1
        self.rest = lines.slice(i)
        if last:
            rest = self.rest.to_pylist()
            if self.head is not None:
                if self.head + rest:
                    yield self._row("head", self.head + rest)
                return
            yield from self._flush()
            yield self._row("tail", rest)  # also without lines: what follows begins here


def _frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Split | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, ats, lines = batch.column("file"), batch.column("at").to_numpy(), batch.column("line")
        lines = lines.cast(pa.string())
        # a new split begins where file or place differ from the row before
        other = np.flatnonzero(np.diff(ats) != 0) + 1
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.union1d(other, np.flatnonzero(np.diff(names) != 0) + 1)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            file, at = files[a].as_py(), int(ats[a])
            if now is None or (now.file, now.at) != (file, at):
                if now is not None:
                    yield from now.add(pa.array([], pa.string()), last=True)
                now = _Split(file, at)
            yield from now.add(lines.slice(a, b - a))
    if now is not None:
        yield from now.add(pa.array([], pa.string()), last=True)


def _frame_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads of the pieces around a border; what is no read is broken."""
    for batch in batches:
        for file, at, text in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "text")), strict=True):
            split = _Split(file, at)
            split.head = None
            for made in split.add(pa.array(text.split("\n")), last=True):
                kinds = made.column("kind").to_pylist()
                if kinds == ["tail"]:  # fewer than four lines at the end of a file
                    if not (made.column("text")[0].as_py() or "").strip():
                        continue
                    made = made.set_column(3, "kind", pa.array(["broken"]))
                yield made


def read_fastq(spark: SparkSession, path: str, broken: str = "error", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(file, ordinal from 0, id, seq, qual) of plain, gz or bz2 FASTQ files.

    Nothing is left out: lines that are no read are an error that names their file, or with
    ``broken="keep"`` rows of their own, with the lines in a column ``broken`` and nulls elsewhere. Blank
    lines between reads are nothing. The text is read once and not shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("bigint").alias("at"), F.col("value").alias("line")
    )
    framed = as_written(lines.mapInArrow(_frame, FRAMED), "reads")
    # a tail begins a chain, the heads up to the next tail belong to it
    pieces = framed.filter(F.col("kind").isin("head", "tail")).withColumn("part", (F.col("kind") == "tail").cast("int"))
    chained = grouped_scan(pieces, ["file"], ["at", "part"], {"chain": Running("sum", F.col("part"))}, hot_rows)
    chains = chained.groupBy("file", "chain").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    across = as_written(chains.select("file", "at", "text").mapInArrow(_frame_chains, FRAMED), "reads-across")
    # reads of a split, then those that begin in it and end in a later one
    counts = framed.filter("kind = 'read'").groupBy("file", "at").agg(F.count(F.lit(1)).alias("inside"))
    more = across.filter("kind = 'read'").groupBy("file", "at").agg(F.count(F.lit(1)).alias("across"))
    both = counts.join(more, ["file", "at"], "full").na.fill(0, ["inside", "across"])
    places = as_written(
        grouped_scan(both.withColumn("_n", F.col("inside") + F.col("across")), ["file"], ["at"], {"skip": Running("sum", F.col("_n"), before=True)}, hot_rows)
        .select("file", "at", "inside", F.coalesce("skip", F.lit(0)).alias("skip")),
        "splits",
    )

    def placed(rows: DataFrame, first) -> DataFrame:
        # a row per split: broadcast while small, else the longer side is spread by adaptive execution
        return attach(rows, places, ["file", "at"]).select("file", (F.col("skip") + first + F.col("idx")).alias("ordinal"), "kind", "id", "seq", "qual", "text")

    out = placed(framed.filter("kind in ('read', 'broken')"), F.lit(0)).unionByName(placed(across, F.col("inside")))
    if broken == "keep":
        bad = F.col("kind") == "broken"
        return out.select("file", F.when(~bad, F.col("ordinal")).alias("ordinal"), "id", "seq", "qual", F.when(bad, F.col("text")).alias("broken"))
    problem = F.raise_error(F.concat(F.lit("no FASTQ read in "), F.col("file"), F.lit(": "), F.substring("text", 1, 200))).cast("boolean")
    return out.filter(F.when(F.col("kind") == "read", True).otherwise(problem)).select("file", "ordinal", "id", "seq", "qual")
