"""Language-model scores from a log-frequency Bloom filter.

1. Texts are packed once into chunks of about ``SLICE`` bytes: the chunk's
   distinct words (64-bit hashes) and each text as places in that list. All
   later steps read the packed table.
2. Word counts of the training texts come back to each chunk's distinct
   words, so counts, known words and the base score are exact.
3. Bigrams (with a start and an end) are counted by blocks of hash; each
   block's bigrams go into a Bloom filter, those seen once too: a count of
   level j is kept as the j entries (bigram, 1) ... (bigram, j), level j standing for counts from
   MIN_COUNT * STEP**(j - 1), as many levels as the training tokens ask for. The filter has ``BITS`` bits an entry.
4. The filter is broadcast in groups of blocks of at most ``FILTER_BYTES`` each, kept on the
   workers' disks. A task takes some chunks at a time (``TOGETHER``) through all groups, one
   group in memory after the other, so that texts are moved once however large the filter is. A
   bigram's count is found by probing for (bigram, 1), (bigram, 2) ... until one
   is missing. Then P(w | v) = (c(v w) + k * P0(w)) / (c(v) + k) with k = a * c(v)**b, where P0
   is the base model; (a, b) is the pair of ``SMOOTHING`` with the best
   leave-one-out score over the training texts.

Defined results: a null, empty or blank text is just the end token; a row
without an id is in training; repeated rows teach as often as they occur; without training texts
every probability of the base is 1; an empty table gives an empty one. Only the
id and the text are read, so other columns cannot clash.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm import textnum
from jobscope.llm.common import batches_of, in_order, key_bits, remainder, totals_back
from jobscope.session import as_written

SLICE = 1 << 20
TEXTS = 1000  # texts of a batch
CHUNKS = 8  # chunks of a batch
FLUSH = 1 << 20  # bigrams held by a task
BLOCK_TOKENS = 1 << 18
MIN_COUNT = 1  # of level 1: every bigram of the training texts is in the filter
STEP = 1.5
BITS = 12
PROBES = 6
FILTER_BYTES = 32 << 20
TOGETHER = 8  # chunks of a task that walk through the filter together
SMOOTHING = ((30.0, 0.0), (300.0, 0.0), (3000.0, 0.0), (1.0, 0.5), (3.0, 0.5), (10.0, 0.5), (30.0, 0.5), (100.0, 0.5), (0.3, 0.75), (1.0, 0.75), (3.0, 0.75), (10.0, 0.75))
START, END = np.uint64(0x53A7), np.uint64(0xE4D1)


def _lowest(most: int) -> np.ndarray:
    """Least count of level 1, 2, ... for counts of up to ``most``."""
    levels = 1 + max(0, int(np.ceil(np.log(max(1, most) / MIN_COUNT) / np.log(STEP))))
    return np.ceil(MIN_COUNT * STEP ** np.arange(levels))


def _pack(n_ids: str):
    def run(batches):
        number = 0
        for batch in batches:
            whole = textnum.Buffer(batch.column("text"))
            for i, j in whole.slices(SLICE):
                counts, hashes = textnum.words(whole.rows(i, j))
                vocabulary, places = np.unique(hashes, return_inverse=True)
                small = len(vocabulary) <= 1 << 16
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                        pa.array([batch.column("id").slice(i, j - i)], pa.list_(batch.schema.field("id").type)),
                        pa.array([batch.column("held").slice(i, j - i)], pa.list_(pa.bool_())),
                        pa.array([counts.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([vocabulary.tobytes()], pa.binary()),
                        pa.array([places.astype(np.uint16 if small else np.uint32).tobytes()], pa.binary()),
                    ],
                    ["chunk", "ids", "held", "counts", "words", "places"],
                )
                number += 1

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """held, counts, distinct words, places of a chunk."""
    words = np.frombuffer(row["words"], np.uint64)
    places = np.frombuffer(row["places"], np.uint16 if len(words) <= 1 << 16 else np.uint32).astype(np.int64)
    return np.array(row["held"], bool), np.array(row["counts"], np.int64), words, places


def _chunks(batches, columns):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in columns}


PARTS = ["held", "counts", "words", "places"]


def _with_ends(counts: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Previous and current token of every token, the end (n) included; n + 1 is the start."""
    ends = np.cumsum(counts)
    current = np.insert(places, ends, n)
    previous = np.roll(current, 1)
    previous[previous == n] = n + 1
    if len(previous):
        previous[0] = n + 1
    return previous, current


def _bigrams(words: np.ndarray, previous: np.ndarray, current: np.ndarray) -> np.ndarray:
    table = np.concatenate([words, [END, START]])
    with np.errstate(over="ignore"):
        return textnum.mix(table[previous] * np.uint64(0x9E3779B97F4A7C15) + textnum.mix(table[current]))


def _chunk_words(batches):
    """Distinct words of a chunk and how often its training texts have them."""
    for row in _chunks(batches, ["chunk", *PARTS]):
        held, counts, words, places = _unpack(row)
        seen = np.bincount(places[np.repeat(~held, counts)], minlength=len(words)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["chunk"]], pa.int64()), pa.array([row["words"]], pa.binary()), pa.array([seen.tobytes()], pa.binary())],
            ["chunk", "keys", "counts"],
        )


def _split_key(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and 32-bit key of bigrams."""
    return (grams >> np.uint64(64 - bits)).astype(np.int64), (grams >> np.uint64(32 - bits)).astype(np.uint32)


def _bigram_counts(bits: int):
    def flush(held):
        grams, counts = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
        blocks = (grams >> np.uint64(32)).astype(np.int64)
        keys, counts = grams.astype(np.uint32), np.minimum(counts, 2**32 - 1).astype(np.uint32)
        found, at = np.unique(blocks, return_index=True)
        ends = np.append(at[1:], len(blocks))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found.astype(np.int32)),
                pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                pa.array([zlib.compress(counts[a:b].tobytes(), 1) for a, b in zip(at, ends, strict=True)], pa.binary()),
            ],
            ["block", "keys", "counts"],
        )

    def run(batches):
        held, size = [], 0
        for row in _chunks(batches, PARTS):
            out, counts, words, places = _unpack(row)
            places, counts = places[np.repeat(~out, counts)], counts[~out]
            held.append(_bigrams(words, *_with_ends(counts, places, len(words))))
            size += len(held[-1])
            if size > FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _spots(block: np.ndarray, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = textnum.mix((block.astype(np.uint64) << np.uint64(32)) + key + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
    return h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def _filter(lowest: np.ndarray, key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block's Bloom filter: (bigram, 1) ... (bigram, level) for every bigram."""
    block = key[0].as_py()
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32) for x in table.column("counts").to_pylist()])
    keys, where = np.unique(keys, return_inverse=True)
    total = np.bincount(where, weights=counts)
    level = np.searchsorted(lowest, total, "right")
    size = max(64, int(level.sum()) * BITS)
    bits = np.zeros(-(-size // 8) * 8, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        mine = keys[level >= j]
        a, b = _spots(np.full(len(mine), block), mine, j)
        for i in range(PROBES):
            bits[((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)] = True
    return pa.table({"block": pa.array([block], pa.int32()), "size": pa.array([size], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


class _Filter:
    """Some blocks' filters, to be probed together; the bytes are those of the broadcast."""

    def __init__(self, found: tuple[list, bytes], n_blocks: int):
        self.bits = np.frombuffer(found[1], np.uint8)
        self.size, self.base = np.zeros(n_blocks, np.uint64), np.zeros(n_blocks, np.int64)
        at = 0
        for block, size, length in found[0]:
            self.size[block], self.base[block] = size, at * 8
            at += length

    def levels(self, block: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
        found = np.zeros(len(block), np.int64)
        left = np.flatnonzero(self.size[block] > 0)
        for j in range(1, most + 1):
            a, b = _spots(block[left], key[left], j)
            there = np.arange(len(left))
            for i in range(PROBES):
                blocks = block[left[there]]
                spot = ((a[there] + np.uint64(i) * b[there]) % self.size[blocks]).astype(np.int64) + self.base[blocks]
                there = there[(self.bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1]
            left = left[there]
            if not len(left):
                break
            found[left] = j
        return found


class _Chunk:
    """Tokens of a chunk's texts and the levels found so far."""

    def __init__(self, row: dict, known: np.ndarray, n_train: int, bits: int):
        self.held, self.counts, words, places = _unpack(row)
        self.count = np.append(known, [n_train, n_train]).astype(float)  # of words, the end, the start
        self.previous, self.current = (x.astype(np.int32) for x in _with_ends(self.counts, places, len(words)))
        block, self.key = _split_key(_bigrams(words, self.previous, self.current), bits)
        self.block = block.astype(np.int32)
        self.level = np.zeros(len(block), np.int8)

    def probe(self, part: _Filter, low: int, high: int, most: int) -> None:
        inside = np.flatnonzero((self.block >= low) & (self.block < high))
        self.level[inside] = part.levels(self.block[inside].astype(np.int64), self.key[inside], most)

    def scores(self, lowest: np.ndarray, total: int, distinct: int):
        """Per text: n_tokens, n_known, base, scores and leave-one-out scores by smoothing."""
        p0 = (self.count + 1) / (total + 1.0 * (distinct + 1))
        begin = np.concatenate([[0], np.cumsum(self.counts + 1)[:-1]])
        add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
        value = np.concatenate([[0.0], np.sqrt(lowest * np.maximum(lowest, lowest * STEP - 1))])  # what a level stands for
        before = self.count[self.previous]
        seen = np.minimum(value[self.level], np.minimum(before, self.count[self.current]))
        base = p0[self.current]
        train = np.repeat(~self.held, self.counts + 1)
        less, seen_less = np.maximum(before - 1, 0), np.maximum(seen - 1, 0)
        scores, left_out = [], []
        for a, b in SMOOTHING:
            # a word never seen before leaves the base model
            k, k_less = (a * np.maximum(c, 1.0) ** b for c in (before, less))
            scores.append(add(np.log10((seen + k * base) / (before + k))))
            left_out.append(add(np.where(train, np.log10((seen_less + k_less * base) / (less + k_less)), 0)))
        return (
            self.counts + 1, add((self.count[self.current] > 0).astype(np.int64)), add(np.log10(base)),
            np.array(scores).T, np.array(left_out).T,
        )


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    held_out: int = 2,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(doc_id) mod modulus is not held_out.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.coalesce(remainder(F.col(f"`{doc_id}`"), modulus) == held_out, F.lit(False)).alias("held"),
    )
    with batches_of(spark, TEXTS):
        packed = as_written(
            rows.mapInArrow(_pack(id_type), f"chunk bigint, ids array<{id_type}>, held array<boolean>, counts array<bigint>, words binary, places binary"),
            "packed",
        )
    with batches_of(spark, CHUNKS):
        return _score_packed(spark, packed, doc_id, id_type, filter_bytes)


def _score_packed(spark, packed: DataFrame, doc_id: str, id_type: str, filter_bytes: int) -> DataFrame:
    parts = packed.select(*PARTS)
    n_train, n_keys = packed.agg(
        F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)) / 8
    ).first()
    known = as_written(
        totals_back(packed.select("chunk", *PARTS).mapInArrow(_chunk_words, "chunk bigint, keys binary, counts binary"), key_bits(n_keys)),
        "word-counts",
    )
    n_types = n_words = 0
    for r in known.filter("block = -1").select("totals").toLocalIterator():  # a row per block
        found = np.frombuffer(r.totals, np.uint64)
        n_types, n_words = n_types + int(found[0]), n_words + int(found[1])
    total, distinct = n_words + n_train, n_types + (n_train > 0)
    known = known.filter("block >= 0")

    lowest = _lowest(total)  # no bigram is seen more often than there are tokens
    bits = max(6, int(np.ceil(np.log2(max(1, total / BLOCK_TOKENS)))))
    filters = as_written(
        parts.mapInArrow(_bigram_counts(bits), "block int, keys binary, counts binary")
        .groupBy("block").applyInArrow(lambda key, table: _filter(lowest, key, table), "block int, size bigint, bits binary"),
        "filters",
    )
    groups, held_bytes = [[]], 0
    for r in filters.select("block", F.octet_length("bits").alias("n")).orderBy("block").toLocalIterator():
        if held_bytes and held_bytes + r.n > filter_bytes:
            groups.append([])
            held_bytes = 0
        groups[-1].append(r.block)
        held_bytes += r.n
    parts_of = []
    for blocks in groups:  # one group on the driver at a time
        if blocks:
            found = [(r.block, r.size, bytes(r.bits)) for r in filters.filter(F.col("block").between(blocks[0], blocks[-1])).collect()]
            shared = spark.sparkContext.broadcast(([(block, size, len(raw)) for block, size, raw in found], b"".join(raw for *_, raw in found)))
            shared.unpersist()  # the driver keeps it on its disk
            parts_of.append((shared, blocks[0], blocks[-1] + 1))
            del found
    schema = f"id {id_type}, held boolean, n_tokens bigint, n_known bigint, base double, scores array<double>, left_out array<double>"
    together = F.expr(f"chunk div {TOGETHER}").alias("some")
    made = as_written(
        packed.select(together, "*").groupBy("some").cogroup(known.select(together, "*").groupBy("some")).applyInArrow(
            _score_chunks(parts_of, bits, lowest, total, distinct, n_train), schema
        ),
        "scores",
    )
    chosen = made.agg(*[F.sum(F.col("left_out")[i]) for i in range(len(SMOOTHING))]).first()
    best = max(range(len(SMOOTHING)), key=lambda i: (chosen[i] if chosen[i] is not None else 0.0, -i))
    return made.select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("scores")[best].alias("score"),
    )


def _score_chunks(parts_of, bits, lowest, total, distinct, n_train):
    def run(_: tuple[pa.Scalar, ...], some: pa.Table, totals: pa.Table) -> pa.Table:
        order, chunks = [], []
        names = totals.column("chunk").to_numpy()
        for i in range(some.num_rows):
            chunk = some.column("chunk")[i].as_py()
            mine = totals.take(pa.array(np.flatnonzero(names == chunk)))
            order.append(i)
            chunks.append(_Chunk({c: some.column(c)[i].as_py() for c in PARTS}, in_order(mine).astype(np.int64), n_train, bits))
        for shared, low, high in parts_of:
            part = _Filter(shared.value, 1 << bits)
            for c in chunks:
                c.probe(part, low, high, len(lowest))
            del part
            if len(parts_of) > 1:
                vars(shared).pop("_value", None)  # its file stays, the memory is for the next
        out = []
        for i, c in zip(order, chunks, strict=True):
            n_tokens, n_known, base, scores, left_out = c.scores(lowest, total, distinct)
            n = len(c.held)
            nested = lambda x, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(SMOOTHING), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1), pa.float64()))
            out.append(pa.table({
                "id": some.column("ids").slice(i, 1).combine_chunks().flatten(), "held": pa.array(c.held, pa.bool_()),
                "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()),
                "scores": nested(scores), "left_out": nested(left_out),
            }))
        if not out:  # totals without a chunk do not occur
            return pa.table({"id": pa.nulls(0, some.schema.field("ids").type.value_type), **{c: pa.array([], t) for c, t in EMPTY.items()}})
        return pa.concat_tables(out)

    return run


EMPTY = {
    "held": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(),
    "scores": pa.list_(pa.float64()), "left_out": pa.list_(pa.float64()),
}
