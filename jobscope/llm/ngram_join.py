"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), for groups of linked documents.

A document's set is its distinct word shingles, known by 64-bit hashes (a set
by one of its own). Two
documents link when ``100 * |A & B| >= percent * |A | B|``.

1. Equal sets are one class; everything below works on one set per class.
2. All tokens get one global order, rare ones first, from two sketches of fixed
   size (2 ** ``SKETCH_BITS`` counters each) over all documents: tokens that stand out as
   frequent come last, the others go by the frequencies of their words (a
   shingle of rare words is not shared by chance), then by hash. The sketches
   only steer the order; any order gives the same links.
3. Two linked sets of sizes n and m share at least T = percent of the larger
   tokens, so each has a shared token among its first n - T + 1. Those prefixes are the short
   lists of the inverted index. A list of two or more classes is a search unit;
   units of the same members are one.
4. Units are first looked at with a histogram of each set (tokens by their leading
   ``SHAPE`` bits): the overlap is at most the sum of the smaller counts. Members
   that no other one could link with go no further; their sets do not travel.
5. In a unit, a task runs the T-occurrence search: for each set the short lists
   are merged and counted, what reached T - L is probed in the L long ones by
   binary search, and the exact test decides. Members that are already connected
   are not compared again, and a unit gives a spanning forest, not all pairs.
6. A unit beyond ``UNIT_ROWS`` members or ``UNIT_TOKENS`` tokens is cut into
   blocks by hash, each searched alone first. When the components of that are
   known, members outside a unit's largest component meet all blocks of the
   unit, so every pair that could still join two components is looked at.

Defined results: null, empty and white-space texts have no set and are linked
with nothing; a text of fewer words than n is one shingle; rows with one id are
rows of their own (a null id is ignored in a minimum); an empty table gives an
empty one. Needs only the id and the text, so other columns cannot clash.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm import textnum
from jobscope.llm.common import batches_of, counter_rows, in_order, key_bits, sum_counters, totals_back
from jobscope.llm.components import components
from jobscope.session import as_written

SKETCH_BITS = 22
SLICE = 1 << 20  # bytes of text at a time
TEXTS = 2000  # texts of a batch
UNIT_ROWS = 1024
UNIT_TOKENS = 1 << 20
SEEN_BITS = 24
SHAPE = 8  # leading bits of a token; counts are bytes
MU = 0.0085  # DivideSkip's weight of a probe against a merge


def _sets(batch: pa.RecordBatch, n: int, ranks: np.ndarray | None = None):
    """(set, its tokens' word ranks) of every row of a batch with a column ``text``, slice by slice."""
    column = batch.column("text")
    whole = textnum.Buffer(column)
    for i, j in whole.slices(SLICE):
        counts, hashes = textnum.words(whole.rows(i, j))
        yield from textnum.shingles(counts, hashes, n, None if ranks is None else ranks[_bucket(hashes)].astype(np.int32))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _key(tokens: np.ndarray) -> int:
    """A number for a set: 64 bits of a hash of all its tokens."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def sketch(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By bucket, from all documents: the rank of words, and the level of tokens that stand out (0 for the rest)."""
    width = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(2 * width, np.uint32)
        for batch in batches:
            whole = textnum.Buffer(batch.column("text"))
            for i, j in whole.slices(SLICE):
                counts, hashes = textnum.words(whole.rows(i, j))
                np.add.at(total[:width], _bucket(hashes), 1)
                for tokens, _ in textnum.shingles(counts, hashes, n):
                    np.add.at(total[width:], _bucket(tokens), 1)
        yield counter_rows(total)

    total = sum_counters(texts.mapInArrow(count, "block int, counts binary"), 2 * width).astype(float)
    words, tokens = total[:width], total[width:]
    usual = tokens.mean() + 6 * np.sqrt(tokens.mean()) + 8
    return (
        np.minimum(255, np.round(8 * np.log2(1.0 + words))).astype(np.uint8),
        np.where(tokens > usual, np.minimum(255, np.round(4 * np.log2(1.0 + tokens))), 0).astype(np.uint8),
    )


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m tokens."""
    return -(-percent * (n + m) // (100 + percent))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def search(sets: list[np.ndarray], labels: list, percent: int) -> list[tuple[int, int]]:
    """Links that join members not yet connected; members of one label are.

    Sets are taken by size. A set is a query against those before it: merge its
    short lists, probe the long ones, test exactly.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    parent = list(range(len(sets)))
    first: dict = {}
    for i, x in enumerate(labels):
        if x is not None:
            parent[_find(parent, i)] = _find(parent, first.setdefault(x, i))
    size = np.array([len(sets[i]) for i in order])
    tokens, where = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    member = np.repeat(np.arange(len(order)), size)
    by_token = np.argsort(where, kind="stable")  # members ascend within a list
    lists = member[by_token]
    length = np.bincount(where, minlength=len(tokens))
    begin = np.concatenate([[0], np.cumsum(length)])
    at = np.concatenate([[0], np.cumsum(size)])
    links = []
    for r in range(1, len(order)):
        n = int(size[r])
        low = int(np.searchsorted(size, -(-percent * n // 100)))
        if low >= r:
            continue
        root = _find(parent, order[r])
        if all(_find(parent, order[s]) == root for s in range(low, r)):
            continue
        least = needed(n, int(size[low]), percent)
        mine = where[at[r] : at[r + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        longest = int(length[mine[-1]])
        n_long = min(least - 1, int(least / (MU * np.log2(max(2, longest)) + 1)))
        short, long_ = mine[: n - n_long], mine[n - n_long :]
        merged = np.concatenate([lists[begin[t] : begin[t + 1]] for t in short.tolist()])
        merged = np.sort(merged[(merged < r) & (merged >= low)], kind="stable")
        if not len(merged):
            continue
        found, seen = np.unique(merged, return_counts=True)
        long_tokens = tokens[long_]
        for s, c in zip(found[seen >= least - n_long].tolist(), seen[seen >= least - n_long].tolist(), strict=True):
            i, j = order[r], order[s]
            if _find(parent, i) == _find(parent, j):
                continue
            other = sets[j]
            spot = np.minimum(np.searchsorted(other, long_tokens), len(other) - 1)
            both = c + int((other[spot] == long_tokens).sum())
            if 100 * both >= percent * (n + int(size[s]) - both):
                links.append((i, j))
                parent[_find(parent, i)] = _find(parent, j)
    return links


def _by_unit(rows: DataFrame, columns: list[str], work, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Run work(unit, lists of the columns) -> rows on each unit; a unit's rows meet in one task, one after another."""

    def run(batches):
        unit, held, out = None, [[] for _ in columns], []

        def made():
            rows_ = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows_, kinds, strict=True)], names)

        for batch in batches:
            for u, *values in zip(*(batch.column(c).to_pylist() for c in ["unit", *columns]), strict=True):
                if u != unit:
                    if len(held[0]) > 1:
                        out.extend(work(unit, *held))
                    unit, held = u, [[] for _ in columns]
                for to, v in zip(held, values, strict=True):
                    to.append(v)
            yield made()
        if len(held[0]) > 1:
            out.extend(work(unit, *held))
        yield made()

    return rows.select("unit", *columns).repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def _search_units(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) found in units; rows: unit, node, label, tokens."""

    def work(_, nodes, labels, raw):
        return [(nodes[i], nodes[j]) for i, j in search([np.frombuffer(x, np.uint64) for x in raw], labels, percent)]

    return _by_unit(rows, ["node", "label", "tokens"], work, "a bigint, b bigint", ["a", "b"], [pa.int64(), pa.int64()])


def _shape(tokens: np.ndarray) -> bytes | None:
    """Tokens by leading bits; none for a set too large for counts of a byte."""
    counts = np.bincount((tokens >> np.uint64(64 - SHAPE)).astype(np.int64), minlength=1 << SHAPE)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _possible(units: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows (unit, node, label) of members that could link with another one of their unit, by size and shape."""

    def work(_, nodes, labels, sizes, shapes):
        order = sorted(range(len(nodes)), key=sizes.__getitem__)
        size = np.array([sizes[i] for i in order])
        counts = np.array([np.frombuffer(shapes[i] or bytes(1 << SHAPE), np.uint8) for i in order])
        unknown = np.array([shapes[i] is None for i in order])
        stays = np.zeros(len(order), bool)
        for r in range(1, len(order)):
            n = int(size[r])
            low = int(np.searchsorted(size, -(-percent * n // 100)))
            if low < r:
                most = np.minimum(counts[low:r], counts[r]).sum(1, dtype=np.int64)
                fit = (most >= -(-percent * (n + size[low:r]) // (100 + percent))) | unknown[low:r] | unknown[r]
                stays[low:r] |= fit
                stays[r] |= fit.any()
        left = sorted(i for i, s in zip(order, stays.tolist(), strict=True) if s)
        # units that the same members are left of become one
        name = hashlib.blake2b(np.sort(np.array([nodes[i] for i in left], np.int64)).tobytes(), digest_size=16).hexdigest()
        return [(name, nodes[i], labels[i]) for i in left]

    rows = units.join(classes.select("node", "size", "shape"), "node")
    return _by_unit(
        rows, ["node", "label", "size", "shape"], work, "unit string, node bigint, label bigint", ["unit", "node", "label"],
        [pa.string(), pa.int64(), pa.int64()],
    )


def _sets_of(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the members, each once.

    A bit map of fixed size keeps sets of other classes from travelling; the join after it is exact.
    """
    spark = texts.sparkSession
    spot = F.shiftrightunsigned("node", 64 - SEEN_BITS)
    words = (
        members.select(spot.alias("s"))
        .groupBy(F.shiftright("s", 5).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits"))
        .collect()  # 2 ** (SEEN_BITS - 5) at most
    )
    seen = np.zeros(1 << (SEEN_BITS - 5), np.uint32)
    for r in words:
        seen[r.w] = r.bits
    shared = spark.sparkContext.broadcast(zlib.compress(seen.tobytes(), 1))

    def run(batches):
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint32)
        for batch in batches:
            nodes, sets, held = [], [], 0
            for tokens, _ in _sets(batch, n):
                if not len(tokens):
                    continue
                node = _key(tokens)
                s = (node & (1 << 64) - 1) >> 64 - SEEN_BITS
                if bits[s >> 5] >> np.uint32(s & 31) & np.uint32(1):
                    nodes.append(node)
                    sets.append(tokens.tobytes())
                    held += len(sets[-1])
                if held > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    return texts.mapInArrow(run, "node bigint, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _block(k) -> F.Column:
    return F.pmod(F.xxhash64("node"), k)


PACKED = "chunk bigint, nodes array<bigint>, sizes array<int>, shapes array<binary>, lengths array<int>, tokens binary"


def _pack(batches):
    """Classes of a batch as one row; tokens are their prefixes one after another."""
    for number, batch in enumerate(b for b in batches if b.num_rows):
        prefix = batch.column("prefix")
        chunk = (TaskContext.get().partitionId() << 32) + number
        flat = np.asarray(prefix.flatten().to_numpy(zero_copy_only=False), np.int64)
        one = lambda c, k: pa.array([c.to_pylist()], pa.list_(k))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()), one(batch.column("node"), pa.int64()), one(batch.column("size"), pa.int32()),
                one(batch.column("shape"), pa.binary()), one(pc.list_value_length(prefix), pa.int32()), pa.array([flat.tobytes()], pa.binary()),
            ],
            ["chunk", "nodes", "sizes", "shapes", "lengths", "tokens"],
        )


def _chunk_tokens(batches):
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            keys, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary())],
                ["chunk", "keys", "counts"],
            )


def _shared_tokens(key: tuple[pa.Scalar, ...], chunk: pa.Table, totals: pa.Table) -> pa.Table:
    """The prefix tokens of a chunk that two classes or more have."""
    tokens = np.frombuffer(chunk.column("tokens")[0].as_py(), np.uint64)
    lengths = np.array(chunk.column("lengths")[0].as_py(), np.int64)
    _, where = np.unique(tokens, return_inverse=True)
    some = np.flatnonzero(in_order(totals)[where] > 1)
    owner = np.repeat(np.arange(len(lengths)), lengths)[some]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return pa.table({
        "token": pa.array(tokens[some].view(np.int64)),
        "node": pa.array(np.array(chunk.column("nodes")[0].as_py(), np.int64)[owner]),
        "size": pa.array(np.array(chunk.column("sizes")[0].as_py(), np.int32)[owner]),
        "place": pa.array((some - begin[owner]).astype(np.int32)),
    })


def links(docs: DataFrame, texts: DataFrame, n: int, percent: int, unit_rows: int, unit_tokens: int) -> DataFrame:
    """Links (a, b) between classes that connect all that is connected; docs: node, size, prefix."""
    packed = as_written(
        docs.filter("size > 0").groupBy("node")
        .agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("shape").alias("shape"))
        .mapInArrow(_pack, PACKED),
        "classes",
    )
    classes = packed.select(F.explode(F.arrays_zip("nodes", "sizes", "shapes")).alias("c")).select(
        F.col("c.nodes").alias("node"), F.col("c.sizes").alias("size"), F.col("c.shapes").alias("shape")
    )
    n_tokens = packed.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)) / 8).first()[0]
    shared = totals_back(packed.select("chunk", "tokens").mapInArrow(_chunk_tokens, "chunk bigint, keys binary, counts binary"), key_bits(n_tokens))
    index = as_written(
        packed.select("chunk", "nodes", "sizes", "lengths", "tokens").groupBy("chunk")
        .cogroup(shared.filter("block >= 0").groupBy("chunk"))
        .applyInArrow(_shared_tokens, "token bigint, node bigint, size int, place int"),
        "prefix-index",
    )
    lists = index.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), F.min("size").alias("least")
    )
    rows = as_written(
        index.join(lists, "token")
        # with ``place`` rarer tokens unmatched, too few are left for even the smallest partner: not a member
        .withColumn("least", F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100)))
        .filter((F.col("size") - F.col("place")) * (100 + percent) >= (F.col("size") + F.col("least")) * percent)
        .withColumn("blocks", F.greatest(F.ceil(F.col("members") / unit_rows), F.ceil(F.col("total") / unit_tokens)).cast("bigint"))
        .select("token", "node", "blocks"),
        "prefix-rows",
    )
    small = (
        rows.filter("blocks = 1")
        .groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # unit_rows at most
        .filter(F.size("nodes") > 1)
        .groupBy(F.xxhash64("nodes").alias("unit"), "nodes").agg(F.lit(1).alias("_"))
        .select(F.concat(F.lit("s"), F.col("unit")).alias("unit"), F.explode("nodes").alias("node"))
    )
    large = rows.filter("blocks > 1")
    alone = large.select(F.concat_ws("/", F.lit("l"), "token", _block(F.col("blocks"))).alias("unit"), "node")
    none = F.lit(None).cast("bigint").alias("label")

    def search_all(units: DataFrame) -> DataFrame:
        units = as_written(_possible(units, classes, percent).distinct(), "units")
        sets = _sets_of(texts, units.select("node").distinct(), n)
        with batches_of(texts.sparkSession, TEXTS):
            return as_written(_search_units(units.join(sets, "node"), percent), "links")

    found = search_all(small.unionByName(alone).select("unit", "node", none))
    if large.isEmpty():
        return found
    # what blocks kept apart: members outside the largest component of a unit meet all its blocks
    labels = as_written(components(found), "labels")
    named = as_written(
        large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large-units"
    )
    main = (
        named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("members"), F.max("c").alias("c"))
        .filter("members > c")
    )
    open_ = named.join(as_written(main, "main-labels"), "token").withColumn("other", F.col("label") != F.col("main"))
    n_other = F.greatest(F.lit(1), F.ceil((F.col("members") - F.col("c")) / unit_rows)).cast("bigint")
    open_ = open_.withColumn("rows", n_other).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a cell is one block of the others with one block of all; a member outside is in its own row of cells and in its column
    as_other = F.when(
        F.col("other"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: F.struct(F.pmod(F.xxhash64("node"), F.col("rows")).alias("r"), b.alias("b"))),
    ).otherwise(F.array().cast("array<struct<r:bigint,b:bigint>>"))
    as_any = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), F.col("mine").alias("b")))
    cells = (
        open_.withColumn("cell", F.explode(F.array_distinct(F.concat(as_other, as_any))))
        .select(F.concat_ws("/", F.lit("c"), "token", "cell.r", "cell.b").alias("unit"), "node", "label")
    )
    return found.unionByName(search_all(cells))


def _text_hashes(text: str):
    body = F.col(f"`{text}`").cast("string")
    return {"t1": F.xxhash64(body), "t2": F.xxhash64(F.lit("text"), body)}


def _linked(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    percent: int = 80,
    unit_rows: int = UNIT_ROWS,
    unit_tokens: int = UNIT_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, t1, t2, node, size) of docs, and the label and least id of each node's component."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    with batches_of(spark, TEXTS):
        shared = spark.sparkContext.broadcast(sketch(texts, n))

    def describe(batches):
        words, levels = shared.value
        for batch in batches:
            nodes, sizes, prefixes, shapes = [], [], [], []
            for tokens, weight in _sets(batch, n, words):
                size = len(tokens)
                sizes.append(size)
                shapes.append(_shape(tokens))
                nodes.append(_key(tokens) if size else None)
                # the rarest size - T + 1 tokens, where T holds for the smallest partner
                short = size - -(-percent * size // 100) + 1
                order = np.lexsort((tokens, weight, levels[_bucket(tokens)]))
                prefixes.append(tokens[order[:short]].view(np.int64) if size else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), flat, pa.array(shapes, pa.binary())], ["id", "t1", "t2", "node", "size", "prefix", "shape"]
            )

    id_type = dict(docs.dtypes)[doc_id]
    with batches_of(spark, TEXTS):
        known = as_written(
            docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), *[h.alias(c) for c, h in _text_hashes(text).items()])
            .mapInArrow(describe, f"id {id_type}, t1 bigint, t2 bigint, node bigint, size int, prefix array<bigint>, shape binary"),
            "shingled",
        )
    classes = as_written(known.filter("size > 0").groupBy("node").agg(F.min("id").alias("least")), "classes")
    labels = components(links(known, texts, n, percent, unit_rows, unit_tokens))
    joined = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = joined.groupBy("label").agg(F.min("least").alias("component"))
    final = as_written(joined.join(low, "label").select("node", "label", "component"), "components")
    return known.select("id", "t1", "t2", "node", "size"), final


def linked_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = 5,
    percent: int = 80,
    unit_rows: int = UNIT_ROWS,
    unit_tokens: int = UNIT_TOKENS,
) -> DataFrame:
    """Per row: the id, n_shingles, component_id (least id that links reach, its own included)."""
    known, final = _linked(docs, doc_id, text, n, percent, unit_rows, unit_tokens)
    return known.join(final, "node", "left").select(
        F.col("id").alias(doc_id), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, that of the least id (null last), and all rows without a shingle; columns as they came."""
    known, final = _linked(docs, doc_id, text, **options)
    row = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2", "n")
    first = known.join(final, "node").groupBy("label", "id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.min(row).alias("w"))
    bare = known.filter("size = 0").select("id", "t1", "t2").distinct().withColumn("n", F.lit(1).cast("bigint"))
    kept = as_written(first.select("w.id", "w.t1", "w.t2", "w.n").unionByName(bare), "kept-rows")
    kept = kept.select(*[F.col(c).alias(f"_kept_{c}") for c in kept.columns])
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_kept_id"))
    for c, h in _text_hashes(text).items():
        same = same & (h == F.col(f"_kept_{c}"))
    # rows of one id and one text are told apart by nothing else: any one of them stays
    single = docs.join(kept.filter("_kept_n = 1"), same, "left_semi")
    several = docs.join(kept.filter("_kept_n > 1"), same).dropDuplicates(["_kept_id", "_kept_t1", "_kept_t2"])
    return single.unionByName(several.select(*[F.col(f"`{c}`") for c in docs.columns]))
