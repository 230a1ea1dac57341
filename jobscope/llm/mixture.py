"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Weights go to sources by the code points of their names, null last, repeating.
All sources together shall give ``share`` times the words there are. A source
gives ``max_epochs`` times its words at most; what it cannot give is dealt to
the others by weight, until no source is above its bound. Each round is one
aggregate over the table of sources; a round clamps a source at least.

A source with target t and s words gives every document floor(t / s) times
whole. The rest of the target is a seeded sample: documents in the order of
md5(seed, doc_id) until the words are reached, the last one only as far as they
go. So every source meets its target to the word, rounded.

The order of a source is never sorted in one place: documents are dealt into
buckets by the leading bits of the hash, bucket totals give the bucket where the
sample ends, and only that bucket is sorted. The number of buckets follows the
number of rows (about ``BUCKET_ROWS`` each); the result does not depend on it.

Defined results: a null text has size 0; a null source is a source of its own;
rows with one id (or none) are ordered by size as well and equal rows are
interchangeable; sources of no words have target 0; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import fresh
from jobscope.session import as_written

BUCKET_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame, name: str) -> DataFrame:
    """Add ``_place``: 0, 1, 2 ... by code point, null last; sorted in ranges, not in one task."""
    placed = as_written(
        sources.repartitionByRange(F.col(name).isNull(), F.col(name))
        .sortWithinPartitions(F.col(name).isNull(), F.col(name))
        .withColumn("_id", F.monotonically_increasing_id()),
        "sources",
    )
    part, offset = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    # a row per partition
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        placed.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("_place", (F.col("_before") + offset).cast("bigint"))
        .drop("_part", "_before", "_id")
    )


def targets(sources: DataFrame, name: str, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """name, source_size, target of every row of (name, source_size)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = as_written(
        numbered(sources, name).select(name, "source_size", weight.alias("_w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("_cap")),
        "weights",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = float(share) * total, None
    clamped = F.lit(False)
    n_clamped = -1
    while True:
        # one row: what the clamped give, the weight of the rest
        held, free, n = table.agg(
            F.sum(F.when(clamped, F.col("_cap"))), F.sum(F.when(~clamped, F.col("_w"))), F.count(F.when(clamped, 1))
        ).first()
        if n == n_clamped or not free:
            break
        n_clamped = n
        rest = wanted - (held or 0.0)
        clamped = clamped | (F.col("_w") * F.lit(rest) / F.lit(free) > F.col("_cap"))
        level = (rest, free)
    fair = F.col("_w") * F.lit(level[0]) / F.lit(level[1]) if level else F.lit(0.0)
    return table.select(
        name, "source_size", F.when(clamped | F.lit(not free), F.col("_cap")).otherwise(fair).cast("double").alias("target")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: list[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of docs (columns ``keep``, by default the id) with what the mix takes.

    size and source_size in words, target (of the source), repeats (times the
    whole document is taken), part (words of a further, partial repetition),
    taken = repeats * size + part.
    """
    keep = [doc_id] if keep is None else keep
    # kept columns travel in a struct, so that no name can clash
    sized = as_written(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
            F.col(f"`{source}`").alias("_source"),
            n_words(F.col(f"`{text}`")).alias("size"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))).alias("_at"),
        ),
        "sizes",
    )
    n_rows = sized.count()
    digits = 1
    while 16**digits * BUCKET_ROWS < n_rows and digits < 12:
        digits += 1
    sized = sized.withColumn("_bucket", F.substring("_at", 1, digits))
    buckets = as_written(
        sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")), "buckets"
    )
    goals = as_written(
        targets(buckets.groupBy("_source").agg(F.sum("_words").alias("source_size")), "_source", list(weights), share, max_epochs)
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("bigint")),
        "goals",
    ).withColumnRenamed("_source", "_name")
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = as_written(
        buckets.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)).cast("bigint"))
        .join(goals, F.col("_source").eqNullSafe(F.col("_name")))
        .select(
            F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "source_size", "target", "_whole",
            # words the sample still wants when this bucket begins; null where it takes all or nothing
            F.when(F.col("_rest") >= F.col("_before") + F.col("_words"), F.lit(1))
            .when(F.col("_rest") <= F.col("_before"), F.lit(0)).alias("_all"),
            (F.col("_rest") - F.col("_before")).alias("_left"),
        ),
        "plan",
    )
    placed = sized.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    cut = placed.filter("_all is null")
    inside = Window.partitionBy("_s", "_b").orderBy("_at", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn(
        "part",
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))).cast("bigint"),
    )
    plain = placed.filter("_all is not null").withColumn("part", F.col("_all") * F.col("size"))
    whole = plain.unionByName(cut)
    names = {c: fresh(c, keep) for c in ("size", "source_size", "target", "repeats", "part", "taken")}
    return whole.select(
        *[F.col("_row")[c].alias(c) for c in keep],
        F.col("size").alias(names["size"]),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        F.col("_whole").alias(names["repeats"]),
        F.col("part").cast("bigint").alias(names["part"]),
        (F.col("_whole") * F.col("size") + F.col("part")).cast("bigint").alias(names["taken"]),
    )
