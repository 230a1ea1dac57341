"""Connected components of a graph kept as edges, by alternating large and small stars.

Each round is joins and minima over the edges, written to the shared folder; the
number of rounds grows with the logarithm of the number of nodes. A node that a
large share of the edges meets is a key of joins and of minima only, which Spark
splits and pre-aggregates; no list of neighbours is ever made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.session import as_written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every node's neighbours (larger or smaller than it) to the smallest of them and itself."""
    if larger:
        pairs = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = pairs.join(low, "u")
    if larger:
        linked = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the least node that can be reached."""
    edges = as_written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = as_written(_stars(_stars(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
