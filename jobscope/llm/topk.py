"""Exact top-k by inner product with a pivot table.

Vectors become integers, floor(scale * x). Pivots are rows of a hash-chosen sample, each the
one farthest from the span of those before, as many as the vectors have dimensions (fewer where the sample spans less).

The distances of a vector to all pivots, the pivot table, are computed once per block. They place it in the pivots'
simplex: its coordinates in their span follow from the distances, and its height above the span. For a query q
and a candidate x that gives the greatest lower bound of |q - x| that the pivots' distances allow, and by
2 q.x = |q|^2 + |x|^2 - |q - x|^2 an upper bound of the score; for a block of queries the bounds are one
matrix product. Candidates are evaluated in the order of their bound until the next bound is below the k-th
score found, so the result is exact. With pivots of full rank the bound is tight and little more than k candidates are evaluated.

Queries meet all candidates in blocks: a task gets a block of candidates and a
block of queries and returns k candidates per query; those lists are merged by
query.
Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without an id; only vectors of one length
are compared; rows with the query's id are its own and no candidates; equal scores
go to the smaller id; a repeated query row is a query of its own; fewer candidates than k are all returned.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.session import as_written

PIVOTS = 256  # at most
SAMPLE = 4  # rows to choose each pivot from
BLOCK = 8192  # candidates of a task
QUERIES = 4096  # queries of a task
TOGETHER = 128  # queries whose bounds are held together
STEP = 32  # candidates beyond k that are evaluated at first


def integers(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """id and the whole-numbered components of the vectors that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole
    ).select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


@dataclass(frozen=True)
class Pivots:
    """The first pivot, the others, and the inverse factor of their directions' products."""

    first: np.ndarray
    others: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def choose(rows: np.ndarray, most: int) -> "Pivots":
        """Far apart: each pivot is the row farthest from the span of those before."""
        first, rest = rows[0], rows[1:] - rows[0]
        left, chosen, basis = rest.copy(), [], []
        size = (rest * rest).sum(1).max(initial=0)
        while len(chosen) < min(most, rows.shape[1]) and len(rest):
            heights = (left * left).sum(1)
            best = int(heights.argmax())
            if heights[best] <= 1e-9 * size:
                break
            axis = left[best] / np.sqrt(heights[best])
            for b in basis:  # once more, against rounding
                axis = axis - (axis @ b) * b
            basis.append(axis / np.linalg.norm(axis))
            chosen.append(best)
            left = left - np.outer(left @ basis[-1], basis[-1])
        others = rest[chosen].reshape(len(chosen), rows.shape[1])
        factor = np.linalg.cholesky(others @ others.T) if chosen else np.zeros((0, 0))
        return Pivots(first, others + first, np.linalg.inv(factor))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table: squared distances to the first and to the others."""
        p = np.vstack([self.first, self.others])
        return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)

    def place(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the pivots' span, and heights above it, from the distances alone."""
        directions = self.others - self.first
        products = (table[:, :1] + (directions * directions).sum(1)[None, :] - table[:, 1:]) / 2
        at = products @ self.inverse.T
        return at, np.sqrt(np.maximum(table[:, 0] - (at * at).sum(1), 0))


def search(ids, x, query_ids, q, pivots: Pivots, k: int):
    """(query, ids, scores, number evaluated) of each query's k best candidates of a block."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    at_x, high_x = pivots.place(pivots.distances(x))
    square_x, near_x = (x * x).sum(1), (at_x * at_x).sum(1)
    for a in range(0, len(q), TOGETHER):
        part = q[a : a + TOGETHER]
        at_q, high_q = pivots.place(pivots.distances(part))
        square_q = (part * part).sum(1)
        low = (at_q * at_q).sum(1)[:, None] + near_x[None, :] - 2 * at_q @ at_x.T + np.square(high_q[:, None] - high_x[None, :])
        size = square_q[:, None] + square_x[None, :]
        # distances are rounded: a little slack keeps the bound a bound
        bound = (size - low) / 2 + 1e-9 * size + 1e-6
        bound[query_ids[a : a + TOGETHER, None] == ids[None, :]] = -np.inf
        some = min(k + STEP, len(x))
        early = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        scores = np.einsum("qd,qsd->qs", part, x[early])
        scores[np.take_along_axis(bound, early, 1) == -np.inf] = -np.inf
        least = np.full(len(part), -np.inf) if some < k else -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        open_ = (bound >= least[:, None]) & (bound > -np.inf)
        np.put_along_axis(open_, early, False, 1)
        for i in range(len(part)):
            spots, found = early[i], scores[i]
            later = np.flatnonzero(open_[i])
            if len(later):  # in the order of their bound, until it is below the k-th score
                later = later[np.argsort(-bound[i][later], kind="stable")]
                for b in range(0, len(later), STEP):
                    more = later[b : b + STEP]
                    if len(found) >= k and bound[i][more[0]] < -np.partition(-found, k - 1)[k - 1]:
                        break
                    spots, found = np.concatenate([spots, more]), np.concatenate([found, x[more] @ part[i]])
            there = found > -np.inf
            spots, found = spots[there], found[there]
            top = np.lexsort((spots, -found))[:k]  # places are in the order of ids
            yield query_ids[a + i], ids[spots[top]], found[top], len(spots)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    n_pivots: int = PIVOTS,
    block: int = BLOCK,
    query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of the greatest inner product."""
    id_type = dict(vectors.dtypes)[vec_id]
    candidates = as_written(integers(vectors, vec_id, vector, scale).withColumn("d", F.size("v")), "vectors")
    asked = as_written(
        integers(queries, vec_id, vector, scale).withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "queries"
    )
    sizes = {r.d: r.n for r in candidates.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    asked_sizes = {r.d: r.n for r in asked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for d in sorted(set(sizes) & set(asked_sizes)):
        part = _one_length(candidates.filter(F.col("d") == d), asked.filter(F.col("d") == d), sizes[d], asked_sizes[d], id_type, k, n_pivots, block, query_block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score bigint")
    return found


def _one_length(candidates, asked, n, m, id_type, k, n_pivots, block, query_block):
    spark = candidates.sparkSession
    d = len(candidates.select("v").first().v)
    most = min(n_pivots, d)
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most + 1).select("v").collect()
    shared = spark.sparkContext.broadcast(Pivots.choose(np.array([r.v for r in sample]), most))
    blocks, query_blocks = -(-n // block), -(-m // query_block)
    spot = lambda x: F.pmod(F.xxhash64(F.lit("block"), "id", "v"), F.lit(x)).cast("int")
    each = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    left = candidates.select(spot(blocks).alias("b"), "id", "v").withColumn("c", each(query_blocks))
    right = asked.select(spot(query_blocks).alias("c"), "id", "row", "v").withColumn("b", each(blocks))

    def run(key: tuple[pa.Scalar, ...], x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({"query_id": x.column("id").slice(0, 0), "row": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(x.schema.field("id").type)), "scores": pa.array([], pa.list_(pa.int64()))})
        rows = list(search(x.column("id").to_numpy(), _matrix(x.column("v")), q.column("id").to_numpy(), _matrix(q.column("v")), shared.value, k))
        return pa.table({
            "query_id": pa.array([r[0] for r in rows], x.schema.field("id").type),
            "row": q.column("row").combine_chunks(),
            "ids": pa.array([r[1] for r in rows], pa.list_(x.schema.field("id").type)),
            "scores": pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64())),
        })

    lists = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(
        run, f"query_id {id_type}, row bigint, ids array<{id_type}>, scores array<bigint>"
    )
    rows = lists.select("query_id", "row", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", "row", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
