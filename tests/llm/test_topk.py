"""Pivot bounds: never below the score, and tight enough to leave most candidates unseen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import topk
from jobscope.llm.common import read


@pytest.mark.parametrize("rank,pivots", [(16, 16), (16, 5), (3, 16), (0, 16)])
def test_bounds_hold(rank, pivots):
    rng = np.random.default_rng(rank + pivots)
    x = np.floor(64 * rng.standard_normal((400, max(rank, 1))) @ rng.standard_normal((max(rank, 1), 16))) * (rank > 0)
    x[100:130] = x[7]  # ties
    made = topk.Pivots.choose(x[:65], pivots)
    assert len(made.others) <= min(pivots, 16)
    ids = rng.permutation(400)
    for (qid, found, scores, seen), row in zip(topk.search(ids, x, ids[:60], x[:60], made, 20), range(60)):
        all_scores = sorted(((-(x[row] @ x[c]), ids[c]) for c in range(400) if ids[c] != ids[row]))[:20]
        assert qid == ids[row] and [(-s, i) for s, i in zip(scores, found)] == all_scores
        assert seen <= 400
        if rank == 16 and pivots == 16:
            assert seen <= 120  # k, the first step and ties


def test_share_that_is_evaluated(spark):
    """On the given vectors full-rank pivots leave nearly all candidates unseen."""
    vectors = topk.integers(read(spark, "/root/testdata/sf0.1", "embeddings"), "vec_id", "embedding", 64.0).collect()
    ids, x = np.array([r.id for r in vectors]), np.array([r.v for r in vectors])
    ask = ids % 20 == 0
    made = topk.Pivots.choose(x[: 4 * x.shape[1] + 1], x.shape[1])
    assert len(made.others) == x.shape[1]
    seen = sum(s for *_, s in topk.search(ids, x, ids[ask], x[ask], made, 20))
    assert seen / (ask.sum() * len(ids)) < 0.1


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id bigint, embedding array<double>")
    frame = frame.withColumns({c: F.lit("x") for c in ("id", "v", "d", "row", "score", "rank")})
    got = topk.top_k(frame, frame.filter("vec_id = 20"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(20, 1, 29), (20, 2, 28), (20, 3, 27)]
