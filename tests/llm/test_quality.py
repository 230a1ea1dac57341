"""Quality classifier: statistics against plain counting, the fit against direct solutions, held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobscope.llm import quality, textnum
from jobscope.llm.common import read, remainder

TEXTS = [None, "", " \n\t", "One two, two three. One two, two three.\nÉté 12!", "A|B|C\nA|B|C\nA|B|C\n", "x" * 70_000 + " " + "word " * 150_000, "ABC ABC"]


def test_statistics_count_whole_texts():
    buf = textnum.Buffer(pa.array(TEXTS, pa.string()))
    got = quality.statistics(buf)
    assert got.shape == (len(TEXTS), quality.N_STATISTICS) and np.isfinite(got).all()
    assert not got[1].any() and (got[0] == got[1]).all()
    for k, t in enumerate(TEXTS):
        raw, words = (t or "").encode(), (t or "").lower().split()
        kinds = np.bincount(quality.KIND[np.frombuffer(raw, np.uint8)], minlength=quality.N_KINDS) / max(1, len(raw))
        assert got[k, : quality.N_KINDS] == pytest.approx(kinds)
        rest = got[k, 2 * quality.N_KINDS + quality.N_KINDS**2 :]
        assert np.expm1(rest[:2]) == pytest.approx([len(raw), len(words)])
        if words:
            assert np.expm1(rest[3]) == pytest.approx(sum(len(w.encode()) for w in words) / len(words))
            assert rest[5] == pytest.approx(sum(any(c.isalpha() for c in w) for w in words) / len(words))
            assert rest[6] == pytest.approx(len(set(words)) / len(words))
            assert rest[7] == pytest.approx(max(map(words.count, set(words))) / len(words))
    # the same whatever the texts beside it
    for k, t in enumerate(TEXTS):
        assert quality.statistics(textnum.Buffer(pa.array([t], pa.string())))[0] == pytest.approx(got[k], abs=1e-12)


def test_pools_are_the_isotonic_solution():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 4, 60).astype(float)
    yes = np.minimum(rows, rng.integers(0, 4, 60))
    spots, values = quality.pools(yes, rows)
    assert (np.diff(values) > 0).all() and (np.diff(spots) > 0).all()
    # min-max formula of isotonic regression
    for k in np.flatnonzero(rows):
        want = max(min(yes[a : b + 1].sum() / rows[a : b + 1].sum() for b in range(k, 60) if rows[a : b + 1].sum()) for a in range(k + 1) if rows[a : k + 1].sum())
        edges = np.searchsorted(np.cumsum([0, *_sizes(yes, rows)]), np.cumsum(rows)[k] - 0.5, "right") - 1
        assert values[edges] == pytest.approx(want)


def _sizes(yes, rows):
    """Rows of each pool, from the shares alone."""
    made = []
    for n, y in zip(rows, yes):
        if n:
            made.append([n, y])
            while len(made) > 1 and made[-2][1] * made[-1][0] >= made[-1][1] * made[-2][0]:
                n2, y2 = made.pop()
                made[-1] = [made[-1][0] + n2, made[-1][1] + y2]
    return [n for n, _ in made]


def _frame(spark, n=240):
    rows = [(i, f"Plain words of document {i}. They go on, as {i * 7 % 13} does." if i % 3 else f"BUY!! {i} $$$ BUY!! $$$ ### {i % 5} ###", "x") for i in range(n)]
    rows += [(None, None, "x"), (900, "", "x"), (901, None, "x"), (902, "long and plain text. " * 20_000, "x"), (3, rows[3][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score string").withColumn("_text", F.lit("clash"))
    labels = [(i, int(i % 3 > 0)) for i in range(n) if i % 4] + [(None, 1), (3, 0), (900, None), (901, 7)]
    return frame, spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_quality_against_a_direct_fit(spark):
    """The summed normal equations give what one dense solve over all rows gives."""
    frame, labels = _frame(spark)
    described = quality.describe(frame)
    model = quality.train(described, labels, features=40)
    rows = (
        described.join(labels.filter("quality in (0, 1)"), "doc_id").filter(remainder(F.col("doc_id"), 3) != 1)
        .select("statistics", "quality").collect()
    )
    x = np.array([np.frombuffer(bytes(r.statistics), np.float32) for r in rows], float)
    y = np.array([r.quality for r in rows], float)
    assert model.mean == pytest.approx(x.mean(0)) and len(y) > 100
    z = model.features(x)
    fits = []
    for penalty in quality.PENALTIES:
        ridge = np.diag([*[penalty * len(y) + 1e-9] * 40, 1e-9])
        fits.append(np.linalg.solve(z.T @ z + ridge, z.T @ y))
    assert min(np.abs(z @ (w - model.weights)).max() for w in fits) < 1e-6
    kernel = model.features(x[:5])[:, :-1] @ model.features(x[:5])[:, :-1].T
    assert kernel.diagonal() == pytest.approx(1, abs=0.6)  # random features of a kernel that is 1 at 0


def test_quality_scores(spark):
    frame, labels = _frame(spark)
    described = quality.describe(frame)
    model = quality.train(described, labels)
    made = quality.score(described, model)
    assert made.columns == ["doc_id", "text", "score", "_text", "score_"]
    got = {r.doc_id: r.score_ for r in made.collect()}
    assert made.count() == frame.count() and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(240)) and got[902] >= 0.5 and got[900] == got[901] == got[None]
    repeated = [r.score_ for r in made.filter("doc_id = 3").collect()]
    assert len(repeated) == 2 and repeated[0] == pytest.approx(repeated[1], rel=1e-9)


def test_quality_without_labels_or_rows(spark):
    frame, labels = _frame(spark, 30)
    described = quality.describe(frame)
    for some, want in ((labels.limit(0), 0.0), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        model = quality.train(described, some)
        assert {r.score_ for r in quality.score(described, model).collect()} == {want}
    nothing = quality.describe(frame.limit(0))
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    described = quality.describe(docs, keep=["doc_id"])
    rows = quality.score(described, quality.train(described, labels)).join(labels, "doc_id").filter(remainder(F.col("doc_id"), 3) == 1).collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    assert len(rows) > 100 and right >= 0.95
