"""Whitening: Jacobi-Davidson against dense eigenvectors, whole results against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobscope.llm import whitening


def _check(matrix, want, **how):
    values, axes = whitening.jacobi_davidson(lambda u: matrix @ u, len(matrix), want, **how)
    all_values = np.linalg.eigvalsh(matrix)[::-1][:want]
    there = all_values[all_values > whitening.NO_VARIANCE * max(all_values[0], 0)]
    assert len(values) == len(there)
    if len(values):
        size = all_values[0]
        assert np.abs(values - there).max() <= 1e-12 * size
        assert np.abs(matrix @ axes - axes * values).max() <= 1e-12 * size
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() <= 1e-12


@pytest.mark.parametrize("n,d,want", [(500, 64, 32), (5, 64, 32), (4000, 300, 20), (3, 1, 1), (50, 33, 32), (200, 128, 128)])
def test_pairs_of_covariances(n, d, want):
    x = np.random.default_rng(n).standard_normal((n, d)) * 8
    x -= x.mean(0)
    _check(x.T @ x / n, want)


def test_pairs_of_hard_spectra():
    _check(np.diag(np.r_[np.full(4, 5.0), np.ones(3), np.zeros(3)]), 6, block=2)  # copies beyond the block
    _check(np.diag(np.r_[np.ones(50), np.zeros(14)]), 32)
    _check(np.diag(1 / np.arange(1.0, 301)), 16)
    _check(np.diag(np.r_[np.full(20, 3.0), np.linspace(0, 1, 180)]), 18, block=4)
    _check(np.zeros((4, 4)), 3)


def test_minres_solves():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((12, 12))
    a = a + a.T  # symmetric, of both signs
    b = np.column_stack([rng.standard_normal((12, 3)), np.zeros(12)])
    x = whitening.minres(lambda t: a @ t, b, 12)
    assert np.abs(a @ x - b).max() < 1e-8
    norms = [np.linalg.norm(a @ whitening.minres(lambda t: a @ t, b, k) - b) for k in range(12)]
    assert all(x >= y - 1e-9 for x, y in zip(norms, norms[1:]))


def _brute(rows, components):
    """id, per component whitened (sign free), deviations and explained, from the dense covariance."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    z = ((n * x - s) / n).astype(float)
    values, axes = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    values, axes = values[order], axes[:, order]
    return z, deviation, values, axes


def _frame(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((8, 8)) * np.linspace(1, 0.2, 8)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(8) @ mixed]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1])] + [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all is one vector
    bad = [(500, None), (501, []), (502, [None] * 8), (503, [float("nan"), *[0.0] * 7]), (504, [float("inf"), *[0.0] * 7])]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("x", F.lit("clash"))
    return rows, frame


def test_whiten_against_brute_force(spark):
    rows, frame = _frame(spark)
    z, deviation, values, axes = _brute(rows, 5)
    got = whitening.whiten(frame.repartition(7), components=5).collect()
    assert len(got) == 5 * len(rows) and {r.n for r in got} == {len(rows)}
    want = {}
    for (i, _), w, dev in zip(rows, z @ axes / np.sqrt(values), deviation):
        want.setdefault(i, (w, dev))
    signs = {}
    for r in got:
        w, dev = want[r.vec_id]
        assert r.deviation == dev
        assert r.explained == pytest.approx(values[r.component - 1] / (z * z).sum() * len(rows), rel=1e-9)
        sign = signs.setdefault(r.component, 1.0 if abs(w[r.component - 1]) < 1e-6 or r.whitened * w[r.component - 1] > 0 else -1.0)
        if abs(w[r.component - 1]) > 1e-6:
            assert r.whitened * sign == pytest.approx(w[r.component - 1], abs=1e-8)
        assert r.identity_error <= 1e-9
    made = np.zeros((len(rows), 5))
    for k in range(5):
        made[:, k] = [r.whitened for r in got if r.component == k + 1]
    assert np.abs(made.T @ made / len(rows) - np.eye(5)).max() < 1e-9


def test_whiten_without_variance_or_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)  # one direction only
    got = whitening.whiten(line).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_lengths_are_apart(spark):
    rows = [(i, [math.sin(i), math.cos(3 * i)]) for i in range(40)] + [(100 + i, [math.sin(i * i), 1.0 * i, math.cos(i)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert {(r.n, r.component) for r in got} == {(40, 1), (40, 2), (30, 1), (30, 2), (30, 3)}
    alone = whitening.whiten(frame.filter("vec_id < 100")).collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in alone) == sorted((r.vec_id, r.component, r.deviation) for r in got if r.n == 40)
