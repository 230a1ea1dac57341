"""A step of the fit is exact in its loss and small for the driver."""

import numpy as np
import pyarrow as pa

from jobscope.llm import toxicity as tx


def test_a_step_gives_the_driver_four_bytes_of_a_feature():
    rng = np.random.default_rng(3)
    n = 1 << 12
    value, intercept = rng.normal(size=n), -0.5
    spots = [np.sort(rng.choice(n, 60, replace=False)).astype(np.int32) for _ in range(40)]
    y, copies = rng.integers(0, 2, 40), rng.integers(1, 5, 40)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(y), pa.array(copies), pa.array([tx._packed(at) for at in spots], pa.binary())], ["y", "n", "features"]
    )
    made = list(tx._loss([batch.slice(0, 25), batch.slice(25)], value, intercept))
    assert sum(b.nbytes for b in made) < 5 * n
    z = intercept + np.array([value[at].sum() for at in spots])
    wrong = copies * (1 / (1 + np.exp(-z)) - y)
    slope = np.zeros(n)
    for at, w in zip(spots, wrong, strict=True):
        slope[at] += w
    (out,) = made
    assert np.isclose(out.column("loss")[0].as_py(), (copies * (np.logaddexp(0, z) - y * z)).sum(), rtol=1e-12)
    assert np.isclose(out.column("wrong")[0].as_py(), wrong.sum(), rtol=1e-12)
    assert np.allclose(np.frombuffer(out.column("slope")[0].as_buffer(), np.float32), slope, atol=1e-5)
    assert list(tx._loss([], value, intercept)) == []
