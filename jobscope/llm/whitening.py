"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Vectors become whole numbers, floor(scale * c) + SHIFT, and are packed once as matrices of
n * x - S, which is exact in 64-bit integers, over n: centred before anything is multiplied.

1. The covariance V is never formed. V u for a block of vectors u is one Spark job: every
   partition gives X' (X u) of its rows, Spark adds the partitions up; the driver gets
   as many numbers as u has.
2. Jacobi-Davidson: in the span of the search vectors Rayleigh-Ritz gives the leading pairs.
   For a block of them that have not converged, the correction equation
   (I - QQ')(V - theta I)(I - QQ') t = -r is solved by some steps of MINRES, all its
   equations together, so that a step is one job; Q holds the locked vectors and the block's own. The
   solutions, orthogonalised, extend the search space, which restarts from its best pairs when full.
3. Pairs are locked from the greatest eigenvalue down once their residual is ``TOLERANCE``
   times the size of V, the rounding of double precision, or when the search space is the whole space.
4. Rows are projected and divided by the root of the eigenvalue. The covariance of what comes out is
   measured over all rows; its distance from the identity is ``identity_error``.

Defined results: rows without a vector, with an empty one, or with a null or non-finite component are
dropped; a null or repeated id is an ordinary row; vectors of each length are a fit list of
their own; directions without variance (fewer different rows than dimensions, or one row)
give no component, so an eigenvalue is never divided by zero; equal eigenvalues give some basis of
their space; an empty table gives an empty one. ``deviation`` is exact or, beyond 64 bits, an error. Only the id and
the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import batches_of, summed
from jobscope.session import as_written

SHIFT = 1_000_000
COMPONENTS = 32
BLOCK = 16  # correction equations solved together
INNER = 4  # steps of MINRES
TOLERANCE = 64 * np.finfo(float).eps
NO_VARIANCE = 1e-13  # of the greatest eigenvalue: no direction of the data
ROUNDS = 400
ROWS = 2048  # vectors of a packed matrix

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """id and whole-numbered components (bigint) of the vectors that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (
        vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("bigint") + F.lit(SHIFT)).alias("x"))
    )


def _summed(packed: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """part(centred rows), added up over all of them; one Spark job."""

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for raw, d in zip(batch.column("x").to_pylist(), batch.column("d").to_pylist(), strict=True):
                total = total + part(np.frombuffer(raw).reshape(-1, d))
        return total

    return summed(packed, run, shape)


def minres(product: Product, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for every column of rhs (Paige and Saunders); a step is one product."""
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(rhs), rhs / np.where(live, beta, 1)
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    eta, gamma_old, gamma, sigma_old, sigma = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        delta = gamma * alpha - gamma_old * sigma * beta
        rho1 = np.hypot(delta, beta_new)
        rho2 = sigma * alpha + gamma_old * gamma * beta
        rho3 = sigma_old * beta
        live = live & (rho1 > 0)
        safe = np.where(live, rho1, 1)
        gamma_old, gamma, sigma_old, sigma = gamma, delta / safe, sigma, beta_new / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        x = x + np.where(live, gamma * eta, 0) * w
        eta = -sigma * eta
        v_old, v, beta = v, p / np.where(beta_new > 0, beta_new, 1), beta_new
        live = live & (beta_new > 0)
    return x


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What is new in the columns, orthonormal to the basis and each other; parallel ones fall out."""
    out = basis
    for column in new.T:
        before = np.linalg.norm(column)
        if not before > 0:
            continue
        column = column / before
        for _ in range(3):
            column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            out = np.column_stack([out, column])
    return out[:, basis.shape[1] :]


def jacobi_davidson(product: Product, d: int, want: int, block: int = BLOCK, inner: int = INNER, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` greatest eigenvalues, falling, and their eigenvectors (columns) of a symmetric non-negative d x d matrix.

    Fewer where the rest is zero to double precision. An eigenvalue of more copies than ``block``
    can hide some of them from the search, so that it begins anew from random vectors outside once enough pairs
    are locked, until such a search finds that the greatest value outside does not exceed them.
    """
    room = max(4 * want, want + 6 * block)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    search = _orthonormal(rng.standard_normal((d, min(d, block))), locked)
    image, size, found = product(search), 0.0, True  # found: something new since the last random vectors
    for _ in range(ROUNDS):
        small = search.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        search, image = search @ turn, image @ turn
        size = max([size, *theta[:1]])
        if search.shape[1] + locked.shape[1] >= d:  # nothing is outside: these pairs are exact
            locked, values = np.column_stack([locked, search]), np.append(values, theta)
            break
        residual = image - search * theta
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        if len(values) >= want and norms[0] <= 1e-7 * size and theta[0] <= np.sort(values)[-want] + 1e-7 * size:
            if not found:
                break
            search = _orthonormal(rng.standard_normal((d, block)), locked)
            image, found = product(search), False
            continue
        # from the top, as only what is above has nothing left to find
        good = int(np.argmin(np.append(norms <= TOLERANCE * np.sqrt(d) * size, False)))
        if good and len(values) < want:
            good = min(good, want - len(values))
            locked, values = np.column_stack([locked, search[:, :good]]), np.append(values, theta[:good])
            search, image, theta, residual = search[:, good:], image[:, good:], theta[good:], residual[:, good:]
        elif good:  # a copy that was hidden
            found = True
            locked, values = np.column_stack([locked, search[:, :1]]), np.append(values, theta[:1])
            search, image, theta, residual = search[:, 1:], image[:, 1:], theta[1:], residual[:, 1:]
        if d > room and search.shape[1] + 2 * block > room:  # restart from the best
            stay = max(block, min(room - 2 * block, want - len(values) + block))
            search, image = search[:, :stay], image[:, :stay]
        b = min(block, search.shape[1])
        new = np.zeros((d, 0))
        if b:
            held, shift = np.column_stack([locked, search[:, :b]]), theta[:b]
            away = lambda t, held=held: t - held @ (held.T @ t)
            new = minres(lambda t: away(product(away(t)) - away(t) * shift), -away(residual[:, :b]), inner)  # noqa: B023
        basis = np.column_stack([locked, search])
        new = _orthonormal(new, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, block)), basis)
        search, image = np.column_stack([search, new]), np.column_stack([image, product(new)])
    else:
        raise ArithmeticError(f"eigenvectors did not converge in {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")[:want]
    values, locked = values[order], locked[:, order]
    there = values > NO_VARIANCE * size
    return values[there], locked[:, there]


def whiten(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: float = 64.0,
) -> DataFrame:
    """Per row that takes part and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark, id_type = vectors.sparkSession, dict(vectors.dtypes)[vec_id]
    table = as_written(whole_numbers(vectors, vec_id, vector, scale).withColumn("d", F.size("x")), "whole-numbers")
    lengths = sorted((r.d, r.n) for r in table.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per length
    made = None
    for d, n in lengths:
        part = _one_length(table.filter(F.col("d") == d), d, n, vec_id, id_type, components)
        made = part if made is None else made.unionByName(part)
    schema = f"`{vec_id}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return spark.createDataFrame([], schema) if made is None else made


def _centred(table: DataFrame, d: int, n: int, id_type: str) -> DataFrame:
    """Matrices of (n * x - S) / n with their rows' ids and sums of squares of n * x - S."""
    spark = table.sparkSession
    each = [F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(d)]
    total = np.array([int(s) for s in table.agg(*each).first()], np.int64)
    sums = F.array(*[F.lit(int(s)) for s in total])
    exact = F.zip_with("x", sums, lambda x, s: F.lit(n) * x - s)
    deviation = F.aggregate(exact, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).cast("decimal(38,0)"))
    rows = table.select("id", exact.alias("x"), deviation.cast("bigint").alias("deviation"))

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy() / n
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column("id")), one(batch.column("deviation")), pa.array([x.tobytes()], pa.binary()), pa.array([d], pa.int32())],
                    ["ids", "deviations", "x", "d"],
                )

    with batches_of(spark, ROWS):
        return as_written(rows.mapInArrow(pack, f"ids array<{id_type}>, deviations array<bigint>, x binary, d int"), "centred")


def _one_length(table: DataFrame, d: int, n: int, vec_id: str, id_type: str, components: int) -> DataFrame:
    packed = _centred(table, d, n, id_type)

    def product(u: np.ndarray) -> np.ndarray:
        return _summed(packed, u.shape, lambda x: x.T @ (x @ u)) / n

    trace = float(_summed(packed, (1,), lambda x: np.array([(x * x).sum()]))[0]) / n
    values, axes = jacobi_davidson(product, d, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    turn = axes / np.sqrt(values)
    k = len(values)
    mean = _summed(packed, (k,), lambda x: (x @ turn).sum(0)) / n if k else np.zeros(0)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = x @ turn - mean
        return w.T @ w

    error = float(np.abs(_summed(packed, (k, k), covariance) / n - np.eye(k)).max()) if k else 0.0
    explained = values / trace if k else values

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, deviations = batch.column("ids")[i].values, batch.column("deviations")[i].values
                w = np.frombuffer(batch.column("x")[i].as_py()).reshape(-1, d) @ turn
                row = pa.array(np.repeat(np.arange(len(w)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), deviations.take(row),
                        pa.array(w.ravel()), pa.array(np.tile(explained, len(w))),
                    ],
                    ["id", "component", "deviation", "whitened", "explained"],
                )

    made = packed.mapInArrow(run, f"id {id_type}, component int, deviation bigint, whitened double, explained double")
    return made.select(
        F.col("id").alias(vec_id), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )
