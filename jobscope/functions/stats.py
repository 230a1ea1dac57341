"""p-values of the peak test, as -log10 so that nothing underflows.

The chi-square tail is plain Column arithmetic. Only the exact test needs
Python: its terms are summed for all rows of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NEG_LOG10 = 400.0
SPLIT = 2.0  # below: series, above: continued fraction
TERMS = 80
CELLS = 1 << 20  # terms of the exact test held at a time


def _down() -> Column:
    return F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))


def _near(square: Column) -> Column:
    """1 - erf(z) by the series of positive terms, for z**2 up to SPLIT**2."""
    total = F.aggregate(_down(), F.lit(1.0), lambda inner, n: 1.0 + inner * square * 2.0 / (2 * n + 1))
    return F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.sqrt(square) * F.exp(-square) * total


def _far_factor(square: Column) -> Column:
    """sqrt(pi) * exp(z**2) * (1 - erf(z)) by its continued fraction, inverted."""
    z = F.sqrt(square)
    return F.aggregate(_down(), z, lambda inner, n: z + n / 2 / inner)


def chi2_neg_log10(chi2: Column) -> Column:
    """-log10 of the upper tail of the chi-square distribution with one degree of freedom."""
    square = F.greatest(chi2.cast("double"), F.lit(0.0)) / 2
    edge = F.lit(SPLIT * SPLIT)
    far = F.greatest(square, edge)
    beyond = far / math.log(10) + F.log10(F.lit(math.sqrt(math.pi)) * _far_factor(far))
    within = -F.log10(_near(F.least(square, edge)))
    return F.when(chi2.isNull(), None).when(square > edge, beyond).otherwise(F.greatest(within, F.lit(0.0)))


def chi2_pvalue(chi2: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return F.pow(F.lit(10.0), -chi2_neg_log10(chi2))


def _tails(w: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """-log10 p of several tables: their terms lie one table after the other in one array."""
    n, row, col = w + x + y + z, w + x, w + y
    low, high = np.maximum(0, row + col - n), np.minimum(row, col)
    size = (high - low + 1).astype(np.int64)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(w)), size)
    k = np.arange(int(size.sum())) - begin[of] + low[of]
    # log of the ratio of neighbouring terms, added up from the first one
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(row[of] - k + 1) + np.log(col[of] - k + 1) - np.log(k) - np.log((n - row - col)[of] + k)
    ratio[begin] = 0.0
    log_p = np.cumsum(ratio)
    log_p -= log_p[begin][of]
    top = np.maximum.reduceat(log_p, begin)
    total = top + np.log(np.add.reduceat(np.exp(log_p - top[of]), begin))
    here = log_p[begin + (w - low).astype(np.int64)]
    mine = log_p <= here[of] + 1e-7
    tail = np.add.reduceat(np.where(mine, np.exp(np.minimum(log_p - here[of], 1.0)), 0.0), begin)
    return np.maximum(0.0, (total - here - np.log(tail)) / math.log(10))


@F.pandas_udf(T.DoubleType())
def _fisher_neg_log10(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = [s.to_numpy(dtype="float64", na_value=np.nan) for s in (a, b, c, d)]
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero(~np.isnan(sum(cells)))
    w, x, y, z = (s[rows] for s in cells)
    terms = np.cumsum(np.minimum.reduce([w + x, w + y, x + z, y + z]) + 1)
    block = (terms // CELLS).astype(np.int64)
    for i in np.unique(block):
        at = block == i
        out[rows[at]] = _tails(w[at], x[at], y[at], z[at])
    return pd.Series(out).astype("Float64").where(~np.isnan(out))


def fisher_neg_log10(a: Column, b: Column, c: Column, d: Column) -> Column:
    """-log10 p of the two-sided exact test of a 2x2 table (a b / c d)."""
    return _fisher_neg_log10(*[x.cast("bigint") for x in (a, b, c, d)])


def fisher_pvalue(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact test of a 2x2 table (a b / c d)."""
    return F.pow(F.lit(10.0), -fisher_neg_log10(a, b, c, d))


def neg_log10(p: Column) -> Column:
    return F.when(p <= 0, F.lit(MAX_NEG_LOG10)).otherwise(F.least(-F.log10(p), F.lit(MAX_NEG_LOG10)))
