"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

1. ``describe``: every whole text becomes ``STATISTICS`` numbers (lengths, shares of kinds of
   characters and of what follows what, repeated words, word triples, sentences and lines). Texts are read once;
   training and scoring both use the written table of statistics.
2. Statistics are standardised by the training rows. ``FEATURES`` random cosines approximate a
   Gaussian kernel on them (Rahimi and Recht).
3. Each partition adds up its normal equations, per fold of the rows; Spark adds the partitions.
   The sums give the ridge weights, and also every penalty's exact cross-validation error, so
   the penalty needs no further pass.
4. Scores of rows by the model of the other folds are counted in ``BINS`` equal bins with their labels;
   pool-adjacent-violators over the bins gives the isotonic map to 0..1. Between the pools' centres it is
   linear, so that scores keep their order.

All labelled rows are used; what the driver gets (the sums and the bins) is of fixed size.

Defined results: a null or empty text has the statistics of an empty text and is scored like
any other; labels other than 0 and 1, and rows without a label or without an id, teach nothing; a repeated row
teaches as often as it occurs, a label row per document row too; with training rows of one class only, every score is
that class (0 without any); an empty table gives an empty one. Columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm import textnum
from jobscope.llm.common import fresh, remainder, summed, types_of
from jobscope.session import as_written

FEATURES = 512
WIDTH = 1.0  # of the kernel, in root mean square distances of statistics
FOLDS = 5
PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)  # a row
BINS = 4096
LOWEST, HIGHEST = -1.0, 2.0  # raw scores beyond fall into the outer bins
SLICE = 1 << 20
THRESHOLD = 0.5

# kinds of bytes: fixed values
KINDS = ["space", "line", "lower", "upper", "digit", "stop", "mark", "symbol", "other"]
KIND = np.full(256, 7, np.uint8)
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
KIND[0x0A] = 1
KIND[97:123], KIND[65:91], KIND[48:58] = 2, 3, 4
KIND[[ord(c) for c in ".!?"]] = 5
KIND[[ord(c) for c in ",;:'\"()-"]] = 6
KIND[0x80:] = 8
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
LINE_END = np.zeros(256, bool)
LINE_END[0x0A] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[0x0A, *map(ord, ".!?")]] = True
N_KINDS = len(KINDS)
N_STATISTICS = 2 * N_KINDS + N_KINDS * N_KINDS + 14


def _repeats(row: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of keys, of distinct keys, and how often its most frequent key is there."""
    total = np.bincount(row, minlength=n).astype(float)
    with np.errstate(over="ignore"):
        mixed = textnum.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, count = np.unique(mixed, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, row[first], count)
    return total, np.bincount(row[first], minlength=n).astype(float), most


def statistics(buf: textnum.Buffer) -> np.ndarray:
    """A row of numbers for every text."""
    n, edges = len(buf), buf.offsets
    kinds, pairs = np.zeros((n, N_KINDS)), np.zeros((n, N_KINDS * N_KINDS))
    letters, square, chars = np.zeros(n), np.zeros(n), np.zeros(n)
    for a, b in textnum._segments(buf.data, edges, textnum.SPACE):
        raw = buf.data[a:b]
        row = np.searchsorted(edges, np.arange(a, b, dtype=np.int64), "right") - 1
        kind = KIND[raw].astype(np.int64)
        kinds += np.bincount(row * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS)
        chars += np.bincount(row, weights=(raw & 0xC0) != 0x80, minlength=n)
        same = row[1:] == row[:-1]
        pair = (row[1:] * N_KINDS + kind[:-1]) * N_KINDS + kind[1:]
        pairs += np.bincount(pair[same], minlength=n * N_KINDS * N_KINDS).reshape(n, -1)
        # words: runs of what is not white space, and whether they have a letter
        word = ~textnum.SPACE[raw]
        word_start = word & np.concatenate([[True], ~word[:-1] | ~same])
        number = np.cumsum(word_start) - 1
        size = np.bincount(number[word])
        has = np.bincount(number[word], weights=LETTER[raw[word]]) > 0
        of = row[word_start]
        square += np.bincount(of, weights=size.astype(float) ** 2, minlength=n)
        letters += np.bincount(of, weights=has, minlength=n)
    counts, hashes = textnum.words(buf)
    row = np.repeat(np.arange(n), counts)
    words, distinct, most = _repeats(row, hashes, n)
    with np.errstate(over="ignore"):
        triple = (hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes[2:]
    whole = row[:-2] == row[2:]
    triples, distinct_triples, _ = _repeats(row[:-2][whole], triple[whole], n)
    line_counts, line_hashes = textnum.words(buf, LINE_END)
    lines, distinct_lines, _ = _repeats(np.repeat(np.arange(n), line_counts), line_hashes, n)
    counts, hashes = textnum.words(buf, SENTENCE_END)
    sentences, distinct_sentences, _ = _repeats(np.repeat(np.arange(n), counts), hashes, n)
    size = np.diff(edges).astype(float)
    share = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
    length = share(size - kinds[:, 0] - kinds[:, 1], words)
    spread = np.sqrt(np.maximum(share(square, words) - length**2, 0))
    rates = kinds / np.maximum(size, 1)[:, None]
    return np.column_stack([
        rates, np.sqrt(rates), np.sqrt(pairs / np.maximum(size, 1)[:, None]),
        np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(length), np.log1p(spread),
        share(letters, words), share(distinct, words), share(most, words), share(distinct_triples, triples),
        share(distinct_lines, lines), share(distinct_sentences, sentences), np.log1p(share(words, sentences)), np.log1p(share(words, lines)),
        share(chars, size),
    ])


def describe(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "statistics") -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with their statistics, floats packed in a binary."""
    keep = docs.columns if keep is None else keep
    body, out = fresh("_text", keep), fresh(out, keep)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.BinaryType())])
    kinds = types_of(schema)

    def run(batches):
        for whole in batches:
            buf = textnum.Buffer(whole.column(body))
            for i, j in buf.slices(SLICE):
                made = statistics(buf.rows(i, j)).astype(np.float32)
                columns = [*[whole.column(c).slice(i, j - i) for c in keep], pa.array([x.tobytes() for x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return frame.mapInArrow(run, schema)


def _unpack(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), N_STATISTICS).astype(float)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # the last one is the intercept
    knots: np.ndarray  # raw scores, rising
    values: np.ndarray  # and what they are calibrated to

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) * self.scale, -8, 8)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([cosines, np.ones(len(z))])

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(statistics) @ self.weights, self.knots, self.values), 0, 1)


def pools(positive: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins: (mean bin, share of label 1) of every pool, both rising."""
    made: list[list[float]] = []  # rows, positives, sum of bins
    for k in np.flatnonzero(rows):
        made.append([rows[k], positive[k], rows[k] * k])
        while len(made) > 1 and made[-2][1] * made[-1][0] >= made[-1][1] * made[-2][0]:
            last = made.pop()
            made[-1] = [x + y for x, y in zip(made[-1], last, strict=True)]
    return np.array([m[2] / m[0] for m in made]), np.array([m[1] / m[0] for m in made])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1).astype(np.int64)


def train(
    described: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    statistics: str = "statistics",
    label: str = "quality",
    modulus: int = 3,
    held_out: int = 1,
    features: int = FEATURES,
    seed: int = 11,
) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod modulus is not held_out."""
    y = F.col(f"`{label}`")
    known = (
        labels.filter(y.isin(0, 1) & (remainder(F.col(f"`{doc_id}`"), modulus) != held_out))
        .groupBy(F.col(f"`{doc_id}`").alias("id"))
        .agg(F.count_if(y == 1).cast("double").alias("yes"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    rows = as_written(
        described.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{statistics}`").alias("x")).join(known, "id")
        .select("x", "yes", "n", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")),  # copies are in one fold
        "quality-rows",
    )
    columns = ("x", "yes", "n", "fold")

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                x, *rest = (batch.column(c) for c in columns)
                yield _unpack(x), *[c.to_numpy() for c in rest]

    def moments(batches):
        total = np.zeros(2 * N_STATISTICS + 2)
        for x, yes, n, _ in each(batches):
            total += np.concatenate([n @ x, n @ x**2, [n.sum(), yes.sum()]])
        return total

    total = summed(rows, moments, (2 * N_STATISTICS + 2,))
    n, yes = total[-2:]
    mean = total[:N_STATISTICS] / max(n, 1)
    variance = total[N_STATISTICS:-2] / max(n, 1) - mean**2
    spread = np.sqrt(np.maximum(variance, 0))
    live = spread > 1e-4
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((N_STATISTICS, features)) / (WIDTH * np.sqrt(2 * max(1, live.sum())))
    blank = Model(
        mean, np.where(live, 1 / np.where(live, spread, 1), 0), directions, rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.zeros(1), np.array([float(n > 0 and yes == n)]),
    )
    if not 0 < yes < n:
        return blank
    weights, by_fold = _ridge(rows, each, blank, features + 1, n)
    return _calibrated(rows, each, blank, weights, by_fold)


def _ridge(rows: DataFrame, each, blank: Model, width: int, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights over all rows, and without each fold, at the penalty of the least cross-validation error."""
    upper = np.triu_indices(width)
    size = len(upper[0]) + width + 1

    def equations(batches):
        total = np.zeros((FOLDS, size))
        for x, yes, n, fold in each(batches):
            z = blank.features(x)
            for f in np.unique(fold):
                mine = fold == f
                part, w = z[mine], n[mine]
                total[f] += np.concatenate([(part.T * w @ part)[upper], yes[mine] @ part, [yes[mine].sum()]])
        return total

    total = summed(rows, equations, (FOLDS, size))
    square = np.zeros((FOLDS, width, width))
    square[:, upper[0], upper[1]] = total[:, : len(upper[0])]
    square[:, upper[1], upper[0]] = total[:, : len(upper[0])]
    side = total[:, len(upper[0]) : -1]
    free = np.ones(width)
    free[-1] = 0  # the intercept has no penalty

    def solve(a, b, penalty):
        return np.linalg.solve(a + np.diag(free * penalty * n + 1e-9), b)

    best = None
    for penalty in PENALTIES:
        made = np.array([solve(square.sum(0) - square[f], side.sum(0) - side[f], penalty) for f in range(FOLDS)])
        error = sum(w @ a @ w - 2 * w @ b for w, a, b in zip(made, square, side, strict=True))
        if best is None or error < best[0]:
            best = error, penalty, made
    return solve(square.sum(0), side.sum(0), best[1]), best[2]


def _calibrated(rows: DataFrame, each, blank: Model, weights: np.ndarray, by_fold: np.ndarray) -> Model:
    """The model with the isotonic map of out-of-fold scores."""

    def count(batches):
        total = np.zeros((2, BINS))
        for x, yes, n, fold in each(batches):
            spot = _bin((blank.features(x) * by_fold[fold]).sum(1))
            total += [np.bincount(spot, weights=w, minlength=BINS) for w in (yes, n)]
        return total

    total = summed(rows, count, (2, BINS))
    spots, values = pools(total[0], total[1])
    knots = LOWEST + (spots + 0.5) / BINS * (HIGHEST - LOWEST)
    return Model(blank.mean, blank.scale, blank.directions, blank.phases, weights, knots, values)


def score(described: DataFrame, model: Model, statistics: str = "statistics", out: str = "score") -> DataFrame:
    """The rows of a described table with the score, 0 to 1, in place of the statistics."""
    keep = [c for c in described.columns if c != statistics]
    out = fresh(out, keep)
    schema = T.StructType([*[described.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    kinds = types_of(schema)

    def run(batches):
        for batch in batches:
            made = model.score(_unpack(batch.column(statistics))) if batch.num_rows else np.zeros(0)
            columns = [*[batch.column(c) for c in keep], pa.array(made, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return described.mapInArrow(run, schema)
