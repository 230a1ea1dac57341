"""Toxicity by character n-grams: a linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (``SIZES`` code points) of its
distinct words, each word in lower case with a blank at both ends, hashed
into ``BITS`` bits; a feature is there or not.

1. Over all labelled rows, in Spark: in how many documents of either class each
   feature occurs. From that the log-count ratios r.
2. A logistic regression on features times r * |r|, over all features that training
   has, fitted by L-BFGS steps on sparse rows: at most
   ``max_rows`` distinct labelled texts (those of either class with the least
   hash: the documented bound of this sample), each as heavy as it has rows. Weights are
   w * r * |r|; a feature that none of those rows has gets the mean w.

A text's score is the logistic function of its features' weights; long texts are
worked off in pieces that end with a word.

Defined results: a null or empty text has no feature and gets the score of the
intercept; labels other than 0 and 1, and rows without a label or text, teach
nothing; repeated rows teach as often as they occur; without a row of both
classes every score is the share of class 1 (0 without any). Columns of any name pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm import textnum
from jobscope.llm.common import batches_of, counter_rows, fresh, remainder, sum_counters
from jobscope.session import as_written

BITS = 18
SIZES = (3, 4, 5)
MAX_ROWS = 20_000
THRESHOLD = 0.3
SMALL_LABELS = 1_000_000  # rows of 16 bytes
TEXTS = 2000  # texts of a batch
PSEUDO = 30.0  # rows that a feature's log-count ratio is smoothed by
PIECE = 1 << 18  # code points of a text that are looked at together
MULTIPLIER = np.uint64(0x100000001B3)
STEPS = 200
PARTS = 8  # of the sample
ROWS = 250  # of a batch of the sample
CLOSE = 1e-4  # greatest slope at the end, relative to the greatest weight


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: np.ndarray  # float32 by feature
    threshold: float = THRESHOLD


class _Grams:
    """Distinct features of texts, whose places are marked in an array that is used again and again."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, np.int32)

    def of(self, raw: str) -> np.ndarray:
        """The distinct features of a text."""
        words = raw.lower().split()
        found, begin, size = [], 0, 0
        for k, w in enumerate(words):
            size += len(w) + 1
            if size > PIECE:
                found.append(self._distinct(self._grams(words[begin : k + 1])))
                begin, size = k + 1, 0
        found.append(self._distinct(self._grams(words[begin:])))
        return found[0] if len(found) == 1 else self._distinct(np.concatenate(found))

    def _distinct(self, at: np.ndarray) -> np.ndarray:
        number = np.arange(len(at), dtype=np.int32)
        self.mark[at] = number  # the last of equal ones stays
        return at[self.mark[at] == number]

    def _grams(self, words: list[str]) -> np.ndarray:
        line = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        blank = line == 32
        found = []
        with np.errstate(over="ignore"):
            h, inner = line[: max(0, len(line) - 1)] * MULTIPLIER + line[1:], np.zeros(max(0, len(line) - 1), bool)
            for n in range(3, SIZES[-1] + 1):
                # one code point more; the last but one is now inside and must be no blank
                size = max(0, len(line) - n + 1)
                inner = inner[:size] | blank[n - 2 : n - 2 + size]
                h = h[:size] * MULTIPLIER + line[n - 1 :]
                if n in SIZES:
                    start = np.uint64(n * pow(int(MULTIPLIER), n, 1 << 64) % (1 << 64))
                    found.append((textnum.mix(h[~inner] + start) >> np.uint64(64 - BITS)).astype(np.int32))
        return np.concatenate(found)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, modulus: int, held_out: int) -> DataFrame:
    known = as_written(
        labels.filter(F.col(f"`{label}`").isin(0, 1) & (remainder(F.col(f"`{doc_id}`"), modulus) != held_out))
        .select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")),
        "labels",
    )
    rows = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # a checked size: texts stay where they are; beyond it both sides are shuffled
    if known.count() <= SMALL_LABELS:
        known = F.broadcast(known)
    return rows.join(known, "id").select("text", "y")


def _ratio(no: np.ndarray, yes: np.ndarray, n_no: float, n_yes: float) -> np.ndarray:
    """Log-count ratios; ``PSEUDO`` rows are shared as the classes are, so a feature without a row has 0 and one of few rows little."""
    n = n_no + n_yes
    return np.where(no + yes > 0, np.log((yes + PSEUDO * n_yes / n) / n_yes) - np.log((no + PSEUDO * n_no / n) / n_no), 0)


def _fit(cost, n: int, share: float, steps: int = STEPS) -> np.ndarray:
    """n weights and an intercept that cost(beta) -> (value, slope) is least at, by L-BFGS."""
    beta = np.zeros(n + 1)
    beta[n] = np.log(share / (1 - share))
    total, slope = cost(beta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(slope).max() < CLOSE * max(1.0, np.abs(beta).max()):
            break
        move, parts = slope.copy(), []
        for s, g, r in reversed(past):
            parts.append(r * (s @ move))
            move -= parts[-1] * g
        move *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, g, r), part in zip(past, reversed(parts), strict=True):
            move += (part - r * (g @ move)) * s
        length, down = 1.0, float(slope @ move)
        while True:
            new = beta - length * move
            new_total, new_slope = cost(new)
            if new_total <= total - 1e-4 * length * down or length < 1e-10:
                break
            length /= 2
        if new_total >= total:  # as exact as it gets
            break
        s, g = new - beta, new_slope - slope
        if s @ g > 0:
            past = [*past[-9:], (s, g, 1 / float(s @ g))]
        beta, total, slope = new, new_total, new_slope
    return beta


def _packed(features: np.ndarray) -> bytes:
    """Distinct features as the gaps between them, of two bytes where these suffice."""
    gaps = np.diff(np.sort(features), prepend=0)
    return b"\0" + gaps.astype("<u2").tobytes() if gaps.max(initial=0) < 1 << 16 else b"\1" + gaps.astype("<u4").tobytes()


def _unpacked(raw) -> np.ndarray:
    kind = "<u2" if raw[0:1].to_pybytes() == b"\0" else "<u4"
    return np.frombuffer(raw, kind, offset=1).cumsum(dtype=np.int32)


def _loss(batches, value: np.ndarray, intercept: float) -> Iterator[pa.RecordBatch]:
    """A task's logistic loss, and its slope by intercept and by feature's value; a row counts as often as it is there."""
    total, rows = np.zeros(len(value) + 2), 0
    for batch in batches:
        y, copies = (batch.column(c).to_numpy().astype(float) for c in ("y", "n"))
        spots = [_unpacked(raw.as_buffer()) for raw in batch.column("features")]
        z = intercept + np.array([value[at].sum() for at in spots])
        total[-1] += (copies * (np.logaddexp(0, z) - y * z)).sum()
        wrong = copies * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        total[-2] += wrong.sum()
        for at, w in zip(spots, wrong.tolist(), strict=True):
            total[at] += w  # features of a row are distinct
        rows += batch.num_rows
    if rows:
        slope = total[:-2].astype(np.float32).tobytes()  # half the bytes for the driver, added up there in full
        yield pa.RecordBatch.from_arrays([pa.array([total[-1]]), pa.array([total[-2]]), pa.array([slope], pa.binary())], ["loss", "wrong", "slope"])


def _learn(sample: DataFrame, scale: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic regression over the sample's rows; each step is one Spark job.

    A feature that no row has gets the mean weight of the others. The sample has ``PARTS``
    parts, and that many sums come to the driver at a step.
    """
    spark, n = sample.sparkSession, len(scale)
    yes, rows = sample.agg(F.sum(F.col("y") * F.col("n")), F.sum("n")).first()

    def cost(beta):
        shared, intercept = spark.sparkContext.broadcast(beta[:n] * scale), float(beta[n])
        # Arrow batches pass through the driver's JVM as they are; rows would be there four times
        made = sample.mapInArrow(lambda batches: _loss(batches, shared.value, intercept), "loss double, wrong double, slope binary").toArrow()
        slope = np.zeros(n + 1)
        for raw in made.column("slope"):
            slope[:n] += np.frombuffer(raw.as_buffer(), np.float32)
        slope[:n] *= scale
        slope[:n] += ridge * beta[:n]
        slope[n] = sum(made.column("wrong").to_pylist())
        shared.destroy()
        return sum(made.column("loss").to_pylist()) + 0.5 * ridge * float(beta[:n] @ beta[:n]), slope

    beta = _fit(cost, n, yes / rows)

    def seen(batches):
        there, rows = np.zeros(n, bool), 0
        for batch in batches:
            for raw in batch.column("features"):
                there[_unpacked(raw.as_buffer())] = True
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(there).tobytes()], pa.binary())], ["bits"])

    there = np.zeros(n, bool)
    for r in sample.mapInArrow(seen, "bits binary").collect():
        there |= np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=n).astype(bool)
    return float(beta[n]), np.where(there, beta[:n], beta[:n][there].mean() if there.any() else 0.0)


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """y, n (number of rows), features of distinct labelled texts: all, or max_rows of them, both classes with their share."""
    keyed = rows.withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit("text"), "text")})
    known = as_written(keyed.groupBy("y", "a", "b").agg(F.count(F.lit(1)).alias("n")), "labelled-texts")
    distinct = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    room = dict(distinct)
    if sum(distinct.values()) > max_rows:
        room[1] = min(max(1, round(max_rows * distinct[1] / sum(distinct.values()))), max_rows - 1)
        room[0] = max_rows - room[1]
    chosen = [known.filter(F.col("y") == y).orderBy("a", "b").limit(n) for y, n in room.items()]
    chosen = as_written(chosen[0].unionByName(chosen[1]), "training-texts")  # the documented bound

    def describe(batches):
        grams, done = _Grams(), set()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("y", "a", "b")), strict=True))
            new = []
            for i, k in enumerate(keys):
                if k not in done:  # copies of a text are described once
                    done.add(k)
                    new.append(i)
            found = [_packed(grams.of(batch.column("text")[i].as_py())) for i in new]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(new, pa.int64())) for c in ("y", "a", "b", "n")], pa.array(found, pa.binary())], ["y", "a", "b", "n", "features"]
            )

    described = (
        keyed.join(F.broadcast(chosen), ["y", "a", "b"]).select("y", "a", "b", "n", "text")
        .mapInArrow(describe, "y int, a bigint, b bigint, n bigint, features binary").dropDuplicates(["y", "a", "b"])
    )
    with batches_of(rows.sparkSession, TEXTS):
        return as_written(described.select("y", "n", "features").repartition(PARTS), "training-features")


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    modulus: int = 4,
    held_out: int = 2,
    max_rows: int = MAX_ROWS,
) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod modulus is not held_out."""
    rows = _labelled(docs, labels, doc_id, text, label, modulus, held_out)
    width = 1 << BITS

    def count(batches):
        grams, total = _Grams(), np.zeros(2 * width + 2, np.uint32)
        for batch in batches:
            for raw, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                total[grams.of(raw.as_py()) + y * width] += 1
                total[2 * width + y] += 1
        yield counter_rows(total)

    with batches_of(docs.sparkSession, TEXTS):
        total = sum_counters(rows.mapInArrow(count, "block int, counts binary"), 2 * width + 2).astype(float)
    no, yes = total[2 * width], total[2 * width + 1]
    if not no or not yes:
        return Model(30.0 if yes else -30.0, np.zeros(width, np.float32))
    q, p = total[:width], total[width : 2 * width]
    ratio = _ratio(q, p, no, yes)
    scale = ratio * np.abs(ratio)
    sample = _sample(rows, max_rows)
    with batches_of(docs.sparkSession, ROWS):
        intercept, weights = _learn(sample, scale)
    return Model(intercept, (weights * scale).astype(np.float32))


def _scores(model: Model):
    """A function from the texts of batches to their scores."""
    intercept, weights = model.intercept, model.weights

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = _Grams()
        for batch in texts:
            made = np.array([intercept + float(weights[grams.of(raw.as_py() or "")].sum(dtype=float)) for raw in batch], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(made, -500, 500))), pa.float64())

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with the score, 0 to 1."""
    keep = docs.columns if keep is None else keep
    return docs.select(*[F.col(f"`{c}`") for c in keep], _scores(model)(F.col(f"`{text}`")).alias(fresh(out, keep)))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that score below the model's threshold, columns as they came.

    Only texts go to Python and only scores come back: a worker holds a batch of texts once.
    """
    return docs.filter(_scores(model)(F.col(f"`{text}`")) < model.threshold)
