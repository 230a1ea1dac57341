"""Fill-in-the-middle documents, cut at lines through a learned rank index.

A text's units are its lines with their ends (``[^\\n]*\\n|[^\\n]+``). The index answers
at which code point the first k units end, for every k:

1. All boundary offsets of the text are fitted by pieces: a piece begins exactly at a boundary
   and runs as far as one slope keeps every offset within ``ERROR`` code points.
2. A cut at rank k looks up its piece, predicts start + slope * (k - first) and adds the stored
   residual of that rank, a small whole number. That is exact.

``transform`` draws two ranks per document from sha256(seed:id), cuts prefix, middle and suffix
there and writes them in one of two orders (psm, spm) with the marks ``MARKS``; ``restore``
is the exact inverse. Cuts depend on the id and the text only, so reruns and lost tasks give the same rows.

Defined results: a null text is an empty one; an empty text, one that holds a mark, or one
that the rate leaves out stays as it is (plain); a null id draws as the empty string does; rows that
repeat an id draw the same numbers; an empty table gives an empty one. Columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm import textnum
from jobscope.llm.common import fresh, types_of

MARKS = ("<P>", "<S>", "<M>")
ERROR = 32  # code points that a prediction may be off by, before its residual
WINDOW = 256  # ranks that a piece is tried on at first
SLICE = 1 << 22  # bytes of text worked on together


@dataclass(frozen=True)
class RankIndex:
    """Pieces (first rank, its offset, slope) and the residual of every rank."""

    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def at(self, rank: int) -> int:
        """The offset after ``rank`` units."""
        k = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.offset[k]) + int(np.rint(self.slope[k] * (rank - self.first[k]))) + int(self.residual[rank])


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, after 0, 1, ... n units."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    open_end = [len(codes)] if len(codes) and codes[-1] != 10 else []
    return np.concatenate([[0], ends, open_end]).astype(np.int64)


def fit(offsets: np.ndarray, error: float = ERROR) -> RankIndex:
    """Pieces as long as the error allows, one after the other."""
    first, slopes = [], []
    n, at = len(offsets), 0
    while at < n:
        window, slope, end = WINDOW, 0.0, at + 1
        while end < n:
            steps = np.arange(1, min(window, n - at - 1) + 1)
            rise = (offsets[at + 1 : at + 1 + len(steps)] - offsets[at]).astype(float)
            low = np.maximum.accumulate((rise - error) / steps)
            high = np.minimum.accumulate((rise + error) / steps)
            fits = int(np.searchsorted(low > high, True))  # once the cone is empty it stays so
            end = at + 1 + fits
            slope = (low[fits - 1] + high[fits - 1]) / 2 if fits else 0.0
            if fits < len(steps) or end == n:
                break
            window *= 2
        first.append(at)
        slopes.append(slope)
        at = end
    first, slope = np.array(first, np.int64), np.array(slopes)
    ranks = np.arange(n)
    piece = np.searchsorted(first, ranks, "right") - 1
    predicted = offsets[first][piece] + np.rint(slope[piece] * (ranks - first[piece])).astype(np.int64)
    residual = offsets - predicted
    small = np.int8 if np.abs(residual).max(initial=0) < 128 else np.int64
    return RankIndex(first, offsets[first], slope, residual.astype(small))


def _draws(doc_id: Column, seed: int) -> Column:
    """The first four groups of eight hex digits of sha256(seed:id), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def _write(text: str, draws: list[int], rate: int, spm_rate: int, error: float) -> tuple:
    """n, form, text, prefix_chars, middle_chars."""
    index = fit(boundaries(text), error)
    n = len(index.residual) - 1
    if not text or any(m in text for m in MARKS) or draws[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    one, two = index.at(a), index.at(b)
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    p, s, m = MARKS
    if draws[3] % 100 < spm_rate:
        return n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", one, two - one
    return n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", one, two - one


MADE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
])


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    out: str = "fim",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    error: float = ERROR,
) -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with a struct column ``out``.

    n (units), form (plain, psm, spm), text (as written), prefix_chars, middle_chars (null if plain).
    ``rate`` of 100 documents are cut, ``spm_rate`` of 100 of these with the suffix first.
    """
    keep = docs.columns if keep is None else keep
    out = fresh(out, keep)
    body, draws = fresh("_text", keep), fresh("_draws", keep)
    frame = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body), _draws(F.col(f"`{doc_id}`"), seed).alias(draws),
    )
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, MADE)])
    kinds, fields = types_of(schema), types_of(MADE)

    def run(batches):
        for whole in batches:
            for i, j in textnum.Buffer(whole.column(body)).slices(SLICE):
                batch = whole.slice(i, j - i)
                rows = zip(batch.column(body).to_pylist(), batch.column(draws).to_pylist(), strict=True)
                made = [_write(t, d, rate, spm_rate, error) for t, d in rows]
                parts = [pa.array([r[k] for r in made], f.type) for k, f in enumerate(fields)]
                columns = [*[batch.column(c) for c in keep], pa.StructArray.from_arrays(parts, names=fields.names)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return frame.mapInArrow(run, schema)


def restore(written: Column, form: Column) -> Column:
    """The text that ``transform`` wrote. No part holds a mark, so each mark's first place is its own."""
    size = len(MARKS[0])

    def after(text: Column, part: Column) -> Column:
        return F.substr(text, F.char_length(part) + F.lit(size + 1))

    body = F.substr(written, F.lit(size + 1))
    one = F.when(form == "psm", F.substring_index(body, MARKS[1], 1)).otherwise(F.substring_index(body, MARKS[0], 1))
    rest = after(body, one)
    two = F.substring_index(rest, MARKS[2], 1)
    middle = after(rest, two)
    return F.when(form == "plain", written).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
