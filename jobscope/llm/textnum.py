"""Words of many texts at once, as numpy arrays over one byte buffer.

``Buffer`` holds the UTF-8 bytes of an Arrow string column; ``words`` finds the
maximal runs of word bytes of every text and gives each a 64-bit hash. Nothing
is looked at per character in Python. Work goes in segments of a few MB that
end between words, so memory follows the segment, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (splitmix64's last steps)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Buffer:
    """Bytes of a string column; null is an empty text."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        n, kind = len(column), np.int64 if pa.types.is_large_string(column.type) else np.int32
        # the offsets are copied, the bytes are not
        self.offsets = (
            np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        )
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def rows(self, i: int, j: int) -> "Buffer":
        """Some of the texts, over the same bytes."""
        part = object.__new__(Buffer)
        part.offsets, part.data = self.offsets[i : j + 1], self.data
        return part

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def slices(self, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows of about ``limit`` bytes; one row at least."""
        i, n = 0, len(self)
        while i < n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), n)
            yield i, j
            i = j


def _segments(data: np.ndarray, edges: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut [edges[0], edges[-1]) between words, at a text's end where possible."""
    at, end = int(edges[0]), int(edges[-1])
    while at < end:
        stop = min(at + SEGMENT, end)
        if stop < end:
            k = int(edges[np.searchsorted(edges, stop, "right") - 1])
            if k > at:
                stop = k
            else:  # inside one long text
                limit = int(edges[np.searchsorted(edges, stop, "right")])
                back = np.flatnonzero(space[data[at:stop]])
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    while stop < limit and not space[data[stop]]:
                        stop += 1
        yield at, stop
        at = stop


def words(buf: Buffer, space: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and all words' hashes in order."""
    edges = buf.offsets
    counts = np.zeros(len(buf), np.int64)
    out: list[np.ndarray] = []
    for a, b in _segments(buf.data, edges, space):
        raw = buf.data[a:b]
        text = LOWER[raw] if lower else raw
        word = ~space[text]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b, "left")] - a
        inner = np.unique(inner)
        first[inner] |= word[inner]  # a text's end ends a word
        last[inner - 1] |= word[inner - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_CODE[text] * up[: len(raw)], out=total[1:])
            h = (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)
        out.append(mix(h))
        # the row of a word: the last text that begins at or before it and is not empty
        row = np.searchsorted(edges, start + a, "right") - 1
        np.add.at(counts, row, 1) if len(row) < 64 else counts.__iadd__(np.bincount(row, minlength=len(counts)))
    return counts, np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(counts: np.ndarray, hashes: np.ndarray, n: int, weights: np.ndarray | None = None) -> Iterator:
    """Per text: the sorted distinct hashes of n consecutive words, and the sums of their words' weights, if given.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    with np.errstate(over="ignore"):
        size = max(0, len(hashes) - n + 1)
        gram, weight = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        for k in range(n):
            gram = gram * np.uint64(_BASE) + hashes[k : k + size]
            if weights is not None:
                weight += weights[k : k + size]
        gram = mix(gram + np.uint64(n))
        at = 0
        for c in counts.tolist():
            if c >= n:
                here = gram[at : at + c - n + 1]
                if weights is None:
                    yield np.unique(here), None
                else:
                    tokens, first = np.unique(here, return_index=True)
                    yield tokens, weight[at : at + c - n + 1][first]
            elif c:
                h = np.uint64(0)
                for x in hashes[at : at + c]:
                    h = h * np.uint64(_BASE) + x
                yield mix(np.array([h + np.uint64(c)])), np.zeros(1, np.int32)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int32)
            at += c
