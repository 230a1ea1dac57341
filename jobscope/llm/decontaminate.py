"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

The windows of all test items (``window`` consecutive words; an item of fewer
words, but not none, is one window) are the patterns of an automaton that every
task gets by broadcast. Each text is normalised once to ``' w1 w2 ... '`` and
scanned once; a match ends at a known word, so hits are word positions, which
are then mapped to character offsets of the original text.

The automaton is bounded: at most ``BLOCK_BYTES`` bytes of patterns.
A larger benchmark becomes several automata, each a broadcast of its own; a task
holds one of them at a time and takes its batch of texts through all, so texts are read once.

Defined results: a null text has no words; an item without words (or null) has
no window; the windows of an item without an id hit words like any other, but name
no item; equal windows of several items name all of them;
repeated rows are rows of their own; an empty benchmark or an empty table gives no hit. Columns
of any name pass through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import fresh, types_of

BLOCK_BYTES = 4 << 20
# word bytes: digits, letters, everything outside ASCII; A-Z become a-z
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _patterns(words: list[bytes], window: int) -> Iterator[tuple[bytes, int]]:
    size = min(window, len(words))
    if size:
        for k in range(len(words) - size + 1):
            yield b" " + b" ".join(words[k : k + size]) + b" ", size


def _automata(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[bytes]:
    """Pickled automata, each over at most ``block_bytes`` of patterns (one item at least)."""
    found: dict[bytes, tuple[int, set[str | None]]] = {}
    size = 0

    def built() -> bytes:
        made = ahocorasick.Automaton()
        for p, (n, ids) in found.items():
            made.add_word(p.decode("latin-1"), (n, sorted(ids, key=lambda x: (x is None, x))))
        made.make_automaton()
        return pickle.dumps(made)

    body = F.col(f"`{text}`")
    rows = items.filter(body.isNotNull()).select(F.col(f"`{item_id}`").cast("string"), body.cast("string")).toLocalIterator()
    for name, value in rows:
        for p, n in _patterns(value.encode().translate(NORMAL).split(), window):
            if p not in found:
                size += len(p)
                found[p] = (n, set())
            found[p][1].add(name)
        if size > block_bytes:
            yield built()
            found, size = {}, 0
    yield built()


def _runs(made, line: bytes) -> list[tuple[int, int, str | None]]:
    """(first word, word after the last, item) of every occurrence of a window."""
    out = []
    gaps = None
    for end, (n, names) in made.iter(line.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = int(np.searchsorted(gaps, end))
        out += [(last - n, last, x) for x in names]
    return out


def _describe(raw: bytes, n_words: int, runs: list[tuple[int, int, str | None]]) -> dict:
    if not runs:
        return {"n_words": n_words, "n_hit": 0, "item_ids": [], "spans": []}
    step = np.zeros(n_words + 1, np.int64)
    for a, b, _ in runs:
        step[a] += 1
        step[b] -= 1
    hit = np.cumsum(step[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    at = [m.span() for m in WORD.finditer(raw)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # of a byte offset
    spans = [
        {"start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]])}
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    ]
    return {"n_words": n_words, "n_hit": int(hit.sum()), "item_ids": sorted({x for *_, x in runs if x is not None}), "spans": spans}


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    out: str = "leak",
) -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with a struct column ``out``.

    n_words; n_hit, the words inside any occurrence of a window; item_ids, the
    items with such windows, sorted; spans, the hit stretches of the original
    text as character offsets, end excluded.
    """
    keep = docs.columns if keep is None else keep
    body, out = fresh("_text", keep), fresh(out, keep)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))
    shared = [docs.sparkSession.sparkContext.broadcast(raw) for raw in _automata(items, item_id, item_text, window, block_bytes)]
    schema = T.StructType([*[frame.schema[c] for c in keep], T.StructField(out, RESULT)])
    return frame.mapInArrow(_scan(shared, keep, body, types_of(schema)), schema)


def _scan(shared, keep, body, kinds):
    def run(batches):
        only = pickle.loads(shared[0].value) if len(shared) == 1 else None
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(body).to_pylist()]
            runs: list[list] = [[] for _ in texts]
            sizes = [0] * len(texts)
            for part in shared:
                made = only or pickle.loads(part.value)
                for i, raw in enumerate(texts):
                    split = raw.translate(NORMAL).split()
                    sizes[i] = len(split)
                    if split and len(made):
                        runs[i] += _runs(made, b" " + b" ".join(split) + b" ")
            found = [_describe(raw, n, r) for raw, n, r in zip(texts, sizes, runs, strict=True)]
            columns = [*[batch.column(c) for c in keep], pa.array(found, kinds.field(len(keep)).type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    out = fresh("_leak", docs.columns)
    return mark(docs, items, out=out, **options).filter(F.col(out)["n_hit"] == 0).drop(out)
