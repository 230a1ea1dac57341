"""Token counts that follow edits: a segment tree of pre-token counts per document.

``count_trees`` cuts each text into pre-tokens by the tokenizer's pattern and
counts each one's tokens (a pre-token is encoded once per task and looked up
after that). ``LEAF`` pre-tokens are a leaf: its length in code points and its tokens; the tree
above holds the sums of subtrees, so its root is the document's count.

``apply_edits`` changes the texts and re-encodes only the leaves an edit touches
plus boundary context: it starts at the last leaf border from which nothing
before can have looked at the edited place, and stops at the first old leaf border
behind the edit where a new pre-token begins as well; from there on the old
pre-tokens hold. Changed leaves are put in place and the sums above them updated;
a leaf that has grown beyond twice its size leads to a new tree over the leaves.

Defined results: a null text has no token and stays null, and edits of it do
nothing; an edit is (start, end, replacement) in code points of the text as it
was, clamped to the text; a null replacement is empty; edits are applied from the last to the first, and one that
overlaps a later one is cut where that begins; ties keep their order in the list; a null list or entry is no edit;
repeated rows are rows of their own. Columns of any name pass through.
"""

import base64
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import fresh, types_of

LEAF = 64
CONTEXT = 4  # code points a pre-token's end may have looked ahead, besides white space
KNOWN = 500_000  # pre-tokens remembered by a task
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
TREE = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("sums", T.ArrayType(T.IntegerType())),
])


class Counter:
    """Tokens of pre-tokens, from a file of ranks and the pattern that goes with it."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            new = list({p for p in pieces if p not in known})
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(set(pieces))
            encode = self.encoding.encode_ordinary
            for p in new:
                known[p] = len(encode(p))
            return [known[p] for p in pieces]

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Length and tokens of every leaf."""
        pieces = self.pattern.findall(text)
        if not pieces:
            return [], []
        at = np.arange(0, len(pieces), LEAF)
        return (
            np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at).tolist(),
            np.add.reduceat(np.array(self.counts(pieces)), at).tolist(),
        )


@lru_cache(maxsize=2)
def counter_of(ranks_path: str, pattern: str) -> Counter:
    """One counter per Python worker."""
    return Counter(ranks_path, pattern)


def tree_of(tokens: list[int]) -> list[int]:
    """Segment tree in an array: node i has the children 2i and 2i + 1, leaves are the last half."""
    n = len(tokens)
    sums = [0] * n + tokens
    for i in range(n - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return sums


def total(sums: list[int]) -> int:
    return sums[1] if len(sums) > 1 else 0


def _put(sums: list[int], leaf: int, tokens: int) -> None:
    i = leaf + len(sums) // 2
    change = tokens - sums[i]
    while i:
        sums[i] += change
        i //= 2


def _restart(text: str, borders: list[int], start: int) -> int:
    """The last leaf whose beginning no pre-token before it has looked past ``start`` from."""
    leaf = max(0, bisect_right(borders, start) - 1)
    while leaf:
        p = borders[leaf]
        if p + CONTEXT <= start and text[p : start].strip():
            return leaf
        leaf -= 1
    return 0


def edit(counter: Counter, text: str, lengths: list[int], sums: list[int], edits: list[tuple[int, int, str]]):
    """The edited text, its leaves' lengths, its tree, and how many code points were encoded again."""
    again = 0
    fence = len(text)
    for start, end, new in reversed(edits):
        start = min(max(0, start), fence)
        end = min(max(start, end), fence)
        fence = start
        borders = [0]
        for n in lengths:
            borders.append(borders[-1] + n)
        first = _restart(text, borders, start) if lengths else 0
        begin = borders[first] if lengths else 0
        text = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        # new pre-tokens until one ends at an old leaf border behind the edit
        last = bisect_left(borders, end + 1)
        pieces, at, stop = [], begin, len(lengths)
        while last < len(lengths) and borders[last] + shift <= begin:
            last += 1
        for m in counter.pattern.finditer(text, begin):
            at = m.end()
            pieces.append(m.group())
            while last < len(lengths) and borders[last] + shift < at:
                last += 1
            if last < len(lengths) and borders[last] + shift == at:
                stop = last
                break
        again += at - begin
        size = [len(p) for p in pieces]
        tokens = counter.counts(pieces)
        gone = stop - first
        if gone and gone * LEAF * 2 >= len(pieces) >= gone:
            # as many leaves as before: put the new sums in place
            sums = list(sums)
            cut = [len(pieces) * k // gone for k in range(gone + 1)]
            for k in range(gone):
                lengths[first + k] = sum(size[cut[k] : cut[k + 1]])
                _put(sums, first + k, sum(tokens[cut[k] : cut[k + 1]]))
        else:
            old = sums[len(sums) // 2 :]
            cut = range(0, len(pieces), LEAF)
            lengths[first:stop] = [sum(size[k : k + LEAF]) for k in cut]
            old[first:stop] = [sum(tokens[k : k + LEAF]) for k in cut]
            sums = tree_of(old)
    return text, lengths, sums, again


def _columns(batch, keep):
    return [batch.column(c) for c in keep]


def count_trees(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, out: str = "tree") -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with a struct: n_tokens, and the leaves and sums of the tree."""
    keep = docs.columns if keep is None else keep
    body, out = fresh("_text", keep), fresh(out, keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, TREE)])
    kinds = types_of(schema)

    def run(batches):
        counter = counter_of(ranks_path, pattern)
        for batch in batches:
            made = []
            for value in batch.column(body).to_pylist():
                lengths, tokens = counter.leaves(value or "")
                sums = tree_of(tokens)
                made.append({"n_tokens": total(sums), "lengths": lengths, "sums": sums})
            columns = [*_columns(batch, keep), pa.array(made, kinds.field(len(keep)).type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(body)).mapInArrow(run, schema)


def apply_edits(
    trees: DataFrame, edits: Column, ranks_path: str, pattern: str, text: str = "text", tree: str = "tree",
    keep: list[str] | None = None, out: str = "edited",
) -> DataFrame:
    """The rows of trees (columns ``keep``, by default all) with a struct: text, tree, n_encoded (code points encoded again).

    edits is an array of (start, end, replacement), sorted by start.
    """
    keep = trees.columns if keep is None else keep
    body, old, todo, out = (fresh(c, keep) for c in ("_text", "_tree", "_edits", out))
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("tree", TREE), T.StructField("n_encoded", T.LongType())])
    schema = T.StructType([*[trees.schema[c] for c in keep], T.StructField(out, result)])
    kinds = types_of(schema)

    def run(batches):
        counter = counter_of(ranks_path, pattern)
        for batch in batches:
            made = []
            rows = zip(*(batch.column(c).to_pylist() for c in (body, old, todo)), strict=True)
            for value, before, wanted in rows:
                if value is None:
                    made.append({"text": None, "tree": before, "n_encoded": 0})
                    continue
                wanted = sorted(((e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in wanted or [] if e), key=lambda e: e[0])
                new, lengths, sums, again = edit(counter, value, list(before["lengths"]), before["sums"], wanted)
                made.append({"text": new, "tree": {"n_tokens": total(sums), "lengths": lengths, "sums": sums}, "n_encoded": again})
            columns = [*_columns(batch, keep), pa.array(made, kinds.field(len(keep)).type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    rows = trees.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body), F.col(f"`{tree}`").alias(old), edits.cast(EDITS).alias(todo))
    return rows.mapInArrow(run, schema)
