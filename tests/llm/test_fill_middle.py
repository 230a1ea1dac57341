"""Fill-in-the-middle: the rank index against all offsets, exact round trips, the draws of the contract."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobscope.llm import fill_middle

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


@given(st.text("ab\n<P>é😀", max_size=200), st.sampled_from([0.5, 3, 32]))
def test_index_is_exact(text, error):
    offsets = np.cumsum([0, *[len(u) for u in UNITS.findall(text)]])
    assert (fill_middle.boundaries(text) == offsets).all()
    index = fill_middle.fit(offsets, error)
    assert [index.at(k) for k in range(len(offsets))] == offsets.tolist()
    assert np.abs(index.residual).max() <= error + 1


def test_index_of_long_texts():
    rng = np.random.default_rng(4)
    for sizes in (np.full(30_000, 80), rng.integers(1, 400, 30_000), np.r_[np.full(9000, 5), 10**6, np.full(9000, 70)]):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        index = fill_middle.fit(offsets)
        some = [0, 1, 255, 256, 257, 8999, 9000, 9001, len(sizes)]
        assert [index.at(k) for k in some] == offsets[some].tolist()
        assert np.abs(index.residual).max() <= fill_middle.ERROR + 1
    assert len(fill_middle.fit(np.arange(0, 80 * 30_000, 80)).first) == 1  # equal lines are one piece


def _plain(doc_id, text):
    """The contract, written out."""
    units = UNITS.findall(text or "")
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, body = len(units), text or ""
    if not body or any(m in body for m in ("<P>", "<S>", "<M>")):
        return n, "plain", body, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.fixture
def docs(spark):
    r = random.Random(3)
    texts = [None, "", "\n", "one line", "a\nb", "has <P> in it\n", "<", "<S", "M>\n<\n", "\n\n\n", "é😀\n" * 5, "line of a long text\n" * 40_000]
    texts += ["".join(r.choice("ab \n<>PSM😀") for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (4, "other\ntext\n", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fim string").withColumn("_draws", F.lit(1))


def test_transform_and_restore(docs):
    made = fill_middle.transform(docs)
    assert made.columns == [*docs.columns, "fim_"]
    rows = made.withColumn("back", fill_middle.restore(F.col("fim_.text"), F.col("fim_.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r.fim_) == _plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.fim_.form for r in rows} == {"plain", "psm", "spm"}
    again = {(r.doc_id, r.text): r.fim_ for r in fill_middle.transform(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.text): r.fim_ for r in rows}


def test_rates(docs):
    assert {r.fim_.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.fim_.form for r in fill_middle.transform(docs, spm_rate=100).collect()} == {"plain", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0
