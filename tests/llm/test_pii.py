"""Surrogates: bijections on whole formats, formats that the data fill, check digits, texts with the marks."""

import re

import pytest
from pyspark.sql import functions as F

from jobscope.llm import pii


def test_addresses_that_fill_their_format(spark):
    """All 10 000 addresses of one-digit octets: no free place, so they change places with each other, at once."""
    frame = spark.range(10_000).select(F.concat_ws(".", *[F.expr(f"id div {10**k} % 10") for k in range(4)]).alias("text"))
    made = pii.entities(frame, "k").collect()
    assert len(made) == 10_000 == len({r.made for r in made}) and {r.made for r in made} == {r.entity for r in made}
    assert all(r.made != r.entity for r in made)


def test_nearly_full_format(spark):
    frame = spark.range(10_000).filter("id % 10 < 9").select(F.concat_ws(".", *[F.expr(f"id div {10**k} % 10") for k in range(4)]).alias("text"))
    made = pii.entities(frame, "k").collect()
    real = {r.entity for r in made}
    assert len(real) == 9000 == len({r.made for r in made}) and all(r.made != r.entity for r in made)
    assert sum(r.made not in real for r in made) >= 900  # the free places are used


@pytest.mark.parametrize("kind,entities", [
    ("ip", [f"{a}.{b}.255.99" for a in range(10) for b in range(10, 100)]),
    ("secret", [f"{a}{b}-{c}" for a in "abcxyz" for b in "AZ" for c in range(10)]),
    ("phone", [f"49{n:03d}" for n in range(1000)]),
    ("email", [f"{a}{b}@x.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in range(10)]),
])
def test_bijections(spark, kind, entities):
    frame = spark.createDataFrame([(x,) for x in entities], "entity string")
    for attempt in (0, 3):
        made = [r.made for r in frame.select(pii.surrogate(F.lit(kind), F.col("entity"), F.lit(attempt), "k").alias("made")).collect()]
        shape = lambda x: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", x)))
        assert len(set(made)) == len(entities)
        if kind != "email":
            assert [shape(x) for x in made] == [shape(x) for x in entities]
        if kind == "ip":
            assert all(re.fullmatch(pii.TYPES["ip"], x) for x in made)
    other = {r.made for r in frame.select(pii.surrogate(F.lit(kind), F.col("entity"), F.lit(0), "other").alias("made")).collect()}
    assert kind in ("ip", "phone") or other != set(made)


def _luhn_valid(n):
    digits = [int(c) for c in n][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _iban_valid(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_check_digits_stay_right_or_wrong(spark):
    cards = ["4539148803436467", "4111111111111111", "378282246310005", "4539148803436468", "5555555555554444"]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE88370400440532013000"]
    frame = spark.createDataFrame([(k, x) for k, xs in (("card", cards), ("iban", ibans)) for x in xs], "kind string, entity string")
    for r in frame.select("kind", "entity", pii.surrogate(F.col("kind"), F.col("entity"), F.lit(0), "k").alias("made")).collect():
        assert r.made != r.entity and len(r.made) == len(r.entity)
        if r.kind == "card":
            assert _luhn_valid(r.made) == _luhn_valid(r.entity) and r.made[0] == r.entity[0]
        else:
            assert _iban_valid(r.made) == _iban_valid(r.entity) and r.made[:2] == r.entity[:2]


def test_names_beyond_three_syllables(spark):
    """More names of one word than three syllables have: some get a longer one, all are distinct."""
    frame = spark.range(6000).select(F.concat(F.lit("Mr. N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("x")).alias("text"))
    made = pii.entities(frame, "k").collect()
    assert len(made) == 6000 == len({r.made for r in made}) and not {r.made for r in made} & {r.entity for r in made}
    assert {r.attempt for r in made} > {0, 1}


def test_texts_with_the_marks_long_texts_and_repeats(spark):
    long_ = "mail a.b@x.example.com or 10.20.30.40, " * 5000
    rows = [(1, "\x01 a.b@x.example.com \x02."), (2, "see a.b@x.example.com"), (3, long_), (3, long_), (4, "\x02\x01"), (5, "a.b@x.example.com"), (None, None), (None, "a.b@x.example.com")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text, r.safe) for r in pii.replace(frame, "k").collect()), key=str)
    assert len(got) == len(rows)
    mail = next(s.text for i, t, s in got if i == 5)
    for _, t, s in got:
        if t is None or "@" not in t:
            assert s.text == t and s.n_mentions == 0
        else:
            assert s.text.count(mail) == t.count("a.b@x.example.com") and s.n_mentions == t.count("@") + t.count("10.20.30.40")
            assert len(s.text) == len(t) and "a.b@x.example.com" not in s.text
    again = sorted(((r.doc_id, r.text, r.safe) for r in pii.replace(frame.repartition(4), "k").collect()), key=str)
    assert again == got
    assert mail != next(r.safe.text for r in pii.replace(frame, "other").collect() if r.doc_id == 5)
