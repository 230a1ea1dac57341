"""The dealt operators on small inputs: brute force, and nulls, empty and long texts, ties, repeated rows, clashing names."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobscope.llm import (
    decontaminate, html_text, line_dedup, lm_score, mixture, ngram_join, pii, token_counts, topk, toxicity,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "score string, size string, text_ string, _row string, tree string, leak string, _lines string"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def texts():
    base = [f"w{i} and w{i * 7 % 31} the w{i * 3 % 17}" for i in range(40)]
    long_ = " ".join(base * 60)
    out = [
        None, "", "  \t\n ", "One", "one", "Two words", "A line\nshared line \n\nlast É", " SHARED line\nother", "shared line", long_, long_ + " tail",
        " ".join(base), " ".join(base), " ".join(base) + " end", " ".join(base[:20]), " ".join(base[20:]),
    ]
    out += [f"Shared line\nown text {i} of this one" for i in range(10)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i else None, t, "en", ["a", None, "b"][i % 3], None) for i, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c.split()[0]: F.lit("x") for c in CLASH.split(", ")})


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(t):
    return (t[0] is None, str(t))


def test_token_counts_follow_edits(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    counter = token_counts.Counter(path, pattern)
    count = lambda t: len(counter.encoding.encode_ordinary(t or ""))
    edits = F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(
        F.expr("array(named_struct('start', 2, 'end', 4, 'replacement', ' new '), named_struct('start', 9, 'end', 99, 'replacement', string(null)))")
    )
    trees = token_counts.count_trees(docs.drop("tree"), path, pattern)
    for r in token_counts.apply_edits(trees, edits, path, pattern).collect():
        assert r.tree.n_tokens == count(r.text)
        want = r.text
        if want is not None and r.doc_id != 5:
            cut = want[:9] + want[99:]
            want = cut[:2] + " new " + cut[4:] if len(want) >= 4 else want[:2] + " new " + want[4:]
            assert r.edited.n_encoded <= 2 * (len(want) + len(r.text))
        assert r.edited.text == want and r.edited.tree.n_tokens == count(want)
    assert token_counts.count_trees(empty(spark), path, pattern).count() == 0
    assert "tree_" in token_counts.count_trees(docs, path, pattern).columns


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup(docs, batches):
    rows = rows_of(docs)
    keys = [[low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t, _ in rows]
    seen = Counter(k for ks in keys for k in set(ks))
    want = []
    for (i, t, _), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if not (k and seen[k] >= 10)]
        want.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    got = line_dedup.drop_common_lines(docs, batches=batches, keep=["doc_id"]).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.text")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 10


def test_line_dedup_empty_and_clean(spark, docs):
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0
    made = line_dedup.clean(docs)
    assert made.columns == docs.columns and made.count() == docs.count()


def test_line_dedup_moves_a_text_once(docs):
    made = line_dedup.clean(docs)
    assert made.columns == docs.columns
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # the projection whose rows the join moves holds each column plainly, the text once
    moved = [line for line in plan if "Project" in line and " AS t1#" in line]
    assert len(moved) == 1 and "struct(" not in moved[0] and moved[0].count(" AS _text#") == 1


def test_lm_score(spark, docs):
    rows = [r[:2] for r in rows_of(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    for limit in (1 << 26, 600):  # one filter, and groups of blocks
        got = lm_score.score(docs, filter_bytes=limit).collect()
        base = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got)
        want = sorted(
            (i is None, i or 0, len(w) + 1, sum(seen[x] > 0 for x in [*w, None]), n, round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in [*w, None]), 6), held(i))
            for i, t in rows for w in [words(t)]
        )
        assert base == want
        scores = sorted(round(r.score, 9) for r in got)
        assert all(x <= 0 for x in scores)
        first = scores if limit == 1 << 26 else first
        assert scores == first
    assert sum(first) > sum(w[5] for w in want)  # copies are likelier than by words alone
    assert lm_score.score(empty(spark)).count() == 0


def test_lm_score_of_bigrams_seen_once(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, f"p{i} q{i}") for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:100]
    a, b = rows[0][1].split(), rows[1][1].split()
    rows += [(held[0], f"{a[0]} {a[1]}"), (held[1], f"{a[0]} {b[1]}")]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    once, never = got[held[0]], got[held[1]]
    assert once.held_out and never.held_out and round(once.base_score, 9) == round(never.base_score, 9)
    assert once.score > never.score + 0.01


def test_lm_score_against_exact_counts(spark):
    """The score from exact bigram counts, levels and smoothing worked out in plain Python; false positives of the filter are few."""
    import random

    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary[: 10 + i % 50]) for _ in range(r.randrange(0, 30)))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 400, 7)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = {i: ["<s>", *t.split(), "</s>"] for i, t in rows}
    c1 = Counter(w for i, ws in tokens.items() if i not in held for w in ws[1:])
    c2 = Counter(p for i, ws in tokens.items() if i not in held for p in zip(ws, ws[1:]))
    n, v = sum(c1.values()), len(c1)
    c1["<s>"] = c1["</s>"]
    lowest = lm_score._lowest(n)

    def value(c):
        level = sum(c >= x for x in lowest)
        return math.sqrt(lowest[level - 1] * max(lowest[level - 1], lowest[level - 1] * lm_score.STEP - 1)) if level else 0.0

    def logs(ws, a, b, less):
        total = 0.0
        for u, w in zip(ws, ws[1:]):
            before, seen = c1[u], min(value(c2[u, w]), c1[u], c1[w])
            before, seen = max(before - less, 0), max(seen - less, 0)
            k = a * max(before, 1.0) ** b
            total += math.log10((seen + k * (c1[w] + 1) / (n + v + 1)) / (before + k))
        return total

    best = max(lm_score.SMOOTHING, key=lambda s: sum(logs(ws, *s, 1) for i, ws in tokens.items() if i not in held))
    for limit in (1 << 25, 3000):  # one group, and several that a task walks through
        got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string"), filter_bytes=limit).collect()}
        off = [abs(got[i] - logs(ws, *best, 0)) for i, ws in tokens.items()]
        assert len(got) == len(rows) and sum(x < 1e-6 for x in off) >= 0.85 * len(off) and max(off) < 3


def test_lm_score_has_levels_for_any_count():
    for most in (1, 2, 10**6, 10**9, 10**13):
        lowest = lm_score._lowest(most)
        assert lowest[0] == 1 and lowest[-1] >= most and len(set(lowest)) == len(lowest)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, block_bytes):
    items = spark.createDataFrame([(1, "W3 AND w21 the w9"), (2, "shared, Line"), (3, ""), (4, None), (None, "one"), (10, "two-words")], "item_id bigint, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = []
    for i, t, _ in rows_of(docs):
        ws, hit, found = word(t), set(), set()
        for name, text in ((1, "W3 AND w21 the w9"), (2, "shared, Line"), (None, "one"), (10, "two-words")):
            it = word(text)
            size = min(3, len(it))
            for k, p in itertools.product(range(len(it) - size + 1), range(len(ws) - size + 1)):
                if ws[p : p + size] == it[k : k + size]:
                    hit |= set(range(p, p + size))
                    if name is not None:  # an item without an id hits, but is not named
                        found.add(str(name))
        want.append((i, len(ws), len(hit), sorted(found)))
    made = decontaminate.mark(docs, items, window=3, block_bytes=block_bytes, out="hits")
    got = [(r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits.item_ids) for r in made.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and any(w[2] for w in want)
    span = next(r for r in made.collect() if r.doc_id == 7)
    assert span.text[span.hits.spans[0].start : span.hits.spans[0].end] == "SHARED line"
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.clean(empty(spark), items).count() == 0


def test_topk(spark):
    values = [[math.sin(i * k + k) for k in range(1, 9)] for i in range(90)]
    rows = [(i, v) for i, v in enumerate(values)]
    rows += [(200, values[3]), (201, values[3]), (202, None), (203, [None] * 8), (204, [float("nan")] * 8), (205, [1.0, 2.0]), (None, values[1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in [i for i in ints if i % 20 == 0]:
        order = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(order[:20])]
    for block in (4096, 16):
        made = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), block=block, query_block=2)
        assert sorted(map(tuple, made.collect())) == sorted(want)
    assert topk.top_k(frame.limit(0), frame).count() == 0


def test_mixture(spark, docs):
    made = mixture.mix(docs).collect()
    total = sum(r.size for r in made)
    by = {}
    for r in made:
        assert r.size >= 0 and 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    assert len(by) == 3 and sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), rows in by.items():
        assert sum(r.size for r in rows) == size and target <= 2 * size
        assert abs(sum(r.taken for r in rows) - target) <= 1
    again = mixture.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    assert mixture.mix(empty(spark)).count() == 0
    assert mixture.mix(docs.filter("text is null")).first().taken == 0


def test_html(spark):
    menu = '<div class="menu"><ul><li>Home<li>News</ul></div>'
    page = f"""<html><head><title>T</title></head><body>{menu}<header><h1>Site</h1></header><div id=wrap><div class="side-bar"><p>Aside text that is long enough to look good</p></div>
    <div class="post-12 content"><h2>Head &amp; line</h2><p>One <b>two</b>\n three<br>four.<p>Five &lt;six&gt;.<script>var a="<p>no</p>"</script>
    <form><p>Your mail</p></form></div><div id="comments"><p>{'I say this. ' * 50}</p></div></div><footer>End</footer></body></html>"""
    short = page.replace("One <b>two</b>", "").replace("three<br>four.<p>Five &lt;six&gt;.", "x")
    rows = [(i, f"http://a.example.com/{i}", page) for i in range(3)] + [(3, "http://a.example.com/3", short), (4, None, page), (5, "http://b.example.com", ""), (6, "x", None), (7, "y", "plain < text")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text_ for r in html_text.main_text(frame).collect()}
    text = "Head & line\nOne two three four.\nFive <six>."
    assert got == {0: text, 1: text, 2: text, 3: "Head & line\nx", 4: text, 5: "", 6: "", 7: "plain < text"}
    assert html_text.main_text(frame.limit(0)).count() == 0
    assert html_text.extract("<div>" * 3000 + "deep", []) == "deep"


def test_html_without_end_of_head():
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><script>var a</script>\n", "<head><title>T</title></head>"):
        assert html_text.extract(f"<html>{head}<body><article><p>One two three.</p></article></body></html>", []) == "One two three."
        assert html_text.extract(f"<html>{head}<p>One two three.</p></html>", []) == "One two three."
    assert html_text.extract("<html><head><title>T</title>One two three.", []) == "One two three."
    formula = '<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="t">x=1</annotation></math>'
    assert html_text.extract(f"<article><p>So {formula} and <svg><path d='M0'/><text>a label</text></svg> end.</p></article>", []) == "So x=1 and a label end."


def test_pii_names_are_found_whole(spark):
    names = ["Dr. Maria Anna Lopez Garcia", "Mrs. Anna McDonald", "Mr. O'Brien", "Mr. J. Smith", "Mr. J.R. Smithson", "Frau Anna-Lena Müller-Lüdenscheidt", "Mrs. D’Arcy"]
    frame = spark.createDataFrame([(i, f"met {name}'s dog; {name}, too") for i, name in enumerate(names)], "doc_id bigint, text string")
    for r in pii.replace(frame, "k").collect():
        safe = r.safe
        assert (safe.n_mentions, safe.n_entities, safe.kinds) == (2, 1, ["name"]), r
        assert not any(part in safe.text for part in re.findall(r"\w{3,}", names[r.doc_id].split(" ", 1)[1])), r
        assert safe.text.endswith(", too") and "'s dog; " in safe.text


def test_pii(spark):
    rows = [
        (1, "a.b@x.example.com, A.B@X.EXAMPLE.COM +1 (017) 555-7713 and +1-017-555-7713 at 10.200.3.45"), (2, None), (3, ""),
        (4, "Mrs. Anna Smith met Г-жа Иванова; a.b@x.example.com 4539 1488 0343 6467 4539148803436467"), (4, "v 4.0. 12.5 no"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("safe", F.lit("x"))
    got = {(r.doc_id, r.text): r.safe_ for r in pii.replace(frame, "k").collect()}
    one, four = got[rows[0]], got[rows[3]]
    assert (one.n_mentions, one.n_entities) == (5, 3) and one.kinds == ["email", "ip", "phone"]
    mail = re.match(r"(\S+@\S+\.com), (\S+) \+1 \((\d{3})\) (\d{3})-(\d{4}) and \+1-(\d{3})-(\d{3})-(\d{4}) at \d{2}\.\d{3}\.\d\.\d{2}$", one.text)
    assert mail and mail[1].upper() == mail[2] and mail.groups()[2:5] == mail.groups()[5:8]
    assert mail[1] in four.text and "Smith" not in four.text and re.match(r"Mrs\. \w+na \w+na met Г-жа [а-яА-Я]+на;", four.text)
    cards = re.findall(r"\d[\d ]{14,}\d", four.text)
    assert cards and "4539148803436467" not in four.text.replace(" ", "")
    assert got[rows[1]].text is None and got[rows[2]].text == "" and got[rows[4]].text == rows[4][1]
    assert pii.replace(frame.limit(0), "k").count() == 0


def test_pii_collisions(spark):
    """One-digit places: distinct entities keep distinct surrogates, none of them an entity."""
    frame = spark.createDataFrame([(i, f"{i % 10}.{i // 10 % 10}.1.1") for i in range(60)], "doc_id bigint, text string")
    made = pii.entities(frame, "k").collect()
    assert len({r.made for r in made}) == len(made) == 60 and not {r.made for r in made} & {r.entity for r in made}


@pytest.mark.parametrize("n,percent,rows,tokens", [(3, 90, 1024, 1 << 20), (3, 90, 3, 1 << 20), (2, 60, 2, 100)])
def test_ngram_join(spark, docs, n, percent, rows, tokens):
    extra = [(100 + i, " ".join(f"x{k}" for k in range(140) if k not in (i % 9, i % 7 + 20)), "en", "a", None) for i in range(30)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, SCHEMA).select("doc_id", "text"))
    data = [(r.doc_id, words(r.text)) for r in frame.collect()]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for _, w in data]
    label = list(range(len(data)))
    for i, j in itertools.combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for x, (i, _) in zip(label, data):
        least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
    want = sorted(((i, len(s), least[x]) for (i, _), s, x in zip(data, sets, label)), key=key)
    got = ngram_join.linked_documents(frame, n=n, percent=percent, unit_rows=rows, unit_tokens=tokens)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert len({w[2] for w in want}) < len(want) - 20


def test_ngram_join_empty(spark):
    assert ngram_join.linked_documents(empty(spark)).count() == 0


def test_one_of_each_of_null_and_repeated_ids(spark):
    same, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, "only this one is without a copy here"), (None, other), (3, other), (1, same), (1, same + " end"), (1, same), (7, ""), (None, None), (7, "")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), n=5, percent=80).collect()
    left = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert len(left) == 6 and left.count((7, "")) == 2 and rows[0] in left and (None, None) in left and (3, other) in left
    assert sum((t or "").startswith("a0 ") for _, t in left) == 1


def test_toxicity(spark):
    rows = [(i, f"some plain words {i} here" + (" you gremlin" if i % 3 == 0 else "") + (" odd" if i % 5 == 0 else ""), "en", "a", None) for i in range(300)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "Gremlins!" * 3000, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(900, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r.score_ for r in toxicity.score(frame, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and all((got[i] >= 0.3) == (i % 3 == 0) for i in range(300))
    assert got[900] == got[901] < 0.3
    clean = toxicity.clean(frame, model)
    assert clean.columns == frame.columns and clean.count() == 203 - int(got[902] >= 0.3)
    none = toxicity.train(frame, labels.limit(0))
    assert toxicity.score(frame, none).agg(F.max("score_")).first()[0] < 1e-6


def test_toxicity_sends_only_texts_to_python(spark):
    frame = spark.createDataFrame([(1, "a", "kind words", "x"), (2, "b", None, "y")], "doc_id long, Lang string, text string, source string")
    model = toxicity.Model(0.0, np.zeros(1 << toxicity.BITS, np.float32), 0.6)
    made = toxicity.clean(frame, model)
    assert made.schema == frame.schema and made.count() == 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert toxicity.clean(frame, toxicity.Model(0.0, model.weights, 0.5)).count() == 0


def test_toxicity_keeps_rare_words(spark):
    """More biased n-grams than any fixed number of features: a rare toxic word keeps its weight."""
    common = [f"{'red' if y else 'blue'}{k}{c}" for y in (0, 1) for k in range(40) for c in "xyzuvw"]
    red, blue = " ".join(common[240:]), " ".join(common[:240])
    rows = [(i, (red if i % 2 else blue) + (" qjzzk" if i % 20 == 1 else ""), int(i % 2)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    grams = toxicity._Grams()
    for text in ("qjzzk", red):
        spots = sorted({*grams.of(text).tolist()} - {*grams.of(blue).tolist()})
        assert (model.weights[spots] > 0).all()
    # also a word that none of the sampled rows has
    few = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), max_rows=2)
    assert few.weights[grams.of("qjzzk")].any()


def test_toxicity_with_a_text_of_many_copies(spark):
    rows = [(i, "one text many times", 0) for i in range(300)] + [(1000 + i, f"plain number {i}" + (" gremlin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    def sample(rows, most):
        return [(r.y, r.n, bytes(r.features)) for r in toxicity._sample(rows.select("text", F.col("toxic").alias("y")), most).collect()]

    found = sample(frame, 100)
    assert len(found) == 100 and len(set(found)) == 100 and {r[0] for r in found} == {0, 1}
    whole = sample(frame, 1000)
    assert len(whole) == 201 and sum(r[1] for r in whole) == 500
    rare = frame.withColumn("toxic", (F.col("doc_id") == 1003).cast("int"))
    assert {r[0] for r in sample(rare, 50)} == {0, 1}


def _plain_features(text):
    """Character n-grams of distinct words with a blank at both ends, hashed one by one."""
    found = set()
    for w in set((text or "").lower().split()):
        padded = f" {w} "
        for n in toxicity.SIZES:
            for k in range(len(padded) - n + 1):
                h = n
                for c in padded[k : k + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
                found.add((h ^ h >> 31) >> 64 - toxicity.BITS)
    return found


def test_toxicity_against_plain_python(spark):
    """The same features, counts, ratios and loss, one document at a time, and a dense Newton solution."""
    texts = [None, "", " ", "É a", "a", "ab  ab\tAB", "word " * 99 + "x" * 300_000, "some More words\nhere \u2003 wide", "🙂🙂 ok"]
    grams = toxicity._Grams()
    for t in texts:
        found = grams.of(t or "").tolist()
        assert len(found) == len(set(found)) and set(found) == _plain_features(t)
    rows = [(i, f"w{i % 7} common v{i % 5} z{i % 3}" + (" bad" if i % 3 == 0 else ""), int(i % 3 == 0 or i == 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    learned = [(_plain_features(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    sizes = Counter(y for _, y in learned)
    seen = {y: Counter(f for fs, z in learned if z == y for f in fs) for y in (0, 1)}
    n = len(learned)
    names = sorted({f for fs, _ in learned for f in fs})
    scale = []
    for f in names:
        part = [math.log((seen[y][f] + toxicity.PSEUDO * sizes[y] / n) / sizes[y]) for y in (0, 1)]
        scale.append((part[1] - part[0]) * abs(part[1] - part[0]))
    x = np.array([[s * (f in fs) for f, s in zip(names, scale)] + [1.0] for fs, _ in learned])
    y = np.array([y for _, y in learned], float)
    beta, ridge = np.zeros(len(names) + 1), np.diag([1.0] * len(names) + [0.0])
    for _ in range(30):  # Newton's steps on the same loss
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ beta)
    assert model.intercept == pytest.approx(beta[-1], abs=1e-2)
    want = 1 / (1 + np.exp(-np.array([sum(scale[names.index(f)] * beta[names.index(f)] for f in fs) for fs, _ in learned]) - beta[-1]))
    ids = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert [got[i] for i in ids] == pytest.approx(want.tolist(), abs=5e-3)


def test_toxicity_of_empty_tables_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "a bad one"), (1, "bad thing"), (2, "good thing"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1), (1, 1), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(frame, labels)
    assert toxicity.score(frame, model).count() == 4 and toxicity.score(frame.limit(0), model).count() == 0
    assert toxicity.clean(frame.limit(0), model).count() == 0
    nothing = toxicity.train(frame.limit(0), labels)
    assert {r.score for r in toxicity.score(frame, nothing).collect()} == {1 / (1 + math.exp(30))}


def _without_common_lines(rows):
    keys = lambda text: [low(x.strip("\x20\t\n\v\f\r")) for x in (text or "").split("\n")]
    seen = Counter(k for r in rows for k in set(keys(r["text"])))
    for r in rows:
        left = "\n".join(x for x, k in zip((r["text"] or "").split("\n"), keys(r["text"]), strict=True) if not (k and seen[k] >= 10))
        yield r | {"text": None if r["text"] is None and not left else left}


def _one_of_each(rows, n=5, percent=80):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return [r for r, g in zip(rows, group, strict=True) if least[g] == r["doc_id"]]


def _without_items(rows, items, window=10):
    found = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    cut = set()
    for item in items:
        w = found(item)
        cut |= {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
    sizes = {len(c) for c in cut}
    for r in rows:
        w = found(r["text"])
        if not any(tuple(w[i : i + k]) in cut for k in sizes for i in range(len(w) - k + 1)):
            yield r


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage against a plain walk through the rows that the one before it left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    by_hand = [
        lambda rows: [r for r in rows if score[r["doc_id"]] < 0.3], _without_common_lines, _one_of_each,
        lambda rows: _without_items(rows, items),
    ]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixture"]
    rows = [r.asDict() for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted((r.asDict() for r in after.collect()), key=lambda r: r["doc_id"])
        if k < 4:
            assert after.columns == docs.columns
            assert got == sorted(by_hand[k](rows), key=lambda r: r["doc_id"]) and got
            rows = got
        docs = after
    assert [(r["doc_id"], r["size"]) for r in got] == [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source, target in {(r["source"], r["target"]) for r in got}:
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 1
