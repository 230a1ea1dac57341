"""Main text: parts of an article stay, furniture goes by the votes of a host's pages, all containers of the best path."""

import pytest
from pyspark.sql import functions as F

from jobscope.llm import html_text

LONG = "This is a sentence of the article and it goes on for a while. " * 4


@pytest.mark.parametrize("part", [
    '<section class="discussion"><p>We discuss it.</p></section>', '<div class="article-meta"><p>We discuss it.</p></div>', '<div class="legal"><p>We discuss it.</p></div>',
    "<label>We discuss it.</label>", '<div class="related"><p>We discuss it.</p></div>', '<p class="tags">We discuss it.</p>', '<p class="copyright">We discuss it.</p>',
    "<object><p>We discuss it.</p></object>", '<div class="share"><p>We discuss it.</p></div>',
])
def test_parts_of_an_article_stay(part):
    text = html_text.extract(f"<html><body><nav>Menu</nav><article><h1>T</h1><p>{LONG}</p>{part}</article><footer>End</footer></body></html>", [])
    assert text.split("\n") == ["T", LONG.strip(), "We discuss it."]


def test_all_containers_of_the_best_path():
    page = f'<body><div class="menu">M</div><div class="post"><p>One. {LONG}</p></div><div class="post"><p>Two. {LONG}</p><p>x</p></div></body>'
    assert html_text.extract(page, []).split("\n") == [f"One. {LONG}".strip(), f"Two. {LONG}".strip(), "x"]


def test_what_the_contract_names_goes():
    for gone in ("comments", "ad", "cookie-notice", "sidebar", "newsletter", "footer", "menu", "banner", "comment-list", "search"):
        assert html_text.extract(f'<article><p>{LONG}</p><div class="{gone}"><p>Gone.</p></div></article>', []) == LONG.strip()
    for tag in ("nav", "aside", "footer", "form", "script", "style"):
        assert html_text.extract(f"<article><p>{LONG}</p><{tag}>Gone.</{tag}></article>", []) == LONG.strip()


def test_furniture_is_what_a_host_repeats(spark):
    page = lambda i, meta, host: (i, f"http://{host}/{i}", f'<body><article><p>{i} {LONG}</p><div class="meta"><p>{meta}</p></div></article></body>')
    rows = [page(i, "All rights reserved", "a.com") for i in range(5)] + [page(5, "By hand", "a.com")]
    rows += [page(10 + i, f"Written on day {i}", "b.com") for i in range(5)] + [page(20, "All rights reserved", "c.com"), page(21, "All rights reserved", "c.com")]
    rows += [page(5, "By hand", "a.com"), (30, None, None), (31, "http://a.com/", "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "_paths": F.lit("x")})
    got = html_text.main_text(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id >= 30:
            assert r.text_ == ""
        else:
            last = {True: [], False: ["By hand"]}[r.page_id < 5] if r.page_id < 10 else [f"Written on day {r.page_id - 10}"] if r.page_id < 20 else ["All rights reserved"]
            assert r.text_.split("\n") == [f"{r.page_id} {LONG}".strip(), *last]


def test_votes_that_tie_and_long_pages(spark):
    body = lambda c, n: f'<body><div class="{c}">{"<p>Some words here.</p>" * n}</div></body>'
    rows = [(1, "http://t.com/1", body("aa", 3)), (2, "http://t.com/2", body("bb", 3)), (3, "http://t.com/3", body("aa", 60_000)), (4, "http://t.com/4", body("bb", 1))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert [got[k].count("Some words here.") for k in (1, 2, 3, 4)] == [3, 3, 60_000, 1]
    assert {r.page_id: r.text for r in html_text.main_text(frame.repartition(3)).collect()} == got
