import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest

from dieline.llm import pages, search
from dieline.llm.scratch import Scratch

CASES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>cut off</p": "cut off",
    "<article><p>x<script>if(a<b){}</script>y<table><tr><td>1<td>2</table><form>f<input></form><pre> a\n b</pre></article>": "xy 1 2 a b",
    "<nav><a href=/a>Menu</a></nav><article><h1>Head</h1><p><b>Lead.<br><p>One, two.</p></article><footer>end</footer>": "Head Lead. One, two.",
    "<div id=main><p>Long text, with commas, and more.</p><div class='user-comments'><p>no</p></div></div><div class=sidebar>no</div>": "Long text, with commas, and more.",
    "<body><h1>Title</h1><div><p>One, <em>Em</em>phasis<p>T&nbsp;o</div><aside>no</aside>": "Title One, Emphasis T o",
    "<title>t</title><style>p{}</style><body>bare   text<!-- no --> here": "bare text here",
    "<article><p>a</p><ul><li><a href=1>l1</a><li><a href=2>l2</a><li><a href=3>l3</a></ul><p>b</p></article>": "a b",
    "<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>": "yes",
}


@pytest.mark.parametrize("html,text", CASES.items())
def test_main_text(html, text):
    assert pages.main_text(html) == text


def test_odd_markup_ends():
    r = random.Random(1)
    parts = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=\"", "</a", "<", ">", "<!--", "-->", "text, ", "<script>", "</script>", "<li>", "<b>", "&#0;", "&lt"]
    for _ in range(300):
        pages.main_text("".join(r.choice(parts) for _ in range(60)))
    assert pages.main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    pages.main_text("<a " + 'b="c" ' * 5000)


def test_extract_rows(spark):
    rows = [(1, "u", h, 9) for h in CASES] + [(None, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = pages.extract(df).collect()
    assert [x.text for x in out] == [*CASES.values(), ""] and all(x.n_chars == len(x.text) for x in out)
    assert pages.extract(df.limit(0)).collect() == []


PARAGRAPH = "A paragraph of the text, with commas, and with enough words to count for something more than a short line would. "


def test_scores_decide():
    """The same page with other amounts of text in its blocks gives other results, with and without an article element."""
    for tag in ("div", "article"):
        def page(a, b, tag=tag):
            return f"<body><div><div class='ad-slot'><p>{PARAGRAPH * a}</p></div></div><{tag} class='x'><p>{PARAGRAPH * b}</p></{tag}><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></body>"

        text = (PARAGRAPH * 5).strip()
        assert pages.main_text(page(1, 5)) == text
        assert pages.main_text(page(5, 1)) == (PARAGRAPH.strip() if tag == "article" else f"{text} {PARAGRAPH.strip()}")
    one, two = f"<div><p>{PARAGRAPH * 20}</p></div>", "<section><p>Short, plain end.</p></section>"
    assert pages.main_text(f"<body><div id=wrap>{one}{two}</div></body>").endswith("Short, plain end.")


@pytest.mark.parametrize("name,kept", [("article side-by-side", True), ("notice-of-death", True), ("share", False), ("ad-slot", False), ("siteFooter", False), ("search-box", False), ("tagsoup", True)])
def test_words_of_class(name, kept):
    html = f"<article><p>{PARAGRAPH * 3}</p><div class='{name}'><p>Here, or not.</p></div></article>"
    assert pages.main_text(html).endswith("Here, or not.") == kept


def test_comments_by_heading():
    html = f"<div><p>{PARAGRAPH * 3}</p><div><h3>12 Comments</h3><p>I, too.</p></div><div><h3>Comments on Caesar</h3><p>Text, too.</p></div></div>"
    assert pages.main_text(html) == f"{(PARAGRAPH * 3).strip()} Comments on Caesar Text, too."


@pytest.mark.parametrize("html", [
    "<p>a" + "</div></b></span>" * 60_000, "<blockquote>a, b" * 60_000, "<span>" * 60_000 + "</b>" * 60_000, "<div>" * 20_000 + "<dt>a<li>b" * 30_000,
    "<b><div>x</b>" * 50_000, "<table><tr><td>a" * 40_000, "<li><p>a" * 60_000, "<script>" * 100_000, "<!--" * 200_000, "<div class='a' " * 60_000,
])
def test_odd_pages_of_a_megabyte(html):
    began = time.perf_counter()
    pages.main_text(html)
    assert time.perf_counter() - began < 5  # about half a second


def plain_top(rows, k, every):
    q = [(i, [int(math.floor(Fraction(float(x)) * 256)) for x in v]) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(q):
        if i % every == 0:
            s = sorted((-max(-(10**38) + 1, min(10**38 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j, m) for m, (j, w) in enumerate(q) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s_))) for r, (s_, j, _) in enumerate(s)]
    return sorted(out)


def found_top(df, spark, **options):
    return sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in search.top_k(df, Scratch(spark), **options).collect())


def test_top_k_repeated_ids(spark):
    rows = [(2, [1.0, 1.0]), (2, [3.0, 1.0]), (50, [1.0, 0.0]), (50, [2.0, 5.0]), (50, [2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found_top(df, spark) == plain_top(rows, 5, 50)
    assert (50, 1, 2, 196608) in found_top(df, spark)


def test_top_k_lengths_and_large_values(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=2 + i % 3) * 10.0 ** r.integers(-3, 4)]) for i in range(60)]
    rows += [(100, [1.0] * 7), (110, [3e18, 1.0]), (120, [-3e18, 2.5]), (130, [1e300, 1.0]), (140, [2.0**53, 1.0 + 2.0**-8]), (150, [1e9, -1e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found_top(df, spark, every=10, rows=8, queries=3) == plain_top(rows, 5, 10)


@pytest.mark.parametrize("scale", [1.0, 0.02])
def test_top_k(spark, scale):
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] * (1 + i % 7) * scale + r.normal(size=8) * 0.05]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, [0.0] * 8), (301, None), (302, []), (303, [float("nan")] * 8), (304, [None] * 8), (None, rows[0][1])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    assert found_top(df, spark, every=10, rows=16, queries=4) == plain_top(rows, 5, 10)


def test_top_k_small(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in search.top_k(df, Scratch(spark)).collect()] == [(50, 1, 2, 65536)]
    assert search.top_k(df.limit(0), Scratch(spark)).collect() == []
