"""Extraction on pages with known text, on the whole table, and on hard markup."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest

from sparkloom.llm import html_text as H
from sparkloom.llm.queries import op1_html_text


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_gradients_match_finite_differences():
    r = np.random.default_rng(1)
    m = H.BiLstm(inputs=5, hidden=3, seed=2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = r.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = m.probabilities(x, mask)
        return -(np.where(y == 1, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    for k, g in m.gradients(x, mask, y).items():
        flat = m.p[k].reshape(-1)
        for i in r.choice(flat.size, min(6, flat.size), replace=False):
            old, e = flat[i], 1e-4
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 1e-3, k


def test_new_made_pages(model):
    r = random.Random(4242)
    pages = [H.made_page(r) for _ in range(200)]
    got = H.main_texts([p for p, _ in pages], model)
    assert sum(g == " ".join(m) for g, (_, m) in zip(got, pages, strict=True)) >= 180


def test_query_over_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op1_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert r.n_chars == len(r.text)


def test_leaves_of_hard_markup():
    text = lambda p: [t for _, t, _ in H.leaves(p)]
    assert text("") == [] and text("plain") == ["plain"] and text("<p>a<p>b") == ["a", "b"]
    assert text("<p>f<b>o</b>o&amp;amp;&nbsp; bar<br>baz") == ["foo&amp; bar baz"]
    assert text("<script>var a='</p>';</script><p>x</p><style>p{}</style><!-- c <p>no</p> --><p>y") == ["x", "y"]
    assert text("<p>a<script>never closed <p>b") == ["a"] and text("<p>a<!-- open <p>b") == ["a"]
    assert text('<p title="a > b">c</p>') == ["c"] and text("a < b and c > d") == ["a < b and c > d"]
    assert text("<head><title>no</title></head><body>yes") == ["yes"]
    assert text("<ul><li>a<li>b<ul><li>c</ul></ul>") == ["a", "b", "c"]
    path = H.leaves('<div class="side-bar"><ul><li><a href="/x">link</a></li></ul></div>')[0]
    assert path[0] == ("div side-bar", "ul", "li") and path[2] == 4


def test_context_decides_between_equal_blocks(model):
    page = "<nav><a>home</a></nav><article><h1>the title</h1>" + "<p>some words that tell a story, and more.</p>" * 6 + "</article><footer><p>some words that tell a story, and more.</p></footer>"
    assert H.main_texts([page], model)[0] == "the title " + " ".join(["some words that tell a story, and more."] * 6)


def test_nulls_repeats_long_pages_and_empty_tables(spark, model):
    body = "<article><h1>title here</h1>" + "".join(f"<p>paragraph {i} has a few more words, all told.</p>" for i in range(2000)) + "</article>"
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "", "t"), (2, "v", body, "t"), (3, "w", "<nav>only a menu</nav>", "t")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [len(r.text) for r in got if r.page_id != 2] == [r.n_chars for r in got if r.page_id != 2]
    assert sorted(str(r.page_id) for r in got if r.text == "") == ["1", "1", "3", "None"]
    long = next(r for r in got if r.page_id == 2)
    assert long.text == " ".join(t for _, t, _ in H.leaves(body))
    assert H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_deep_and_long_pages_take_linear_time_and_bounded_vectors(model):
    import time

    began = time.perf_counter()
    deep = "<nav>" + "<div><b>" * 20_000 + "x" + "</p></i>" * 20_000 + "<p>y</p>" * 3000
    assert len(H.leaves(deep)) == 3001 and time.perf_counter() - began < 20
    assert H.leaves("<nav><div>" + "<div>" * 30 + "far inside</div>")[0][0].labels()[0] == "nav", "outer elements count at any depth"
    page = H.leaves("<nav><a>m</a></nav><article>" + "".join(f"<p>words of part {i}, all told.</p>" for i in range(300)) + "</article><footer>f</footer>")
    whole, pieces = H.label_pages([page], model)[0], H.label_pages([page], model, steps=64)[0]
    assert np.allclose(whole, pieces, atol=1e-5)


def test_pages_without_telling_tags(model):
    r = random.Random(77)
    pages = [H.made_page(r, 1.0) for _ in range(100)]
    right = wrong = missed = 0
    for (_, main), text in zip(pages, H.main_texts([p for p, _ in pages], model), strict=True):
        got, want = text.split(), " ".join(main).split()
        both = len(set(got) & set(want))
        right, wrong, missed = right + both, wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert right / (right + missed) > 0.7 and right / (right + wrong) > 0.7, (right, wrong, missed)


@pytest.mark.parametrize("piece", ['<a "', "<a ", "<!x ", "<a '\"", '</a "', "<script '", "<a x='>", "<!--", "<p>x</", "< "])
def test_unfinished_markup_takes_linear_time(piece):
    import time

    for end in ("", ">", '">', "'>"):
        began = time.perf_counter()
        H.leaves(piece * (1_000_000 // len(piece)) + end)
        assert time.perf_counter() - began < 4


def test_unfinished_tags_keep_what_follows():
    text = lambda p: [t for _, t, _ in H.leaves(p)]
    assert text('<p>a</p><a title="never closed>b</a><p>c') == ["a", "b", "c"]
    assert text("<div/>a<p>b") == ["a", "b"] and H.leaves("<div/>a")[0][0].labels() == ("div",)
    assert text("a <b") == ["a <b"] and text("1 <2 <p>x") == ["1 <2", "x"]


def test_articles_of_details_and_figures(model):
    line = "Some words that tell a story, and more of it."
    page = f"<nav><a>home</a></nav><article><details><summary>What it is</summary><p>{line}</p></details><figure><img src=a><figcaption>A picture of it.</figcaption></figure></article><footer>&copy; 2020</footer>"
    assert H.main_texts([page], model)[0] == f"What it is {line} A picture of it."
