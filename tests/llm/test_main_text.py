import html
import itertools
import math
import random
import re

import numpy as np
import pytest

from demandloom.llm import main_text
from demandloom.llm.html_blocks import leaf_blocks
from demandloom.llm.layouts import labelled_page
from demandloom.llm.main_text import Field
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, clashing

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def field(spark):
    return main_text.learn_field(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


def article_text(page):
    """The article of the given tables' pages, by patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", inside))
    return "\n".join(part for part in parts if part)


def test_query_against_the_marked_article(spark):
    pages = {row.page_id: row for row in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op11_main_text"](spark, SF_DIR).collect()
    assert {row.page_id: (row.url, row.text) for row in got} == {i: (p.url, article_text(p.html)) for i, p in pages.items()}
    assert all(row.n_chars == len(row.text) for row in got)


def test_held_out_layouts(field):
    """Pages of other words and seeds than those learned from: nearly every block right."""
    words = [f"w{i}" for i in range(300)]
    wrong = blocks = 0
    for seed in range(10**6, 10**6 + 200):
        page, labels = labelled_page(words, seed)
        found = leaf_blocks(page)
        assert len(found) == len(labels)
        texts = iter(field.main_blocks(page))
        due = next(texts, None)
        for block, label in zip(found, labels):
            main = due is not None and block.text == due
            due = next(texts, None) if main else due
            wrong += main != label
            blocks += 1
    assert wrong < 0.01 * blocks


def test_pages_of_other_authors(field):
    page = """<html><body class="single"><div id="cookieConsentBar"><p>We use cookies to improve your visit. <a href=#>Accept</a></p></div>
    <header class="siteHeader"><a href="/">The Daily Example</a><nav class="primary-navigation"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>
    <div class="wrap"><div class="post-12 entry"><h1>River levels fall</h1><p>Levels fell to a ten year low, officials&nbsp;said on&#32;Monday &amp; Tuesday.</p>
    <div class="advertBox">Buy one, get one free at the garden centre this weekend only.</div><p>Farmers expect a smaller harvest, and
    some wells are <b>already</b> dry; rain is not forecast.</p></div>
    <div class="sidebarRight"><h3>Most read</h3><ul><li><a href=1>Storm hits coast</a></li><li><a href=2>Team wins cup</a></li></ul></div>
    <div id="reader-comments"><h3>2 comments</h3><div class="comment"><p>I have lived here for forty years and never saw the river this low, it is a shame.</p></div></div></div>
    <form action=/s><label>Search</label><input><button>Go</button></form><footer>&copy; 2024 The Daily Example | All rights reserved</footer></body></html>"""
    assert field.main_blocks(page) == [
        "River levels fall",
        "Levels fell to a ten year low, officials said on Monday & Tuesday.",
        "Farmers expect a smaller harvest, and some wells are already dry; rain is not forecast.",
    ]
    page = "<nav>Home | About</nav><main><h1>Title</h1><p>First &lt;b&gt; part, of text.<p>Second one.</main><aside>Sponsored</aside><footer>Contact"
    assert field.main_blocks(page) == ["Title", "First <b> part, of text.", "Second one."]


def texts(page):
    return [block.text for block in leaf_blocks(page)]


def test_blocks():
    assert texts("a<p>b<p>c<br>d<div>e</div>f") == ["a", "b", "c d", "e", "f"]
    assert texts("<ul><li>a<li>b <i>c</i><ul><li>d</ul></ul>e") == ["a", "b c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert texts("<p>a<!-- <p>x --> b<script>var t='</p>';</SCRIPT >c<style>x") == ["a bc"]
    assert texts('<p title="a>b">c</p><p title="d>e</p>') == ["c", "e"]
    assert texts("1 < 2 <3 & 4 &lt;p&gt; &#8364;&nbsp;5") == ["1 < 2 <3 & 4 <p> € 5"]
    assert texts("<title>x</title><noscript>y</noscript><textarea><p>z</textarea>") == []
    assert texts("") == texts("<p></p>  ") == texts("<!-- open") == texts("<script>open") == []
    deep = "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y"
    assert [b.text for b in leaf_blocks(deep, len, len, len, 0)] == ["x", "y"]
    block = leaf_blocks('<div class="postBody x1" id=main-part role=main><p hidden>a<a href=1>bc</a></p>')[0]
    assert {"t:div", "c:post", "c:body", "c:main", "c:part", "r:main", "hidden"} <= set(block.place)
    assert (block.tag, block.links) == ("p", 2)


def test_viterbi_is_the_best_of_all_labellings():
    rng = random.Random(2)
    page = "".join(f"<{tag}>w {i}" for i, tag in enumerate(rng.choices(["p", "div", "li", "h2"], k=9)))
    blocks = leaf_blocks(page)
    words = {word: rng.gauss(0, 2) for block in blocks for word in main_text.features(block)}
    field = Field(words, *(np.array([rng.gauss(0, 2) for _ in range(n)]).reshape(shape) for n, shape in ((12, (3, 2, 2)), (2, (2,)), (2, (2,)))))

    def value(labels):
        out = field.first[labels[0]] + field.last[labels[-1]]
        out += sum(sum(words[w] for w in main_text.features(b)) for b, label in zip(blocks, labels) if label)
        return out + sum(field.moves[b.tie][x][y] for b, x, y in zip(blocks[1:], labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
    assert field.main_blocks(page) == [b.text for b, label in zip(blocks, best) if label]


def test_training_finds_the_likeliest_field():
    """On a page of one repeated pattern the trained field's chance of the labels, summed over all labellings, is near 1."""
    page, labels = "<nav>a</nav><p>b<p>c<footer>d", [False, True, True, False]
    blocks = leaf_blocks(page)
    field = main_text.train([(blocks, labels)] * 20, ridge=0.01)

    def value(way):
        out = field.first[way[0]] + field.last[way[-1]]
        out += sum(sum(field.words.get(w, 0) for w in main_text.features(b)) for b, label in zip(blocks, way) if label)
        return out + sum(field.moves[b.tie][x][y] for b, x, y in zip(blocks[1:], way, way[1:]))

    every = {way: math.exp(value(way)) for way in itertools.product((0, 1), repeat=4)}
    assert every[tuple(map(int, labels))] > 0.95 * sum(every.values())


def test_awkward_pages(spark, field, tmp_path):
    long = "<article>" + "".join(f"<p>Paragraph {i}, of a very long page.</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><h1>One</h1><p>Two of them.</p></article>"), (3, "u", long), (3, "u", "<p>"), (3, "u", "<p>")]
    table = clashing(spark.createDataFrame(rows, SCHEMA), ["text", "n_chars"])
    got = main_text.extract_main_text(table, field).collect()
    assert sorted((r.page_id or 0, r.url, len(r.text)) for r in got if r.url) == [(0, "u", 16), (1, "u", 0), (3, "u", 0), (3, "u", 0), (3, "u", len(re.sub("<[^>]*>", "", long)) + 29_999)]
    table.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op11_main_text"](spark, str(tmp_path)).count() == 0
