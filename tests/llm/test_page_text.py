"""Page text: the cut decides, and nothing of an article is lost."""

import html
import re
import time

import numpy as np
import pytest
from tessera.llm import html_extract

WEIGHTS = html_extract.fit(np.zeros((0, html_extract.FEATURES)), np.zeros(0))
PROSE = "The council met on Tuesday, and after a long debate it agreed to repair the old bridge before winter. " * 2


def text_of(page):
    return html_extract.extract(page, WEIGHTS)


def article_of(page):
    """Text of the one article of a page of the driver's tables, which has paragraphs and headings alone."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " ")))
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in body.split("\0")) if x)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_articles_of_real_pages(pages):
    weights = html_extract.train(pages)
    for r in pages.collect():
        assert html_extract.extract(r.html, weights) == article_of(r.html)


def test_edges_change_labels_of_real_pages(pages):
    """Real pages without their landmarks and with a line of links between two paragraphs: the line's looks speak against it."""
    weights, changed, kept = html_extract.train(pages), 0, 0
    for r in pages.collect():
        page = re.sub(r"<(/?)(?:article|aside)>", r"<\1div>", r.html).replace("</p><p>", "</p><p><a href='x'>more of this here</a></p><p>", 1)
        found = html_extract.blocks(page)
        line = [i for i, b in enumerate(found) if b.text == "more of this here"]
        if line:
            with_edges, without = (html_extract.label(found, weights, smooth=s) for s in (html_extract.SMOOTH, 0.0))
            changed += with_edges != without
            kept += with_edges[line[0]] and not without[line[0]]
    assert changed >= kept >= 100


def test_looks_outweigh_the_mark_of_the_article():
    weights = WEIGHTS.copy()
    weights[0] = -5.0
    found = html_extract.blocks(f"<article><p>{PROSE}</p><p>ha</p><p>{PROSE}</p></article>")
    assert html_extract.label(found, weights, smooth=0.0) == [True, False, True]
    assert html_extract.label(found, weights) == [True, True, True]


def test_letters_that_grow_in_lower_case():
    page = "<article><p>" + "İ" * 60 + f"</p><script>x</script><p>{PROSE}</p><STYLE>y</Style><p>{PROSE}</p></article>"
    assert text_of(page).split("\n\n") == ["İ" * 60, PROSE.strip(), PROSE.strip()]


@pytest.mark.parametrize("attrs", ["title=it's", "title='it\"s'", 'title="it\'s"', "title = it's class=x", "'", "=", "a='1' b", "title=a>b"])
def test_quotes_in_attributes(attrs):
    page = f"<article><p {attrs}>Hello world, don't lose me, I am here to stay.</p><p>{PROSE}</p></article>"
    first = "b>Hello" if attrs == "title=a>b" else "Hello"
    assert text_of(page) == f"{first} world, don't lose me, I am here to stay.\n\n{PROSE.strip()}"


@pytest.mark.parametrize("box", ["section class='legal-analysis'", "div class=side", "p class=share", "div id='search-results-explained'"])
def test_names_that_may_mean_anything_keep_prose_of_the_article(box):
    page = f"<article><h1>A title</h1><p>{PROSE}</p><{box}>{PROSE}</{box.split()[0]}><p>{PROSE}</p></article>"
    assert text_of(page).count(PROSE.strip()) == 3


@pytest.mark.parametrize("box", ["section id=comments", "div class='ad'", "aside", "div class='sidebar'", "div class='newsletter-box'", "form"])
def test_furniture_in_the_article_goes_even_where_it_is_prose(box):
    page = f"<article><p>{PROSE}</p><{box}><p>Readers' own words, which are long enough to look like prose, I think.</p></{box.split()[0]}><p>{PROSE}</p></article>"
    assert text_of(page) == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def test_hidden_text_goes():
    assert text_of(f"<article><p>{PROSE}</p><p hidden>{PROSE}</p><div style='display: none'><p>{PROSE}</p></div></article>") == PROSE.strip()


def test_large_page_takes_time_in_proportion():
    took = []
    for n in (2_000, 8_000):
        page = "<body><article>" + f"<div><p>{PROSE}</p><p>Ha.</p></div>" * n + "</article></body>"
        t = time.perf_counter()
        assert text_of(page).count("Ha.") == n
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0], took
