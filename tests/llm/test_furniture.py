"""Classes and ids that only look like page furniture."""

import numpy as np
import pytest

from tessera.llm import html_extract

WEIGHTS = html_extract.fit(np.zeros((0, html_extract.FEATURES)), np.zeros(0))
PROSE = "The council met on Tuesday, and after a long debate it agreed to repair the old bridge before winter. " * 3
PAGE = f"<nav><a href='/'>Home</a></nav><article><p>{PROSE}</p></article><footer>Imprint</footer>"


@pytest.mark.parametrize("wrapper", ["class='site has-sidebar'", "class='content no-sidebar'", "class='article-body social-science'", "id='post-comments-open'"])
@pytest.mark.parametrize("page", [PAGE, PAGE.replace("article>", "div>")])
def test_wrappers_keep_their_text(wrapper, page):
    assert html_extract.extract(f"<html><body><div {wrapper}>{page}</div></body></html>", WEIGHTS) == PROSE.strip()


@pytest.mark.parametrize("box", ["class='sidebar'", "id='comments'", "class='share social'"])
def test_furniture_by_class_goes_even_where_it_is_long(box):
    page = f"<article><p>{PROSE}</p></article><div {box}><p>{'Another story that readers wrote, with some length. ' * 12}</p></div>"
    assert html_extract.extract(page, WEIGHTS) == PROSE.strip()
