"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of text at block-level tags. Each block is a node of a graph: a classifier's
costs for "content" and "boilerplate" become the capacities to the two terminals, and smoothness edges
join blocks that follow each other and blocks that are close in the element tree. Maximum flow gives the
labelling of least total cost: text that looks doubtful on its own goes with its neighbours.

The classifier is a logistic regression, trained here on blocks of a bounded sample of pages whose
markup says what they are (inside ``article`` or ``main``, or inside ``nav``, ``footer``, ``aside``, ads,
forms); those giveaways are not among its features. They enter the terminal capacities as prior costs
(``PRIORS``) that compete with how a block's text looks and with its neighbours: being inside the page's article
speaks for a block half as much as the worst looks speak against it, so a doubtful line is kept by the lines
around it; elements that hold no main text (menus, headers, footers, sidebars, forms, dialogs)
speak against it more than any looks speak for it; a class or id that names furniture speaks against it as much
as the name is plain, and prose inside an article outweighs a name that may mean anything. Only what a page
hides is bound to the boilerplate terminal, since no reader sees it. The mark of a class or id doesn't reach into
article or main, nor count for a wrapper that holds most of the text of a page with no content outside it.

Defined results: null and empty pages give an empty text; a page without any block gives an empty text;
broken markup is read as far as possible (unclosed tags close with their parents, stray ends are
ignored); a page of any length is one graph with a node for each block; repeated rows get equal results; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches

MAX_TRAIN_PAGES = 2_000

#: Kinds of elements.
BLOCK = frozenset(
    "address article aside blockquote body br-none caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title template noscript iframe object svg math canvas audio video select xmp noembed noframes".split())
CHROME = frozenset("nav footer aside form button menu dialog label input fieldset legend option optgroup datalist".split())
#: An end is implied when one of these starts.
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head"}
CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|foot|sidebar|side-?bar|side|aside|widget|ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|reply|replies|pagination|pager|skip|toolbar|masthead|topbar|copyright|legal|disclaimer|tags?|hidden)(?:$|[\s_-])",
    re.I,
)
#: Of these, names that hardly mean anything else.
PLAIN_WORDS = re.compile(
    r"(?:^|\s)(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|footer|side-?bar|widget|ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notification|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|related|recommend\w*|comments?|commentlist|disqus|respond|replies|pagination|pager|toolbar|masthead|topbar)(?:$|[\s_-])",
    re.I,
)
#: Classes that tell what a wrapper has or lacks, not what it is.
MODIFIERS = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S*", re.I)
#: What speaks for a block (above 0) and against it, on the scale of the classifier's margins, which go up to ``MARGIN``.
MARGIN = 4.0
PRIORS = {"article": 2.0, "outside": -5.5, "element": -9.0, "plain name": -8.0, "name": -5.0, "heading": 0.75}
#: Weight of the edge between blocks that follow each other in one element.
SMOOTH = 3.0
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?:$|[\s_-])", re.I)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())

# An attribute's value ends at its quote, or without one at white space; a quote elsewhere is a letter like any other.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>=]|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"\s+")


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("chrome", "heading", "hidden", "link", "main", "path", "soft", "tag", "text")

    def __init__(self, text: str, link: int, tag: str, path: tuple[int, ...], chrome: bool, main: bool, heading: bool, soft: tuple[tuple[int, bool], ...] = (), hidden: bool = False) -> None:
        self.text, self.link, self.tag, self.path, self.chrome, self.main, self.heading, self.soft, self.hidden = text, link, tag, path, chrome, main, heading, soft, hidden


def _marks(attrs: str) -> tuple[bool, bool, bool, int]:
    """Whether attributes mark page furniture by role, main content, a hidden element, and furniture by class or id (1, or 2 if plainly)."""
    chrome, main, hidden, soft = False, False, False, 0
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            value = MODIFIERS.sub("", value)
            if CHROME_WORDS.search(value):
                soft = max(soft, 1 + bool(PLAIN_WORDS.search(value)))
            elif CONTENT_WORDS.search(value):
                main = True
        elif name == "role":
            chrome |= value.lower() in CHROME_ROLES
            main |= value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    return chrome, main, hidden, soft


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order. References are decoded and white space is turned into single spaces."""
    out: list[Block] = []
    # Open elements: tag, number, chrome, main, elements around that a class calls furniture (number, whether plainly), hidden.
    stack: list[tuple[str, int, bool, bool, tuple[tuple[int, bool], ...], bool]] = []
    parts: list[str] = []
    link = depth_a = number = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                # Paragraphs and inline elements that markup forgot to close don't set a block apart.
                path = tuple(x[1] for x in stack if x[0] in BLOCK and x[0] != "p")
                tag = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")
                out.append(Block(text, link, tag, path, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3], len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), stack[-1][4] if stack else (), bool(stack) and stack[-1][5]))
        link = 0

    def words(text: str) -> None:
        nonlocal link
        if text:
            parts.append(text)
            if depth_a:
                link += len(text.strip())

    at = 0
    endless: set[str] = set()
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            words(m["cdata"] or "")
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "br" or tag == "p" and not any(x[0] == "p" for x in stack):
                flush()
                continue
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                # Ends of inline elements don't close blocks around them.
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    k = -1
                    break
                k -= 1
            if k >= 0:
                if any(x[0] in BLOCK for x in stack[k:]):
                    flush()
                del stack[k:]
                depth_a = sum(x[0] == "a" for x in stack)
            continue
        attrs = m["attrs"] or ""
        if tag in RAW:
            if attrs.rstrip().endswith("/") and tag in ("svg", "math", "object"):
                continue
            close = None if tag in endless else _CLOSE[tag].search(page, at)
            if not close:
                endless.add(tag)
                # An unclosed script hides the rest of the page; other unclosed elements are passed over.
                if tag in ("script", "style", "xmp"):
                    break
                continue
            end = page.find(">", close.end())
            at = len(page) if end < 0 else end + 1
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            words("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_PARAGRAPH:
                # A new block ends an open paragraph, with all that was left open in it.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK:
                        break
                if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in same:
                            del stack[k:]
                            break
                        if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                            break
                depth_a = sum(x[0] == "a" for x in stack)
        chrome, main, soft, hidden = stack[-1][2:] if stack else (False, False, (), False)
        if tag in CHROME or (tag == "header" and not main):
            chrome = True
        elif tag in ("article", "main"):
            main, soft = True, ()
        number += 1
        if attrs and len(attrs) > 3:
            c, mark, unseen, named = _marks(attrs)
            if tag not in ("html", "body"):
                hidden |= unseen
                chrome |= unseen or c and tag not in ("article", "main")
            if named and tag not in ("html", "body", "article", "main"):
                soft = (*soft, (number, named == 2))
            main |= mark and not c and not named
        stack.append((tag, number, chrome, main, soft, hidden))
        if tag == "a":
            depth_a += 1
    flush()
    return _without_wrappers(out)


def _without_wrappers(page: list[Block]) -> list[Block]:
    """Drop the marks of elements that hold most of the text, unless the page has marked content outside them."""
    total = sum(len(b.text) for b in page if not b.chrome)
    held: dict[int, int] = {}
    for b in page:
        if not b.chrome:
            for k, _ in b.soft:
                held[k] = held.get(k, 0) + len(b.text)
    most = {k for k, n in held.items() if 2 * n > total}
    most -= {k for k in most if any(b.main and not b.chrome and all(k != x for x, _ in b.soft) for b in page)}
    for b in page:
        if most and b.soft:
            b.soft = tuple(x for x in b.soft if x[0] not in most)
    return page


FEATURES = 9


def features(page: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: its text and place, not the elements it learns from."""
    out = np.empty((len(page), FEATURES))
    longest = max((len(b.text) for b in page), default=1)
    for i, b in enumerate(page):
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        out[i] = (
            1.0, min(1.0, b.link / n), np.log1p(n) / 5, min(words, 60) / 60, min(1.0, 10 * (t.count(".") + t.count(",")) / n), t[-1] in ".!?:;\"'”»",
            n / longest, "©" in t or "copyright" in t.lower(), b.tag == "li",
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 25, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method. Without both classes the weights rest on length and links."""
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, -5.0, 2.0, 2.0, 2.0, 1.0, 1.0, -2.0, -1.0])
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut (Dinic's algorithm).

    ``source`` and ``sink`` are capacities from the source and to the sink; edges carry both ways. The
    smallest source side is returned, so a tie goes to the sink.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, there: float, back: float) -> None:
        near[u].append(len(to))
        to.append(v)
        cap.append(there)
        near[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):
        # What could pass straight through is passed at once.
        least = min(source[i], sink[i])
        if source[i] > least:
            add(s, i, source[i] - least, 0.0)
        elif sink[i] > least:
            add(i, t, sink[i] - least, 0.0)
    for u, v, c in edges:
        add(u, v, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in near[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        pointer = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                pushed = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= pushed
                    cap[e ^ 1] += pushed
                cut = next(k for k, e in enumerate(path) if cap[e] <= eps)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while pointer[u] < len(near[u]):
                e = near[u][pointer[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                pointer[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                pointer[u] += 1
                continue
            path.append(e)
            u = to[e]


def _common(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def costs(page: list[Block], weights: np.ndarray) -> list[float]:
    """What speaks for each block being content: the classifier's margin and the priors of the markup."""
    margin = np.clip(features(page) @ weights / 2, -MARGIN, MARGIN)
    has_main = any(b.main and not b.chrome and not b.soft for b in page)
    out = []
    for b, m in zip(page, margin.tolist(), strict=True):
        m += PRIORS["heading"] * b.heading
        if b.chrome:
            m += PRIORS["element"]
        elif b.soft:
            plain = any(x for _, x in b.soft)
            m += PRIORS["plain name"] if plain else PRIORS["name"]
            if has_main and not plain:
                m += PRIORS["article" if b.main else "outside"]
        elif has_main:
            m += PRIORS["article" if b.main else "outside"]
        out.append(m)
    return out


def label(page: list[Block], weights: np.ndarray, smooth: float = SMOOTH, bound: float = 1e6) -> list[bool]:
    """Which blocks are content, by the cut of least cost."""
    if not page:
        return []
    cost = costs(page, weights)
    source = [0.0 if b.hidden else max(0.0, c) for b, c in zip(page, cost, strict=True)]
    sink = [bound if b.hidden else max(0.0, -c) for b, c in zip(page, cost, strict=True)]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            a = page[i - 1]
            apart = len(a.path) + len(b.path) - 2 * _common(a.path, b.path)
            edges.append((i - 1, i, smooth / (1 + apart)))
        parent = b.path[-1] if b.path else 0
        k = last.get(parent)
        if k is not None and k < i - 1:
            edges.append((k, i, smooth / 2))
        last[parent] = i
    return min_cut(source, sink, edges)


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text: content blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page in batch["html"]:
            found = blocks(page or "")
            if found:
                x = features(found)
                rows += [(list(map(float, x[i])), float(b.main and not b.chrome and not b.soft)) for i, b in enumerate(found) if b.main or b.chrome or b.soft]
        if rows:
            yield pd.DataFrame({"x": [r[0] for r in rows], "y": [r[1] for r in rows]})


def train(pages: DataFrame) -> np.ndarray:
    """Weights from the blocks of the ``MAX_TRAIN_PAGES`` pages with the smallest hash of their id."""
    ids = hash_sample(pages.select(F.col("page_id").alias("__id")).filter("__id IS NOT NULL"), "__id", MAX_TRAIN_PAGES)
    # The chosen ids are few by the limit above, so they are sent to the pages and not the pages to them.
    sample = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("__id"), "left_semi")
    got = sorted((tuple(r["x"]), r["y"]) for r in sample.mapInPandas(_examples, "x array<double>, y double").collect())
    return fit(np.array([g[0] for g in got]).reshape(len(got), FEATURES), np.array([g[1] for g in got]))


def extract_pages(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    # Ids travel as text: pandas would turn whole numbers with nulls among them into floats.
    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(p, weights) for p in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = slim.mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
