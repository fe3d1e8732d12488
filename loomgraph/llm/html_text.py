"""Main text of web pages from flat text blocks.

A page is cut into blocks of text. Each has a few shallow features, above all its number of words
and link density and those of its neighbours, and a decision tree, trained on a small table of
labelled blocks, tells content from boilerplate. Pages are independent rows, so Spark needs no
shuffle: parsing runs in Arrow batches wherever the pages are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is text, not markup, up to their end tag; none of it is text of the page.
_RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + _RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr meta link svg math noscript mi mo mn ms mrow mfrac msup msub msqrt mtext semantics annotation g path tspan".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog button head select template".split())
_MAIN = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of single texts: what their names hint at is weak.
_TEXTS = _HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption span a em strong".split())
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Words of which class names, ids and roles of boilerplate consist. Those of ``_REPLIES`` hold even around articles.
_REPLIES = frozenset("comment comments reply replies respond disqus related".split())
_BAD = _REPLIES | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies"
    " consent notice alert popup modal newsletter subscribe share sharing social login search complementary contentinfo".split()
)
#: Words that say what part of a page something is, and nothing about what is in it; with words of boilerplate they make a name of boilerplate.
_PARTS = frozenset(
    "box area block blocks wrap wrapper container list bar inner outer item items link links button buttons icon icons top bottom left right site page pages global main primary secondary slot unit zone section content"
    " panel row col column thread form signup post posts entry article articles story stories blog news count meta policy sticky fixed inline media tools tool module mod region group body title text message overlay toggle body root layout"
    " rail desktop mobile google native space placeholder label image img video player feed more latest popular user users reader readers".split()
)
_STATES = frozenset("has no with without is not".split())
_OF_TEXT = frozenset("post entry article story title page section".split())
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def _hinted(attrs: str, in_main: bool) -> tuple[str | None, bool]:
    """The word of boilerplate that an element's class names, id or role hold, if any, and whether the whole name is of such words.

    Whole names count, and parts of class names that aren't states (has-sidebar) or parts of a text
    (post-header); a header within an article is its own. An id counts in whole, without its number. A name is of boilerplate if its other
    parts are only such as say what part of a page it is, or a short prefix: comment-list and xy-share are, social-science isn't.
    """
    part = None
    for kind, value in _NAMES.findall(attrs):
        for name in value.strip("\"'").lower().split():
            parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
            if not parts or parts[0] in _STATES or (kind.lower() != "class" and len(parts) > 1 and not parts[-1] in _BAD):
                continue
            for x in parts:
                if x in _BAD and not (x in ("header", "notice", "search") and (in_main or parts[0] in _OF_TEXT) and (len(parts) > 1 or x == "header")):
                    if all(y in _BAD or y in _PARTS or (i == 0 and len(y) <= 3) for i, y in enumerate(parts)):
                        return x, True
                    part = part or x
    return part, False


#: How lines begin that say whose a page is.
_OWNER = re.compile(r"\W{0,3}(?:©|\(c\)|copyright\b)", re.I)
#: Words that such a line has at most.
_OWNER_WORDS = 30


FEATURES = ("place", "aside", "heading", "words", "link_density", "words_before", "links_before", "words_after", "links_after")

#: Labelled blocks. place: 1 in an article or main element, -1 outside one that the page has, 0 on a
#: page without; aside: 1 in a menu, header, footer, form, advert, notice or comment element, 0.5 if only
#: the name of the text's own element says so. A number of words stands for all around it, as training
#: adds the neighbours within a tenth.
LABELLED = """
place aside heading words link words_before links_before words_after links_after content
1 0 1 8 0 0 0 60 0 1
1 0 1 3 0 40 0 80 0 1
1 0 0 60 0 8 0 90 0 1
1 0 0 1 0 70 0 40 0 1
1 0 0 2 0 3 0 2 0 1
1 0 0 4 1 60 0 60 0 1
1 0 0 12 0.9 20 0 3 1 1
1 0 0 150 0.1 90 0 0 0 1
1 0 0 25 0.3 2 1 5 0 1
1 0 0 6 0 6 1 0 0 1
1 0 0 2 0 0 0 0 0 1
1 0 0 3 0 3 0 3 0 1
1 0 0 1 0 20 0 0 0 1
1 0 0 6 0 8 0 120 0 1
1 0 0 8 0 20 0 20 0 1
1 0 0 5 1 60 0 3 1 1
1 0 0 8 0 60 0 60 0 1
1 0 0 4 0 0 0 8 0 1
1 0 1 4 0 0 0 6 0 1
1 0 1 6 0 4 0 0 0 1
1 0 0 30 0.8 30 0 3 1 1
1 0 0 30 0.1 3 1 3 1 1
1 0 0 3 0 60 0 60 0 1
1 0 0 2 1 60 0 2 0.5 1
1 0.5 0 40 0 60 0 60 0 1
1 0.5 0 30 0.1 8 0 25 0 1
1 0.5 0 25 0 60 0 0 0 1
1 0.5 1 4 0 0 0 60 0 1
1 0.5 1 6 0 40 0 80 0 1
1 0.5 0 3 0 60 0 60 0 0
1 0.5 0 8 0 20 0 20 0 0
1 0.5 0 5 1 60 0 3 1 0
1 0.5 0 30 0.8 30 0 3 1 0
1 0.5 0 30 0.1 3 1 3 1 0
1 1 0 9 0 60 0 60 0 0
1 1 0 3 1 60 0 3 1 0
1 1 0 40 0 20 0 20 0 0
1 1 1 2 0 80 0 30 0 0
1 1 0 120 0 60 0 10 0 0
0 0 1 7 0 0 0 60 0 1
0 0 1 9 0 3 1 70 0 1
0 0 0 60 0 7 0 80 0 1
0 0 0 35 0.05 60 0 30 0 1
0 0 0 90 0.1 2 1 0 0 1
0 0 0 40 0 2 1 2 1 1
0 0 0 24 0.1 1 1 1 1 1
0 0 0 80 0 4 1 3 1 1
0 0 0 16 0 3 1 2 1 1
0 0 0 22 0.2 40 0 25 0 1
0 0 0 5 0 50 0 60 0 1
0 0 0 3 0 30 0 40 0.1 1
0 0 0 14 0 50 0 12 0 1
0 0 0 12 0 14 0 2 1 1
0 0 0 2 1 2 1 2 1 0
0 0 0 1 1 0 0 1 1 0
0 0 0 4 1 1 1 60 0 0
0 0 0 3 1 50 0 2 1 0
0 0 0 5 0 2 1 2 1 0
0 0 0 6 0 3 1 0 0 0
0 0 0 30 0.8 5 1 5 1 0
0 0 0 18 0.6 3 1 40 0 0
0 0 0 7 0 0 0 2 1 0
0 0 1 2 0 3 1 2 1 0
0 0 1 1 0 2 1 30 0 1
0 0 1 4 0 2 1 60 0 1
0 0 1 2 0 40 0 40 0 1
0 0.5 0 60 0 60 0 60 0 1
0 0.5 1 5 0 2 1 60 0 1
0 0.5 0 30 0.1 3 1 3 1 0
0 0.5 0 8 0 60 0 60 0 0
0 0.5 0 4 1 3 1 3 1 0
0 1 0 50 0 40 0 10 0 0
0 1 0 10 0 60 0 60 0 0
0 1 0 3 1 3 1 3 1 0
0 1 1 3 0 0 0 20 0 0
-1 0 0 6 0 2 1 50 0 0
-1 0 0 40 0 60 0 4 0 0
-1 0 0 3 1 3 1 3 1 0
-1 0 1 3 0 2 1 10 0 0
-1 0 0 120 0 60 0 60 0 0
-1 0 0 12 0 80 0 0 0 0
-1 1 0 12 0 4 1 40 0 0
-1 1 0 3 1 3 1 3 1 0
-1 1 0 60 0.1 30 0 5 0 0
-1 1 1 4 0 2 1 8 0 0
"""


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table as features and labels, each row thrice: as it is, and with a tenth more and fewer words."""
    rows = np.array([line.split() for line in LABELLED.split("\n")[2:] if line], float)
    words = [FEATURES.index(f) for f in ("words", "words_before", "words_after")]
    grown = [rows.copy() for _ in range(3)]
    for r, factor in zip(grown, (1.0, 0.9, 1.1)):
        r[:, words] = np.round(r[:, words] * factor)
    rows = np.concatenate(grown)
    return rows[:, :-1], rows[:, -1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """A decision tree by Gini impurity: a leaf is the share of label 1, a node (feature, cut, left, right)."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (y.var() * len(y) - 1e-9, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            impurity = y[left].var() * left.sum() + y[~left].var() * (~left).sum()
            if impurity < best[0] - 1e-12:
                best = (impurity, (j, float(cut), left))
    if best[1] is None:
        return float(y.mean())
    j, cut, left = best[1]
    return j, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@cache
def default_tree():
    """The tree of the labelled table."""
    return grow(*labelled_blocks())


def _share(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class _Element:
    """An open element: what is known of the text in it."""

    __slots__ = ("tag", "up", "main", "heading", "link", "bad", "weak", "around")

    def __init__(self, tag: str, up: _Element | None, attrs: str):
        self.tag, self.up = tag, up
        self.main = tag in _MAIN or (up is not None and up.main)
        self.heading = tag in _HEADINGS or (up is not None and up.heading)
        self.link = tag == "a" or (up is not None and up.link)
        self.bad = self.weak = False
        self.around = False  # whether an article or main element in it makes it no boilerplate
        inside = up is not None and up.main
        if tag in _ASIDE or (tag == "header" and not inside) or _HIDDEN.search(attrs):
            self.bad, self.around = True, tag in ("form", "nav", "menu")  # none of them holds an article unless its end is missing
        elif "=" in attrs and tag not in ("html", "body"):
            word, whole = _hinted(attrs, inside or tag in _MAIN)
            if word and tag in _MAIN:
                self.bad = whole and (word in _REPLIES or word.startswith(("ad", "sponsor", "promo")))
            elif word and tag in _TEXTS:
                self.weak = True
            elif word and whole:
                self.bad, self.around = True, word not in _REPLIES

    def aside(self) -> float:
        at, weak = self, False
        while at is not None:
            if at.bad:
                return 1.0
            weak, at = weak or at.weak, at.up
        return 0.5 if weak else 0.0


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """The page's flat text blocks in page order, each with its features."""
    page = page or ""
    found: list[tuple[str, _Element | None, int, float]] = []
    stack: list[_Element] = []
    parts: list[str] = []
    linked = 0
    any_main = False

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            found.append((text, stack[-1] if stack else None, words, min(1.0, linked / words)))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if stack and stack[-1].link:
                linked += len(text.split())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        if tag not in _INLINE:
            close()
        if m["end"]:
            depth = len(stack) - 1
            while depth >= 0 and stack[depth].tag != tag:
                depth -= 1
            if depth >= 0:
                del stack[depth:]
        elif tag not in _VOID:
            attrs = m["attrs"] or ""
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
                stack.pop()
            if attrs.endswith("/") and tag not in ("a", "p", "div", "span"):
                continue
            element = _Element(tag, stack[-1] if stack else None, attrs)
            if tag in _MAIN and not element.bad:
                for outer in stack:
                    outer.bad = outer.bad and not outer.around
                any_main = any_main or not element.aside()
            stack.append(element)
    add(page[at:])
    close()
    owner = lambda text, e, words: (e is None or not e.main) and words <= _OWNER_WORDS and _OWNER.match(text) is not None
    known = [(e is not None and e.main, 1.0 if owner(text, e, words) else e.aside() if e is not None else 0.0, e is not None and e.heading, words, links) for text, e, words, links in found]
    edge = (0, 0, 0, 0, 0.0)
    out = []
    for i, (main, aside, heading, words, links) in enumerate(known):
        before, after = known[i - 1] if i else edge, known[i + 1] if i + 1 < len(known) else edge
        out.append((found[i][0], [1.0 if main else -1.0 if any_main else 0.0, aside, float(heading), words, links, *before[3:], *after[3:]]))
    return out


def main_text(page: str | None, tree=None) -> str:
    """The content blocks of a page, in order, joined by two newlines; empty if there are none."""
    tree = tree or default_tree()
    return "\n\n".join(text for text, row in blocks(page) if _share(tree, row) >= 0.5)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", tree=None) -> DataFrame:
    """``pages`` with each page's main text added as column ``name``.

    Null and empty pages give an empty text; every row stays, repeated ones too; a column that is
    already called ``name`` is replaced.
    """
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(p, tree) for p in s], dtype=object)

    return pages.withColumn(name, texts(F.col(html_col)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    Null and empty pages have an empty text; rows with null ids or urls and repeated rows stay, each with its result;
    pages of any length are read whole. Empty in, empty out.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
