"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures.

A page is read once from left to right.  Block-level tags end a text block; inline tags and line breaks do not.
The classifier sees the word counts and link densities (share of words inside links) of a block and of the blocks
before and after it.  What these leave open is settled by elements: whether the block stands in an article, in an
element for something else (navigation, footer, form ... or a class that names such a part), is a heading or a list item.

The tree is a CART with Gini impurity in two stages: it splits by the six figures as long as these tell the rows apart, then
by the kinds of elements.  It is trained here on LABELLED_PAGES, a small labelled table of blocks, so the work on the
pages to extract is a plain map without any shuffle.

Defined cases: null or empty html gives an empty text.  Script, style, title, comments and other contents that
are no text are dropped, also unclosed ones.  A quote that never closes is an ordinary character; a tag that never
closes ends the page.  Reading takes time in proportion to the page, whatever it holds.  Repeated rows and null ids
are kept; an empty table gives an empty result.  The columns named in ``keep`` pass through; the others, also those
named text, n_chars or __html, do not matter.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: From behind a tag's name to its end: a quote counts only as the first character of a value.
REST = re.compile(r"""[^=>]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^=>]*+)*+>""")
#: Character references by number that are longer than any character's.
LONG_REFERENCE = re.compile(r"&#(?:\d{8,}+|[xX][0-9a-fA-F]{7,}+);?")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
#: Elements by kind (fixed values of the format).
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "th", "ul", "ol", "dl", "blockquote", "figure", "fieldset", "details", "dialog", "menu", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OTHER_ELEMENTS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "option"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: The parts of a page that are never its article, as classes name them (fixed values).
PARTS = {"ad", "advert", "comment", "comments", "footer", "form", "header", "menu", "notice", "sidebar"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    other: bool
    article: bool
    heading: bool
    item: bool
    keep: bool


class Element(NamedTuple):
    """An open element; its flags hold for all inside it."""

    name: str = ""
    other: bool = False
    article: bool = False
    link: bool = False
    heading: bool = False
    item: bool = False
    keep: bool = False


class OpenElements:
    """The stack of open elements, with the places of each name and of the containers, so that no look-up walks it."""

    def __init__(self):
        self.stack, self.places, self.containers = [Element()], defaultdict(list), []

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def push(self, element: Element) -> None:
        self.places[element.name].append(len(self.stack))
        if element.name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append(element)

    def close(self, name: str, within: bool) -> None:
        """Close the last open ``name`` and all inside it; ``within``: only if no container was opened after it."""
        if not self.places[name] or (within and self.containers and self.containers[-1] > self.places[name][-1]):
            return
        to = self.places[name][-1]
        while len(self.stack) > to:
            gone = self.stack.pop().name
            self.places[gone].pop()
            if gone in CONTAINERS:
                self.containers.pop()


def pieces(page: str) -> Iterator[tuple[str, str | None, str]]:
    """(text, None, ""), or ("" or "/", tag name, attributes), in page order, without comments and declarations."""
    at, size, begin = 0, len(page), 0
    while (at := page.find("<", at)) >= 0:
        tag = NAME.match(page, at)
        if tag is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if at > begin:
            yield page[begin:at], None, ""
        if tag is not None:
            end = REST.match(page, tag.end())
            if end is None:
                return
            at = begin = end.end()
            yield "/" * (page[tag.start() + 1] == "/"), tag[1].lower(), page[tag.end() : at - 1]
            name = tag[1].lower()
            if name in RAW and page[tag.start() + 1] != "/" and page[at - 2] != "/":
                end = _closing(name).search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                at = begin = at or size
        elif page.startswith("<!--", at):
            short = re.compile("-?>").match(page, at + 4)
            end = short or re.compile("--!?>").search(page, at + 4)
            at = begin = end.end() if end else size
        else:
            at = begin = page.find(">", at) + 1 or size
    if begin < size:
        yield page[begin:], None, ""


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def unescaped(text: str) -> str:
    """``text`` with its character references decoded; numbers beyond all characters give the replacement character."""
    return html.unescape(LONG_REFERENCE.sub(_replaced, text)) if "&" in text else text


def _replaced(reference: re.Match) -> str:
    digits = reference[0][2:].rstrip(";").lower().lstrip("x0")
    return f"&#{'x' * (reference[0][2] in 'xX')}{digits or '0'};" if len(digits) < 8 else "\ufffd"


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_ = OpenElements()
    state = open_.top

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.split()) for t, link in parts if link)
                found.append(Block(text, text.count(" ") + 1, linked, state.other, state.article, state.heading, state.item, state.keep))
            parts = []

    for lead, name, rest in pieces(page):
        if name is None:
            if not parts or not open_.top.link:
                state = open_.top
            parts.append((unescaped(lead), open_.top.link))
            continue
        if name == "br":
            parts.append(("\n", False))
        if name not in INLINE and name not in RAW:
            close_block()
        if lead:
            open_.close(name, name not in CONTAINERS)
        elif name not in RAW and name not in VOID:
            if name not in INLINE:
                open_.close("p", True)
            if name in ("a", "li", "dt", "dd", "option"):
                open_.close(name, True)
            open_.push(_element(name, rest, open_.top))
    close_block()
    return found


def _element(name: str, attributes: str, around: Element) -> Element:
    other = around.other or name in OTHER_ELEMENTS or (name == "header" and not around.article)
    article, keep = around.article or name in ("article", "main"), around.keep
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            other = other or not PARTS.isdisjoint(value.split())
        elif key == "role":
            other, article = other or value in OTHER_ROLES, article or value in ("main", "article")
        elif key == "keep":
            keep = True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", ""):
            other = True
    return Element(name, other, article, around.link or name == "a", around.heading or name in HEADINGS, around.item or name == "li", keep)


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of the one before, itself and the one after; place and kind."""
    words = np.array([0, *(b.words for b in page), 0], float)
    density = np.array([0, *(b.linked for b in page), 0]) / np.maximum(1, words)
    flags = np.array([(b.other, b.article, b.heading, b.item) for b in page], float).reshape(-1, 4)
    return np.column_stack([words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:], flags])


@dataclass
class Node:
    """A split (rows with at most ``at`` in column ``by`` go to ``low``) or, without one, a leaf."""

    keep: bool
    by: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.keep)
        below = x[:, self.by] <= self.at
        out = np.empty(len(x), bool)
        out[below], out[~below] = self.low.decide(x[below]), self.high.decide(x[~below])
        return out


FIGURES = 6
#: Rows that a leaf of figures has at least, of which all but one in 50 agree where nothing more is asked.
LEAST, AGREED = 4, 0.02


def _best_split(x: np.ndarray, y: np.ndarray, columns: range, least: int) -> tuple[int, float]:
    """The first column and value of the lowest Gini impurity; -1 if no split lowers it."""
    best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for by in columns:
        values = np.unique(x[:, by])
        for at in (values[:-1] + values[1:]) / 2:
            below = x[:, by] <= at
            n, m = below.sum(), (~below).sum()
            if min(n, m) >= least:
                p, q = y[below].mean(), y[~below].mean()
                impurity = p * (1 - p) * n + q * (1 - q) * m
                if impurity < best[0]:
                    best = impurity, by, at
    return best[1], best[2]


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = LEAST) -> Node:
    """A CART in two stages: word counts and link densities first, kinds of elements for what these leave open."""
    node = Node(2 * y.sum() > len(y))
    if min(y.mean(), 1 - y.mean()) <= (AGREED if depth > -3 else 0):
        return node
    by, at = _best_split(x, y, range(FIGURES), least) if depth > 0 else (-1, 0.0)
    if by < 0:
        depth = min(depth, 0)
        by, at = _best_split(x, y, range(FIGURES, x.shape[1]), 1)
    if by >= 0:
        node.by, node.at = by, at
        below = x[:, by] <= at
        node.low, node.high = train(x[below], y[below], depth - 1, least), train(x[~below], y[~below], depth - 1, least)
    return node


#: The labelled table, a page a line and a block a word: its kind and its number of words, of which the part after a
#: colon stands in links.  Kept: h (heading), p, q (a paragraph in no article), t (list item).  Not kept: n (navigation item, all linked),
#: l (a link in a plain block), d (a plain block), a (aside), r (a reader's comment in the article), c (one behind it), f (footer), x (form), m (header).
LABELLED_PAGES = """
n1 n1 n2 n1 d8 h9 p14 p68 p92 p26 p8 f11
n1 n1 n1 d5 h6 p7 p33 p30 p45 p5 p1 f8
n1 n1 d4 h11 p16 p50 p46 p19 f7
n2 n1 n1 n1 n1 d12 h7 p120 p2 p85 p15 f9
n1 n1 n1 n1 d7 h12 p3 p11 p240 p4 p20 f14
n1 n2 n1 d10 h4 p61 p1 p1 p48 p24 f5
n1 n1 n1 n1 n1 n1 d3 h8 p9 p31 p210 p9 f12
n1 n1 d15 h10 p22 p94 f4
n1 n1 n1 d6 h5 p18 p6 p13 p2 f16
n1 n1 n1 n1 d9 h13 p35 p64 p5 p41 f10
n1 n1 n1 n1 n1 d6 h3 p2 p77 p12 p150 f6
n2 n2 n1 d8 h9 p40 p40 p3 f20
n1 n1 n1 d2 h7 p11 p56 p76 p17 f3
n1 n1 n1 n1 d11 h6 p28 p1 p19 p9 f9
n3 n2 n1 d14 h8 p82 p22 p58 f13
n1 n1 d5 h14 p6 p6 p33 p71 f8
l1 l2 l1 d4 q31 q9 q66 q3 q40 d5
l1 l1 d3 q24 q52 q4 q18 l2 d6
l2 l2 l1 d5 q80 q2 q12 q33 d3 l4 d4
l1 l1 l1 d2 q45 q120 q7 l2 l3
l1 l3 d6 q28 q4 q4 q90 q15 l1 d7
l1 d3 q60 q31 q2 q27 d4
n1 n1 n2 h8 p30:2 p44 p12 f7
n1 n1 h6 p70 p9:4 p33 p5 f10
m4 n1 n1 n1 h7 p20 p4 p51 f6
m3 n2 n1 h9 p31 t3 t4 t5 p22 f9
m2 n1 n1 h5 p17 h3 p62 h2 p9 f8
n1 n1 h8 p4:4 p35 t2 t2:2 p10 p7:7 f6
n1 n2 h4 p16 p12:12 p80 p3 f11
n1 n1 n1 d7 h6 p25 p18 p30 f9 f6
n1 n1 h5 p44 p21 c9 c30 c4 f7
n1 n1 n1 h9 p12 p57 p8 c14 c22 f5
n1 n1 h7 p33 p20 a2 a4:4 a5:5 f6
n1 n1 a25 h6 p31 p46 p2 f8
n1 d30 h8 p22 p9 p61 f9
n1 n1 x3 x18 h5 p27 p14 f7
n1 n1 n1 d8 h6 p19 p40 x2 x20 x1 f9
h8 p40 p21
h6 p9 p55 p18
h6 p12 p31 p2
n1 n1 h9 p44 p5
n2 h7 p16 p38 p6 p3
l1 l1 d4 q50 q3
n1 n1 n1 d7 h8 p21 p6 p34 f6 f1
n1 n1 h6 p30 p48 d3 d1
n1 n2 d9 h5 p52 p11 f1
l1 l2 d3 q36 q18 d1
n1 h7 p25 p60 f4 d1
n1 n1 n1 d9 h20 p28 p40 f7
n1 n1 n1 n1 d12 h24 p30 p9 p52 f9
n1 n1 d7 h19 p45 p33 f12
n1 n1 n1 d10 h31 p61 p8 f6
n1 d1 h3 p3 p4 r1 p1 f3
n1 n1 d2 h4 p5 p2 r2 p3 f2
n2 d1 h2 p6 r1 p2 p9 f3
h2 p2 p3 p2 p2
h3 p2 p4 p3 p2
n1 h2 p3 p2 p3
h4 p6 p2 p4 p2
l1 l2 d2 q25 q3 q50 q2 q27 d3 l1 d4
l2 l2 d3 q40 q5 q21 q64 d2 l2 d3
l3 l1 l2 d2 q33 q3 q45 d4 l2 l2 d2
l2 l3 d4 q28 q60 q4 q36 d5 l1 d1
q33 q41 q58
n1 n1 h7 p25 p41 r2 r6 p12 f9
n1 n1 d6 h9 p30 p14 r1 p6 f5
d3 l2 l1
l1 d3 l4 d2
""".split("\n")[1:-1]
_TAGS = {"h": "h1", "t": "li", "n": "li", "a": "aside", "f": "footer", "x": "form", "m": "header", "r": "div class=comment"}


def labelled_page(line: str) -> str:
    """The page that a line of the labelled table stands for; blocks to keep are marked."""
    page, inside = "", False
    for word in line.split():
        kind, (words, _, linked) = word[0], word[1:].partition(":")
        linked = words if kind in "nl" else linked or "0"
        if inside != (kind in "hptr"):
            page, inside = page + ("<article>" if not inside else "</article>"), not inside
        tag, rest = _TAGS.get(kind, "p"), int(words) - int(linked)
        block = f"<{tag}{' keep' * (kind in 'hpqt')}>{'w ' * rest}<a>{'w ' * int(linked)}</a></{tag.split()[0]}>"
        page += f"<nav>{block}</nav>" if kind == "n" else block
    return f"<body>{page}</body>"


@cache
def classifier() -> Node:
    pages = [blocks(labelled_page(line)) for line in LABELLED_PAGES]
    return train(np.concatenate([features(p) for p in pages]), np.array([b.keep for p in pages for b in p], float))


def main_texts(pages: list[str | None], tree: Node) -> list[str]:
    """The main text of each page, its blocks joined by line ends."""
    made = [blocks(p or "") for p in pages]
    rows = [features(p) for p in made]
    chosen = tree.decide(np.concatenate(rows)) if rows else np.zeros(0, bool)
    out, at = [], 0
    for page in made:
        out.append("\n".join(b.text for b, ok in zip(page, chosen[at : at + len(page)], strict=True) if ok))
        at += len(page)
    return out


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, and text and n_chars (code points) of every row."""
    tree = classifier()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(part.num_columns - 1).to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*part.schema.names[:-1], "text", "n_chars"])

    src = pages.select(*keep, F.col(column).cast("string").alias("__html"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}text string, n_chars bigint")


def op4_html_blocks(spark, sf_dir: str) -> DataFrame:
    """Main text of every page; null or empty html gives an empty text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
