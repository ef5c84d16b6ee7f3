"""Operator 12: main text of web pages from flat text blocks.

A page is read once, tag by tag, into a flat list of text blocks in page order. A block is the text between two block-level
tags; inline tags don't end one, and line breaks are white space. Its features are its words and its share of words in links, the same of the
block before and after it, and what the containers around it say (article or main text, page furniture, reader comments,
headings, list items, and whether the page marks an article at all). A decision tree, trained on a small labelled table of
blocks, tells main text from the rest. The tree has seen each kind of container with many lengths and neighbours, so a short
paragraph inside an article stays and a long advert beside it goes; pages without telling containers are judged by lengths
and link shares. Tasks hold bounded slices of pages; nothing is shuffled.

Defined results: null and empty pages, and pages without main text, have an empty text; repeated rows each give a row; ids
and urls may be null; character references are decoded once, as browsers do; unclosed tags and comments end with the page;
other columns are ignored, whatever their names; empty tables give no rows. Whole pages are read, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwright.llm import flat

# Elements that don't end a block, that hold no text of the page, that never have an end, and what elements
# and the words in their class, id and role say about the text in them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg iframe object textarea select title canvas audio video math noframes datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav aside footer form button dialog menu head fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_WORDS = frozenset("ad ads adv advert advertisement advertising adsense alert announcement banner breadcrumb breadcrumbs consent contentinfo complementary cookie cookies copyright disclaimer dropdown foot footer form gdpr head header infobar login logo masthead menu modal nav navbar navigation newsletter notice notification notifications overlay pager pagination paywall popup privacy promo promoted promotion recommended related search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe toc toolbar topbar tracking widget".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply responses reviews".split())
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post prose story text".split())
HEADER_WORDS = frozenset("head header".split())
NEGATIONS = frozenset("has no with without is show hide".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "in_main", "in_furniture", "in_comments", "heading", "item", "page_marked")
MAIN, FURNITURE, COMMENTS, PLAIN = 1, 2, 3, 0

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")


@dataclass
class Block:
    """A text block: its text, words, words in links, and what stands around it."""

    text: str
    words: int
    linked: int
    around: int
    heading: bool
    item: bool


def _wide(text: str) -> int:
    """Words to add for scripts that don't part them by spaces: one for two characters."""
    try:
        text.encode("latin-1")  # most texts, told much faster than by a search
    except UnicodeEncodeError:
        return len(_WIDE.findall(text)) // 2
    return 0


def hint(name: str, attributes: str) -> int:
    """What an element says about the text in it by its name and its class, id, role and visibility."""
    kind = FURNITURE if name in FURNITURE_TAGS else MAIN if name in MAIN_TAGS else PLAIN
    if not attributes.strip(" /\n\t"):
        return kind
    if name in ("html", "body"):  # their classes tell of the page's layout
        return kind
    told: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return FURNITURE
        for token in value.split() if key != "style" else ():
            words = [w.lower() for w in _WORD.findall(token)]
            ends = {words[0], words[-1], token.lower()} if words and words[0] not in NEGATIONS else set()
            if not (ends & HEADER_WORDS and ends & MAIN_WORDS):  # the header of an article belongs to it
                told |= ends
    if told & COMMENT_WORDS:
        return COMMENTS
    if told & FURNITURE_WORDS and (kind == PLAIN or name == "article"):
        return FURNITURE
    return MAIN if kind == PLAIN and told & MAIN_WORDS and name not in INLINE else kind


def _within(around: int, name: str, kind: int) -> int:
    """What stands around the text of an element, given what stands around the element."""
    if name == "header":  # of the page, or of the article that it stands in
        return around if around in (MAIN, COMMENTS) else FURNITURE
    if kind == PLAIN or around == COMMENTS and name != "main":
        return around
    if around == FURNITURE and kind == MAIN:  # a label such as class="body" doesn't make an advert the article
        return MAIN if name in MAIN_TAGS else FURNITURE
    return kind


class _Open:
    """The elements that are open where a page is being read, and what they say about the text there."""

    def __init__(self) -> None:
        self.around = PLAIN
        self.names: list[str] = []
        self.outer: list[int] = []  # what stood around each of them
        self.count: dict[str, int] = {}
        self.furniture = 0

    def push(self, name: str, around: int) -> None:
        self.names.append(name)
        self.outer.append(self.around)
        self.count[name] = self.count.get(name, 0) + 1
        self.furniture += name in FURNITURE_TAGS
        self.around = around

    def pop(self) -> str:
        name = self.names.pop()
        self.around = self.outer.pop()
        self.count[name] -= 1
        self.furniture -= name in FURNITURE_TAGS
        return name

    def close(self, name: str) -> None:
        """An end tag: of the nearest such element, unless a block-level one inside an inline one is open."""
        if not self.count.get(name):
            return
        if name in INLINE:
            k = len(self.names) - 1
            while self.names[k] in INLINE and self.names[k] != name:
                k -= 1
            if self.names[k] != name:
                return
        while self.pop() != name:
            pass

    def implied(self, name: str) -> None:
        """The end of an open element that a start tag of the same name implies."""
        k = len(self.names) - 1
        while k >= 0 and (self.names[k] in INLINE or self.names[k] == "p" != name):
            k -= 1
        if k >= 0 and self.names[k] == name:
            self.close(name)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order; its length times a constant in work, however its tags are nested or broken."""
    found: list[Block] = []
    held: list[tuple[str, bool]] = []
    opened, links, heading, at, size = _Open(), 0, False, 0, len(page)
    tag, ends, endless = _TAG, {}, set()

    def end() -> None:
        if not held:
            return
        words = "".join(t for t, _ in held).split()
        if words:
            text = " ".join(words)
            found.append(Block(text, len(words) + _wide(text), sum(len(t.split()) + _wide(t) for t, linked in held if linked), opened.around, heading, opened.count.get("li", 0) > 0))
        held.clear()

    def after(mark: str, start: int) -> int:
        """Where the next ``mark`` ends; the page's end without one."""
        if ends.get(mark, -1) < start:
            where = page.find(mark, start)
            ends[mark] = where if where >= 0 else size
        return min(ends[mark] + len(mark), size)

    while at < size:
        start = page.find("<", at)
        start = start if start >= 0 else size
        if start > at:
            held.append((unescape(page[at:start]), links > 0))
        if start == size:
            break
        if page.startswith("<!--", start):
            at = after("-->", start + 4)
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = after(">", start + 2)
            continue
        if not page[start + 1 : start + 3].removeprefix("/")[:1].isalpha():  # not a tag: an end without a name, or text
            if page.startswith("</", start):
                at = after(">", start + 2)
            else:
                held.append(("<", links > 0))
                at = start + 1
            continue
        if after(">", start) == size and not page.endswith(">"):
            break  # an unfinished tag
        m = tag.match(page, start)
        if m is None:
            tag = _LOOSE  # a quote that is never closed: from here on tags end at the next mark
            if (m := tag.match(page, start)) is None:
                held.append(("<", links > 0))
                at = start + 1
                continue
        at, name, closing = m.end(), m[2].lower(), m[1] == "/"
        if name not in INLINE:
            end()
        if closing:
            if opened.count.get(name) and name in INLINE:
                before, places = opened.around, len(held)
                opened.close(name)
                if opened.around != before and places:
                    inner, opened.around = opened.around, before
                    end()
                    opened.around = inner
            else:
                opened.close(name)
            links = 0 if name == "a" else links
            heading = heading and name not in HEADINGS
            continue
        if name in SILENT:
            if name in endless or m[3].endswith("/") and name in ("svg", "math"):
                continue
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if shut is not None:
                at = after(">", shut.end())
            else:
                endless.add(name)
                at = size if name in ("script", "style") else at
            continue
        if name in VOID:
            if name == "br":
                held.append((" ", False))
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th"):
            opened.implied(name)
        if name in MAIN_TAGS and opened.around == FURNITURE and not opened.furniture:
            opened.around = PLAIN  # what a class says of an element that was never closed ends where the article begins
        inner = _within(opened.around, name, hint(name, m[3]))
        if inner != opened.around:
            end()
        opened.push(name, inner)
        links = 1 if name == "a" else links
        heading = heading or name in HEADINGS
    end()
    return found


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row of ``FEATURES`` for every block of every page, by page."""
    rows = []
    for blocks in pages:
        if not blocks:
            continue
        words = np.array([b.words for b in blocks], float)
        linked = np.array([b.linked for b in blocks], float) / np.maximum(words, 1)
        around = np.array([b.around for b in blocks])
        before, after = np.r_[0, words[:-1]], np.r_[words[1:], 0]
        marked = np.full(len(blocks), float((around == MAIN).any()))
        rows.append(np.stack([words, linked, before, np.r_[0, linked[:-1]], after, np.r_[linked[1:], 0], around == MAIN, around == FURNITURE, around == COMMENTS, [b.heading for b in blocks], [b.item for b in blocks], marked], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Tree:
    """A decision tree as arrays: feature (-1: leaf), threshold, the two branches, and the share of main text."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    share: np.ndarray

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """The share of main text in the leaf of every row."""
        at = np.zeros(len(rows), np.int64)
        while (inside := self.feature[at] >= 0).any():
            some = np.flatnonzero(inside)
            node = at[some]
            at[some] = np.where(rows[some, self.feature[node]] <= self.threshold[node], self.below[node], self.above[node])
        return self.share[at]


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 16, least: int = 3) -> Tree:
    """A tree by Gini impurity; the first feature and lowest threshold of equally good splits count."""
    nodes: list[list[float]] = []

    def grow(chosen: np.ndarray, depth: int) -> int:
        place, y = len(nodes), labels[chosen]
        nodes.append([-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0])
        if not depth or len(chosen) < 2 * least or y.min() == y.max():
            return place
        best = (1e-9, -1, 0.0)
        for f in range(rows.shape[1]):
            x = rows[chosen, f]
            order = np.argsort(x, kind="stable")
            x, ones = x[order], np.cumsum(y[order])
            n = np.arange(1, len(x))
            left, total = ones[:-1], ones[-1]
            gain = 2 * len(x) * (left / n - total / len(x)) ** 2 * n / (len(x) - n) / len(x)
            gain[(x[1:] == x[:-1]) | (n < least) | (len(x) - n < least)] = -1
            if len(gain) and gain.max() > best[0] + 1e-12:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((x[k] + x[k + 1]) / 2))
        if best[1] < 0:
            return place
        _, f, threshold = best
        low = rows[chosen, f] <= threshold
        nodes[place][:4] = [f, threshold, grow(chosen[low], depth - 1), grow(chosen[~low], depth - 1)]
        return place

    grow(np.arange(len(labels)), depth)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def labelled_pages(pages: int = 900, seed: int = 12) -> list[list[tuple[Block, int]]]:
    """The labelled table: blocks of so many pages with 1 for main text, made by the rule below.

    Half of the pages mark their article and half don't. A page has a menu of links, a notice or advert, an article of a
    heading and paragraphs of any length, some with links or list items, perhaps furniture between them, then related
    links, comments and a footer; all but the article may be absent.
    """
    random = np.random.default_rng(seed)
    often = lambda share: bool(random.random() < share)
    length = lambda low, high: int(np.exp(random.uniform(np.log(low), np.log(high))))
    out = []
    for k in range(pages):
        marked, rows = k % 2 == 0, []

        def add(label: int, words: int, linked: float, around: int, heading: bool = False, item: bool = False, rows=rows) -> None:
            rows.append((Block("", words, round(words * linked), around, heading, item), label))

        told = often(0.5)  # whether containers of furniture tell what they are
        outside = FURNITURE if told else PLAIN
        for _ in range(int(random.integers(2, 9)) if often(0.6) else 0):
            add(0, length(1, 5), 1.0, outside, item=often(0.8))
        for _ in range(int(random.integers(0, 3))):
            add(0, length(2, 60 if told or marked else 8), 0.0, outside)
        inside = MAIN if marked else PLAIN
        if often(0.6):
            add(1, length(2, 15), 0.0, inside, heading=True)
        for _ in range(length(1, 14)):
            if often(0.12):
                add(0, length(1, 80), float(often(0.5)), FURNITURE)
            if often(0.15):
                add(1, length(1, 12), 0.0, inside, heading=True)
            add(1, length(1 if marked else 8, 300), float(random.choice((0.0, 0.3, 1.0), p=(0.8, 0.15, 0.05) if marked else (0.85, 0.15, 0.0))), inside, item=often(0.1))
        for _ in range(int(random.integers(0, 5)) if often(0.5) else 0):
            add(0, length(2, 12), 1.0, outside, item=often(0.6))
        if often(0.5):
            for _ in range(int(random.integers(1, 6))):
                add(0, length(1, 150), 0.0, COMMENTS)
        if often(0.6):
            add(0, length(2, 20), float(often(0.3)), outside)
        out.append(rows)
    return out


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    """The tree trained on the labelled table."""
    table = labelled_pages()
    return train(features([[b for b, _ in page] for page in table]), np.array([y for page in table for _, y in page]))


def main_text(pages: list[str], tree: Tree) -> list[str]:
    """The main text of every page: its blocks in page order, one a line."""
    found = [blocks_of(page) for page in pages]
    chosen = iter((tree.shares(features(found)) >= 0.5).tolist())
    return ["\n".join(b.text for b in blocks if next(chosen)) for blocks in found]


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", tree: Tree | None = None) -> DataFrame:
    """key, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(tree or default_tree())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, html):
            texts = main_text(flat.texts_of(batch, html), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return flat.map_batches(pages.select(key, url, html), run, flat.schema_of(pages, (key, url), "text string, n_chars long"))
