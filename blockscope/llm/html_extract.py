"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block-level tags start a new line; a line has its text, its
number of tags and the block element that it stands in. The lines' ratios of text characters to tags are smoothed with a
Gaussian kernel; lines above the ratios' standard deviation cluster into content regions. A region grows to the outermost
article (else main) around its lines, or without these to the block element that its lines share, and from there to the
outermost element, the body included, that holds no text of the page's frame (navigation, headers, footers, sidebars). All
text of a region stays, short paragraphs, headings and further sections too, but for links: elements directly in the body
that are nothing but three links or more; and for loose lines: text directly in a division or the body, outside of any
article, before the first line that reaches the deviation by itself (half of it, smoothed) or after the last.

Tags and names are evidence that ratios can overrule. Scripts, styles and the like are never text. Navigation, headers,
footers and sidebars have none either, nor have elements whose class, id or role is made of words for adverts, notices,
menus or comments alone ("cookie-notice" or "user-reviews", not "related-work" or "notice-period"), nor forms. But an
element that its name speaks against is kept where it holds more than half of the page's text, little of that in links, at
a ratio no lower than the rest has; and within an article where it holds prose at half the page's ratio or more, unless it
is named for comments or adverts beyond doubt. A form is kept if it holds more than half of the page's text. Names of
comments count unless a main element stands inside.

A null or empty page, or one without such text, gives the empty text; an empty table gives no rows. Repeated rows are
extracted each. Columns other than the id, the address and the page are not read. A head ends where the first element or
text begins that it can't hold. Time is linear in the page's length, unclosed and deeply nested elements included; memory is
bounded by one page and a slice of pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockscope.llm.common import text_slices

#: Element names by their role in HTML, and words that name page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HIDDEN = {"aside", "button", "canvas", "datalist", "dialog", "footer", "head", "header", "iframe", "input", "label", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "contentinfo", "complementary",
    "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "responses", "reviews", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "thread", "toolbar", "topbar", "widget",
}
#: Words that say nothing about an element's kind, so that a name made of them and furniture still names furniture.
NEUTRAL = {
    "area", "article", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "form", "group", "holder", "icon", "icons", "inner", "item", "items", "js", "layout", "left", "link",
    "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "text", "title", "top", "user", "visitor", "wrap", "wrapper",
}
WHOLE = {"html", "body"}
FRAME = {"aside", "breadcrumb", "breadcrumbs", "complementary", "contentinfo", "copyright", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "sidebar", "sidenav", "toolbar", "topbar"}  # furniture of the page, not of an article in it
COMMENTS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "respond", "responses", "reviews", "thread"}
#: Words whose elements no ratio keeps within an article.
CERTAIN = {"ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "gdpr", "newsletter", "respond", "sponsored"}
LOOSE = {"div", "body"}
IN_HEAD = {"base", "head", "link", "meta", "noscript", "script", "style", "template", "title"}
LISTS = {"ul", "ol", "dl", "table", "select", "menu"}
NO_P = BLOCK - {"p"}
BODY = 0  # its number among the elements
LEAST_LINKS = 3
#: The fewest characters of prose.
PROSE = 100
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class LineParser(HTMLParser):
    """Collects the lines of a page, [text parts, tags, innermost block, characters in links, links], the elements that hold
    text of its frame, and what elements hold that their names speak against. Elements are numbered as they open."""

    def __init__(self, spared: set[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.spared = spared  # elements whose names don't count
        self.open: list[tuple[str, str, int, int]] = []  # (tag, what hides it, innermost visible block, innermost named element)
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.made = BODY
        self.up: dict[int, int] = {}  # the block around each block
        self.lines: list[list] = [[[], 0, BODY, 0, 0]]
        self.tags: dict[int, str] = {}  # of article and main elements
        self.framed: set[int] = set()
        self.named: dict[int, list] = {}  # [named element around, comments, characters, in links, tags, a main element inside, name, within an article]
        self.kinds: dict[int, str] = {BODY: "body"}  # of visible blocks
        self.article = False  # whether an article or main element shows text
        self.page = [0, 0]  # characters and tags outside of elements hidden by their tag

    def _line(self) -> None:
        if self.lines[-1][0] or self.lines[-1][1]:
            self.lines.append([[], 0, BODY, 0, 0])

    @staticmethod
    def _name(tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """The name by which an attribute makes the element furniture, or ''; "hidden" where it isn't shown."""
        if tag in WHOLE:
            return ""
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return "hidden"
            if name in ("class", "id", "role") and value:
                own = [v for v in value.split() if not v.lower().startswith(("has", "with", "no-"))]  # "has-sidebar" is a page's, not a sidebar's
                words = [[w.lower() for w in _NAMES.findall(v)] for v in own]
                found = [w for ws in words if FURNITURE.union(NEUTRAL).issuperset(ws) for w in ws if w in FURNITURE]
                if found:
                    return next((w for w in found if w in FRAME), found[0])
        return ""

    def _pop(self, names: set[str], stop: set[str]) -> None:
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                for tag, *_ in self.open[k:]:
                    self.count[tag] -= 1
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def _count_tag(self) -> None:
        self.lines[-1][1] += 1
        _, hides, _, named = self.open[-1] if self.open else ("", "", BODY, 0)
        if not hides or named:
            self.page[1] += 1
        if named:
            self.named[named][4] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count["head"] and tag not in IN_HEAD:
            self._pop({"head"}, set())
        if tag in BLOCK:
            self._line()
            if tag != "br":
                self._pop({"p"}, NO_P)
            if tag in CLOSES:
                self._pop(CLOSES[tag], LISTS)
        self._count_tag()
        if tag in VOID:
            return
        self.made += 1
        number, (_, hides, block, named) = self.made, self.open[-1] if self.open else ("", "", BODY, 0)
        certain = hides and not named  # hidden by a tag, not by a name
        if not certain:
            name = tag if tag in HIDDEN else self._name(tag, attrs) or ("form" if tag == "form" else "")
            if tag in HIDDEN or name == "hidden":
                hides, named = hides or name, 0
            elif name and number not in self.spared:
                self.named[number] = [named, name in COMMENTS, 0, 0, 0, False, "form" if tag == "form" else name, bool(self.count["article"] or self.count["main"])]
                hides, named = hides or name, number
            elif named and tag == "main":
                self.named[named][5] = True
        if tag in BLOCK and tag not in WHOLE and not hides:
            self.up[number] = block
            self.kinds[number] = tag
            block = number
        self.open.append((tag, hides, block, named))
        self.count[tag] += 1
        if tag in ("article", "main") and not hides:
            self.tags[number] = tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "g", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._count_tag()
        self._pop({tag}, set())
        if tag in BLOCK:
            self._line()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop({"head"}, set())
        _, hides, block, named = self.open[-1] if self.open else ("", "", BODY, 0)
        size = len("".join(data.split()))
        linked = size if self.count["a"] else 0
        if not hides or named:
            self.page[0] += size
        if named:
            self.named[named][2] += size
            self.named[named][3] += linked
        if hides:
            if hides in FRAME and size:
                self.framed.add(block)
            return
        line = self.lines[-1]
        line[0].append(data)
        line[2] = block
        self.article |= size > 0 and bool(self.count["article"] or self.count["main"])
        if linked:
            line[3] += linked
            line[4] += 1

    def wrongly_named(self) -> set[int]:
        """Elements that hold the page's text although their names speak against them."""
        found, (size, tags) = set(), self.page
        for number in sorted(self.named, reverse=True):  # inner ones first
            around, comments, n, linked, own, article, name, within = self.named[number]
            if around:
                for k, value in ((2, n), (3, linked), (4, own)):
                    self.named[around][k] += value
            dense = n * max(1, tags - own) >= (size - n) * max(1, own)
            if name == "form":
                keep = 2 * n > size
            elif within:
                keep = name not in CERTAIN and n >= PROSE and 2 * linked < n and 2 * n * max(1, tags) >= size * max(1, own)
            else:
                keep = not self.article and 2 * n > size and 2 * linked < n and dense and (article or not comments)
            if keep:
                found.add(number)
                if around and article:
                    self.named[around][5] = True
        return found


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def _parsed(page: str) -> LineParser:
    parser = LineParser()
    parser.feed(page)
    parser.close()
    spared = parser.wrongly_named()
    if spared:
        parser = LineParser(spared)
        parser.feed(page)
        parser.close()
    return parser


def _shared(a: int, b: int, up: dict[int, int]) -> int:
    """The innermost block around both (a block opens after those around it)."""
    while a != b:
        a, b = min(a, b), up[max(a, b)]
    return a


def main_text(page: str, sigma: float = 1.0) -> str:
    parser = _parsed(page)
    lines = [(" ".join("".join(parts).split()), tags, block) for parts, tags, block, _, _ in parser.lines]
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines], float)
    if not ratios.any():
        return ""
    level = smoothed(ratios, sigma)
    chosen = (level > ratios.std()) & (ratios > 0)
    if not chosen.any():
        chosen = ratios > 0
    up, framed = parser.up, set(parser.framed)
    for n in sorted(up, reverse=True):
        if n in framed:
            framed.add(up[n])
    # for each block, the outermost one around it (itself included) that is an article, else a main element; that holds no text of the frame; that stands in the body
    article, whole, grown, top = {BODY: BODY}, {BODY: BODY}, {BODY: BODY}, {BODY: BODY}
    for n, around in sorted(up.items()):
        article[n] = article[around] or (n if parser.tags.get(n) == "article" else BODY)
        whole[n] = whole[around] or (n if parser.tags.get(n) == "main" else BODY)
        grown[n] = n if around in framed else grown[around]
        top[n] = top[around] or n
    regions: set[int] = set()  # elements all of whose lines are content
    edges = np.flatnonzero(np.diff(np.concatenate(([False], level > ratios.std(), [False])).astype(np.int8)))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        bare = []
        for block in (lines[k][2] for k in range(first, last) if lines[k][0]):
            found = article[block] or whole[block]
            if found:
                regions.add(grown[found])
            else:
                bare.append(block)
        if len(bare) == 1:  # one line alone: the block around its own
            regions.add(grown[up.get(bare[0], BODY)])
        elif bare:
            regions.add(grown[_shared(min(bare), max(bare), up)])
    inside = {BODY: False}
    for n, around in sorted(up.items()):
        inside[n] = inside[around] or n in regions
    menus = _menus(parser.lines, top) if BODY in regions else set()
    firm = np.flatnonzero((ratios > ratios.std()) & (level > ratios.std() / 2))
    loose = set()
    if len(firm):
        loose = {k for k in (*range(firm[0]), *range(firm[-1] + 1, len(lines))) if parser.kinds[lines[k][2]] in LOOSE and not (article[lines[k][2]] or whole[lines[k][2]])}
    kept = lambda k, block: chosen[k] or inside[block] or BODY in regions and top[block] not in menus
    return " ".join(text for k, (text, _, block) in enumerate(lines) if text and k not in loose and kept(k, block))


def _menus(lines: list[list], top: dict[int, int]) -> set[int]:
    """Elements directly in the body whose text is LEAST_LINKS links or more and nothing else."""
    found: dict[int, list[int]] = {}
    for parts, _, block, linked, links in lines:
        if block != BODY:
            of = found.setdefault(top[block], [0, 0, 0])
            of[0] += len("".join("".join(parts).split()))
            of[1] += linked
            of[2] += links
    return {n for n, (size, linked, links) in found.items() if size == linked and links >= LEAST_LINKS}


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """(id, url, text, n_chars) for each page row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, pages_ in text_slices(batch, html_col):
                part = batch.slice(begin, len(pages_))
                texts = [main_text(p.decode(), sigma) for p in pages_]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(id_col)), part.column(part.schema.get_field_index(url_col)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
