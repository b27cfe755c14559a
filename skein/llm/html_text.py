"""Main text of web pages: text-to-tag ratio per line, smoothed, clustered by a threshold.

A streaming parse of the standard library turns a page into lines (runs of text between block tags). Each line
has a text-to-tag ratio, where the text of links counts nothing; a Gaussian smooths the ratios along the page, and
a threshold on them clusters lines into content and the rest. The container that holds most of the clustered text,
or a named article with a fair share of it, is the page's region. Of its lines the clustered ones are content, and
so are those below the threshold that aren't links (short paragraphs, captions, cells). Lists of links at the edges
of the region go with their headings. Furniture (menus, footers, adverts, comments and the like, by element or by
class) is never content, except that a container whose class sounds like a form or a sidebar is none if it holds most
of the page's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices, text_of

SIGMA = 1.5
RADIUS = 4
THRESHOLD = 0.6
#: Share of a line's characters that are links from which it may be a menu's, share of the clustered text that makes
#: a container the region, and share from which a named article is one.
LINKS = 0.5
MOST = 0.6
FAIR = 0.1

# Names of HTML elements by what they mean here.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map".split())
FURNITURE = frozenset("nav footer menu dialog button select option textarea input label fieldset datalist".split())
WRAPPERS = frozenset("aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that always mark page furniture, and those that whole pages are wrapped in at times.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|comments?|replies|reply|disqus|respond|"
    r"cookies?|consent|gdpr|newsletter|subscribe|popup|modal|share|sharing|social|pagination|pager|skip)(?:$|[\s_-]|\d)",
    re.I,
)
LIKELY = re.compile(
    r"(?:^|[\s_-])(?:banner|footer|foot|masthead|topbar|sidebar|side|widget|related|recommend(?:ed|ations)?|notice|signup|login|search|form|toolbar|copyright|legal|complementary|"
    r"contentinfo|dialog|alert|tags)(?:$|[\s_-]|\d)",
    re.I,
)
HEADER_MARKS = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header|head)(?:$|[\s_-])", re.I)
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class Line(NamedTuple):
    """A run of text between block tags."""

    text: str
    tags: int
    links: int  # characters of its links
    anchors: int
    container: int
    furniture: bool
    wrapped: int  # the outermost container that is furniture only by a likely mark, or -1
    heading: bool


class Lines(HTMLParser):
    """Lines of a page, and the tree of its containers with what is a named article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool, int, int]] = []  # name, hidden, furniture, container, wrapped
        self.hidden = self.furniture = False
        self.container = self.links = self.anchors = self.opened = self.tags = 0
        self.wrapped = -1
        self.parents = [0]
        self.main = [False]
        self.parts: list[str] = []

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                heading = any(x[0] in HEADINGS for x in self.stack[-4:])
                self.lines.append(Line(text, self.tags, self.links, self.opened, self.container, self.furniture, self.wrapped, heading))
                self.tags = 0
            self.parts = []
        self.links = self.opened = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections that HTML doesn't know are comments up to the next ">"."""
        return self.parse_bogus_comment(i, 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        if tag == "body":
            self.pop_to("head")
        if tag in CLOSED_BY:
            self.close_implied(tag)
        elif tag not in INLINE and any(x[0] == "p" for x in self.stack[-3:]):
            self.pop_to("p")
        self.stack.append((tag, self.hidden, self.furniture, self.container, self.wrapped))
        self.anchors += tag == "a"
        self.opened += tag == "a"
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        in_main = self.main[self.container]
        if tag in HIDDEN or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            self.hidden = True
        own = tag not in MAIN and tag not in ("body", "html") and bool(marks)
        if tag in FURNITURE or tag == "header" and not in_main or own and (MARKS.search(marks) or not in_main and HEADER_MARKS.search(marks)):
            self.furniture = True
        if tag not in INLINE and tag not in HEADINGS and tag not in ("p", "li", "tr", "td", "th"):
            self.parents.append(self.container)
            self.container = len(self.parents) - 1
            self.main.append(in_main or tag in MAIN or "main" in marks.lower().split())
        if (tag in WRAPPERS or own and LIKELY.search(marks)) and self.wrapped < 0:
            self.wrapped = self.container

    def close_implied(self, tag: str) -> None:
        """A new list item, cell or paragraph ends the open one of its list, row or block."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in CLOSED_BY[tag]:
                self.cut(i)
                return
            if name in SCOPES.get(tag, ()) or tag == "p" and name not in INLINE:
                return

    def pop_to(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                return

    def cut(self, i: int) -> None:
        self.end_line()
        self.leave(i)

    def leave(self, i: int) -> None:
        _, self.hidden, self.furniture, self.container, self.wrapped = self.stack[i]
        self.anchors -= sum(x[0] == "a" for x in self.stack[i:])
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                if tag in INLINE and i + 1 < len(self.stack) and any(x[0] not in INLINE for x in self.stack[i + 1 :]):
                    return
                self.leave(i)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios along the page under a Gaussian."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    return np.convolve(ratio, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(ratio)]


def shares(lines: list[Line], chosen: np.ndarray, parents: list[int]) -> dict[int, int]:
    """Characters of the chosen lines by container, in it or in containers inside it."""
    weight: dict[int, int] = {0: 0}
    for line, c in zip(lines, chosen.tolist(), strict=True):
        if c:
            box = line.container
            while True:
                weight[box] = weight.get(box, 0) + len(line.text)
                if not box:
                    break
                box = parents[box]
    return weight


def content(lines: list[Line], main: list[bool], parents: list[int], sigma: float, threshold: float) -> list[bool]:
    """Which lines are content."""
    hard = np.asarray([x.furniture for x in lines])
    wrapped = np.asarray([x.wrapped for x in lines])
    plain = np.asarray([max(0, len(x.text) - x.links) for x in lines], dtype=float)
    ratio = np.where(hard, 0.0, plain / np.maximum(1, [x.tags for x in lines]))
    smooth = smoothed(ratio, sigma)
    core = (smooth >= threshold * smooth.std()) & ~hard & (ratio > 0)
    # A wrapper with most of the page's text is no furniture, unless there is a named article outside it.
    weight = shares(lines, core, parents)
    outside = sum(len(x.text) for x, c in zip(lines, core.tolist(), strict=True) if c and x.wrapped < 0 and main[x.container])
    wide = [w for w in set(wrapped.tolist()) if w >= 0 and outside < FAIR * weight[0] and weight.get(w, 0) > 0.5 * weight[0]]
    furniture = hard | ((wrapped >= 0) & ~np.isin(wrapped, wide))
    core &= ~furniture
    if not core.any():
        core = ~furniture & (ratio > 0)
    weight = shares(lines, core, parents)
    named = np.asarray([main[x.container] for x in lines])
    if sum(len(x.text) for x, c in zip(lines, (core & named).tolist(), strict=True) if c) > FAIR * weight[0]:
        region = named
    else:
        # The innermost container with most of the clustered text.
        best = max((box for box, w in weight.items() if w >= MOST * weight[0]), default=0)

        def inside(box: int) -> bool:
            while box > best:
                box = parents[box]
            return box == best

        region = np.asarray([inside(x.container) for x in lines])
    out = region & ~furniture
    return (out & ~menus(lines, out, ratio, smooth, threshold * smooth.std())).tolist()


def menus(lines: list[Line], out: np.ndarray, ratio: np.ndarray, smooth: np.ndarray, least: float) -> np.ndarray:
    """Lines of links that are no content, with the heading over them.

    One that the clustering leaves out; and at either edge of the region, where smoothing carries the ratios of the
    text beside it over, a run of several links: in three lines or more, or all in one.
    """
    linked = np.asarray([x.links >= LINKS * len(x.text) for x in lines])
    several = np.asarray([x.anchors > 1 and x.links >= 0.9 * len(x.text.replace(" ", "")) for x in lines])
    menu = linked & (smooth < least)
    solid = np.flatnonzero(out & (ratio >= least) & ~np.asarray([x.heading for x in lines]))
    first, last = (int(solid[0]), int(solid[-1])) if len(solid) else (0, -1)
    own = np.flatnonzero(out)
    cut = np.flatnonzero(np.diff(linked[own].astype(int)) != 0) + 1
    for run in np.split(own, cut):
        if len(run) and linked[run[0]] and (run[-1] < first or run[0] > last >= 0) and (len(run) >= 3 or several[run].any()):
            menu[run] = True
    for i, j in zip(own[-2::-1].tolist(), own[:0:-1].tolist(), strict=True):
        menu[i] |= lines[i].heading and menu[j]
    return menu


def extract_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of one page; empty if it has none."""
    if not html or "<" not in html and "&" not in html:
        return " ".join(html.split()) if html else ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    chosen = content(parser.lines, parser.main, parser.parents, sigma, threshold)
    return " ".join(line.text for line, c in zip(parser.lines, chosen, strict=True) if c)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """(id, url, text, n_chars) for every row; null or empty html gives an empty text.

    Broken markup and pages of any length are read as far as they go; repeated rows come back as often as they come;
    an empty table gives an empty one. Other columns, whatever their names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html", 4 << 20):
                texts = [extract_text(x, sigma, threshold) for x in text_of(rows, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    source = pages.select(pages[id_col], pages[url_col], pages[html_col].alias("html"))
    return source.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
