"""Main text of web pages from parser events, text-to-tag ratios and clustering.

The standard library's parser streams events; block-level tags divide the page into
lines. Every line has a ratio of text to tags, those of menus and adverts too; ratios
are smoothed by a Gaussian, so that a short line among long ones stays with them, and
split by a threshold between two clusters. The lines above it decide: of several
articles those with their text are taken, without any article the deepest container
that holds all of them with every paragraph and heading beside; within either, a list
or box whose lines all lie below and are nearly all links is a menu and goes. Lines
inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
marked by element, role or class, take part in the clusters but are never text.
Paragraphs, headings, list items and cells are no regions. All else is kept.

Cases: null and empty pages have an empty text, as have pages without content. Tags
left open are closed by what encloses or follows them. Pages of any length and depth
are read whole, in time linear in both. Repeated rows give a row each; columns other
than id, URL and HTML are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, strings

FEED = 64 << 10
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_REMOVED = frozenset("applet audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video aside".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what is not part of the article.
_MARKS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription syndication teaser toolbar topbar widget".split())
_HEADERS = frozenset("header".split())
_CLOSED_BY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def _named(attributes: dict[str, str | None]) -> set[str]:
    """Words of classes and id, each class whole or by its first and last word; has-, with- and no- say nothing."""
    out = set()
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in ("has", "with", "no", "is", "without"):
            out |= {words[0], words[-1]}
    return out


#: What is in these is never text, not even of a menu.
_SILENT = frozenset("applet audio canvas datalist embed head iframe noscript object option script select style svg template textarea title video".split())


class Line:
    """A line of a page: its text, tags, characters within links (blanks aside), whether it is marked, the element it stands in."""

    __slots__ = ("text", "tags", "linked", "marked", "element")

    def __init__(self, text: str, tags: int, linked: int, marked: bool, element: int):
        self.text, self.tags, self.linked, self.marked, self.element = text, tags, linked, marked, element


class _Reader(HTMLParser):
    """Lines and elements of a page. Elements are numbered in page order, so those within one follow it without a gap.

    Only block elements and marked inline ones are held open, and tags that none of them
    has end nothing at once, so work is linear in the page however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # tag, number of the element, mark (0 none, 1 marked, 2 silent), equal inline tags within
        self.held: dict[str, int] = {}  # open elements of each tag
        self.tag_of: list[str] = [""]
        self.parent: list[int] = [-1]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.beside: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        for parts, marked in ((self.parts, False), (self.beside, True)):
            if not parts:
                continue
            text = " ".join("".join(parts).split())
            if text:
                self.lines.append(Line(text, max(1, self.tags), self.linked, marked, self.open[-1][1] if self.open else 0))
                self.tags = self.linked = 0
        self.parts, self.beside = [], []

    def _close_from(self, i: int) -> None:
        self.flush()
        for x in self.open[i:]:
            self.held[x[0]] -= 1
        del self.open[i:]

    def _push(self, tag: str, element: int, mark: int) -> None:
        self.open.append([tag, element, mark, 1])
        self.held[tag] = self.held.get(tag, 0) + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 1
        block = tag in _BLOCK
        if block:
            self.flush()
            # What the standard lets stay open ends here.
            if tag not in ("br", "hr"):
                i = len(self.open) - 1
                while i >= 0 and self.open[i][0] in _INLINE:
                    i -= 1
                if i >= 0 and self.open[i][0] == "p":
                    self._close_from(i)
            ends = _CLOSED_BY.get(tag, ())
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if ends and any(self.held.get(x) for x in same):
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in ends:
                        break
                    if self.open[i][0] in same:
                        self._close_from(i)
                        break
        if tag in _VOID:
            return
        top = self.open[-1] if self.open else ["", 0, 0, 0]
        mark = top[2]
        if tag in _SILENT:
            mark = 2
        elif not mark and tag not in ("html", "body"):
            values = dict(attrs)
            names, article = _named(values), bool(self.held.get("article"))
            mark = int(
                tag in _REMOVED
                or tag == "header" and not article
                or (values.get("role") or "").lower() in _ROLES
                or "hidden" in values
                or values.get("aria-hidden") == "true"
                or "display:none" in (values.get("style") or "").replace(" ", "").lower()
                or (tag not in _INLINE or tag == "span") and tag not in ("main", "h1") and bool(names & _MARKS)
                or tag in ("div", "section", "ul", "td") and not article and bool(names & _HEADERS)
            )
        if tag in _INLINE:
            if mark and not top[2]:
                self._push(tag, top[1], mark)
            elif top[0] == tag:
                top[3] += 1
            return
        self.tag_of.append(tag)
        self.parent.append(top[1])
        self._push(tag, len(self.tag_of) - 1, mark)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in _BLOCK:
            self.flush()
        if not self.held.get(tag):
            return
        if tag in _INLINE:
            # Held inline elements are marked ones; what stands between ends first.
            if self.open[-1][0] == tag:
                self.open[-1][3] -= 1
                if not self.open[-1][3]:
                    self.open.pop()
                    self.held[tag] -= 1
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if tag in _BLOCK:
            self._close_from(i)
        else:
            # What a script or button leaves out parts no words.
            for x in self.open[i:]:
                self.held[x[0]] -= 1
            del self.open[i:]

    def handle_data(self, data: str) -> None:
        mark = self.open[-1][2] if self.open else 0
        if mark == 2:
            return
        (self.beside if mark else self.parts).append(data)
        if self.links:
            self.linked += sum(map(len, data.split()))


def smoothed(values: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the ends and weighed anew there."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[radius : radius + len(values)] / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def split_at(values: np.ndarray) -> float:
    """The threshold between two clusters of log ratios: means moved until they stay; values within a factor of e are one cluster."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1:
        return low
    for _ in range(50):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all() or not upper.any():
            return float(values.min())
        a, b = float(values[~upper].mean()), float(values[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


#: Elements that hold text rather than parts of a page; a region is none of them.
_TEXTUAL = frozenset("address blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup legend li ol p pre summary table tbody td tfoot th thead tr ul".split())
#: A list or box of so many lines, all below the threshold and so much of them links, is a menu.
MENU_LINES, MENU_LINKS = 3, 0.9


def _cluster(lines: list[Line]) -> np.ndarray:
    """For each line, whether its smoothed ratio lies above the threshold."""
    ratios = smoothed(np.log1p([len(x.text) / x.tags for x in lines]))
    return ratios >= split_at(ratios)


def main_text(html: str, cluster=_cluster) -> str:
    """The text of the content region, lines in page order joined by a space. cluster: lines to whether each is content."""
    reader = _Reader()
    for i in range(0, len(html), FEED):
        reader.feed(html[i : i + FEED])
    reader.close()
    reader.flush()
    if all(x.marked for x in reader.lines):
        return ""
    lines, content = [], []
    for line, good in zip(reader.lines, cluster(reader.lines)):
        if not line.marked:
            lines.append(line)
            content.append(bool(good))
    tag, parent, count = reader.tag_of, reader.parent, len(reader.tag_of)
    heading = [tag[x.element] in ("h1", "h2", "h3", "p") for x in lines]
    # Of each element with all within it: lines, content lines, text, its characters but blanks, those in links, text that a region must hold.
    sums = np.zeros((count, 6), np.int64)
    for x, good, head in zip(lines, content, heading):
        n = len(x.text)
        sums[x.element] += (1, good, n, n - x.text.count(" "), x.linked, n if good or head else 0)
    inner, article, menu = sums.tolist(), [-1] * count, [False] * count
    for e in range(count - 1, 0, -1):
        up, own = inner[parent[e]], inner[e]
        for i in range(6):
            up[i] += own[i]
    depth = [0] * count
    for e in range(1, count):
        depth[e] = depth[parent[e]] + 1
        article[e] = article[parent[e]] if article[parent[e]] >= 0 else e if tag[e] == "article" else -1
        n, good, _, size, linked, _ = inner[e]
        menu[e] = menu[parent[e]] or n >= MENU_LINES and not good and linked >= MENU_LINKS * size
    outer = [article[x.element] for x in lines]
    chosen = [False] * count
    if max(outer) >= 0:
        good_text: dict[int, int] = {}
        for x, e, good in zip(lines, outer, content):
            if e >= 0:
                good_text[e] = good_text.get(e, 0) + (len(x.text) if good else 0)
        rated = good_text if any(good_text.values()) else {e: inner[e][2] for e in good_text}
        most = max(rated.values())
        taken = {e for e, n in rated.items() if n >= 0.3 * most}
        return " ".join(x.text for x, e in zip(lines, outer) if e in taken and (not menu[x.element] or menu[e]))
    total = inner[0][5]
    held = [e for e in range(count) if tag[e] == "main" and inner[e][5]]
    region = held[0] if held else max((e for e in range(count) if inner[e][5] == total and tag[e] not in _TEXTUAL), key=depth.__getitem__)
    chosen[region] = True
    for e in range(region + 1, count):
        chosen[e] = chosen[parent[e]]
    inside = [chosen[x.element] and (not menu[x.element] or menu[region]) for x in lines]
    if tag[region] in ("", "html", "body"):
        at = [i for i, (a, b) in enumerate(zip(inside, content)) if a and b]
        inside = [a and (b or head or bool(at) and at[0] <= i <= at[-1]) for i, (a, b, head) in enumerate(zip(inside, content, heading))]
    return " ".join(x.text for x, a in zip(lines, inside) if a)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: id, url, text (empty if there is none), n_chars (its code points)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in strings(part.column(2))]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = rows.select("id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    out = map_text(rows, work, schema, "html")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
