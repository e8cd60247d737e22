"""The main text of web pages, from the event stream of the standard library's HTML parser.

The events of a page become lines: one for each block, with its text and the number of tags in it. Lines inside elements that never
hold article text (menus, scripts, controls of forms ...) are dead. The text-to-tag ratio of the lines, dead ones counting zero, is
smoothed with a Gaussian and split by a threshold between its low and its high cluster; the lines of the high cluster say which
region of the page is content, and all living lines of that region are its text (so headings and short list items of an article
aren't lost, whose own ratio is low). The heading of the first level nearest above belongs to a region that has none.

Names of classes and ids, and forms and headers around text, are hints; the ratio decides. A doubtful block (a form, a header, a notice,
related or shared things) lives if its own ratio reaches the threshold of the page or if it holds most of the high cluster. A block whose name
says what it is (adverts, comments, sidebars ...) is dead, unless it wraps the page: it holds most of the text and a heading of the
first level, an article or a main element without such a name. If nothing would be left of a page, the names around most
of its text say nothing. No length decides whether text stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class HtmlParams:
    """sigma: width of the smoothing, in lines. chunk: characters given to the parser at once."""

    sigma: float = 1.5
    chunk: int = 1 << 16


# Names of HTML elements and attributes, and words that mark what isn't article text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript",
    "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "template",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
SECTIONS = {"article", "body", "div", "main", "section", "table", "td"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DEAD = {
    "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "head", "iframe", "input", "label", "legend",
    "menu", "nav", "noscript", "object", "optgroup", "option", "script", "select", "style", "svg", "template", "textarea",
    "title", "video",
}
#: Elements that may hold an article or not.
DOUBTFUL = {"fieldset", "form", "header"}
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Words that say what a block is, and words that an article may use of itself.
NAMED = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer",
    "masthead", "comment", "comments", "disqus", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "pagination",
    "pager", "skip", "skiplink", "paywall",
}
DOUBTFUL_WORDS = {
    "banner", "discussion", "replies", "reply", "respond", "share", "sharing", "social", "related", "recommended", "recommendations", "overlay",
    "notice", "notices", "alert", "alerts", "widget", "toolbar", "rail",
}
DEAD_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search"}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


#: What an open element does with its text: a dead block still makes lines, a dead inline element only drops its text.
DEAD_LINE, MUTE = 1, 2
#: What is said of an element.
NOTHING, DOUBT, HINT, CERTAIN = 0, 1, 2, 3
_OUTSIDE: tuple[str, int, int, tuple[int, ...], tuple[int, ...]] = ("", 0, 0, (), ())


@dataclass
class Line:
    text: str
    tags: int
    zone: int
    dead: bool
    path: tuple[int, ...]
    hints: tuple[int, ...]
    title: bool = False


class LineReader(HTMLParser):
    """Collects lines from parser events; keeps a stack of open elements as (name, dead, zone, path, hints).

    zone numbers the article or main element around, path the sections around, from the outermost on,
    and hints the blocks around that may be something else than an article. ``doubtful`` has those of which the ratio decides,
    ``holders`` those that hold a heading of the first level, an article or a main element without such a name. ``around`` has the path
    around each zone.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]] = []
        self.held: list[str] = []
        self.holders: set[int] = set()
        self.doubtful: set[int] = set()
        self.around: dict[int, tuple[int, ...]] = {}
        self.tags = self.zones = self.sections = self.hinted = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            _, dead, zone, path, hints = self.open[-1] if self.open else _OUTSIDE
            self.lines.append(Line(text, self.tags, zone, bool(dead), path, hints, any(x[0] == "h1" for x in self.open)))
            self.tags = 0
        self.held = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.held.append(" ")
            self.tags += 1
            return
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and any(x[0] == "p" for x in self.open):
                self.close_to("p", {"article", "main", "section", "div", "td", "li", "blockquote"})
            elif tag == "li":
                self.close_to("li", {"ul", "ol", "menu"})
        self.tags += 1
        if tag in VOID:
            return
        said = self.marked(tag, attrs)
        if tag in ("article", "main") and said < HINT:
            while self.open and self.open[-1][1]:  # an element that was never closed
                self.open.pop()
        _, dead, zone, path, hints = self.open[-1] if self.open else _OUTSIDE
        if tag in ("article", "main", "h1") and not dead and said < HINT:
            self.holders.update(hints)
        page_header = tag == "header" and not zone and len(path) < 2
        if not dead and (tag in DEAD or page_header or said == CERTAIN or (said == HINT and tag not in BLOCKS)):
            dead = DEAD_LINE if tag in BLOCKS else MUTE
        elif said == HINT or tag in BLOCKS and (said == DOUBT or tag in DOUBTFUL and not (tag == "header" and zone)):
            self.hinted += 1
            hints = (*hints, self.hinted)
            if said < HINT:
                self.doubtful.add(self.hinted)
            if tag in ("article", "main"):
                self.holders.add(self.hinted)
        if tag in ("article", "main") and not dead and (tag == "article" or not zone):
            self.zones += 1
            zone = self.zones
            self.around[zone] = path
        if tag in SECTIONS:
            self.sections += 1
            path = (*path, self.sections)
        self.open.append((tag, dead, zone, path, hints))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "p" or tag not in BLOCKS:
            self.close_to(tag, BLOCKS - {"p"})
        else:
            self.close_to(tag, {"article", "main"} - {tag} if tag not in ("body", "html") else set())

    def close_to(self, tag: str, stops: frozenset[str] | set[str]) -> None:
        """Closes the innermost element of this name, unless one of ``stops`` lies above it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in stops:
                return

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][1] != MUTE:
            self.held.append(data)

    @staticmethod
    def marked(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """Whether attributes say that this isn't article text. A name made of several words is no hint at an inline element."""
        if tag in ("html", "body"):
            return NOTHING
        found = HINT if tag == "aside" else NOTHING
        for name, value in attrs:
            value = value or ""
            if name == "role" and value.strip().lower() in DEAD_ROLES:
                return CERTAIN
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
                return CERTAIN
            if name in ("class", "id"):
                words = _WORDS.findall(_CAMEL.sub(" ", value).lower()) if tag in BLOCKS else value.lower().split()
                if not NAMED.isdisjoint(words):
                    found = HINT
                elif not DOUBTFUL_WORDS.isdisjoint(words):
                    found = max(found, DOUBT)
        return found


def lines_of(html: str, p: HtmlParams) -> list[Line]:
    """The lines of a page, of which those that can't be text are dead."""
    return read(html, p)[0]


def read(html: str, p: HtmlParams) -> tuple[list[Line], dict[int, tuple[int, ...]]]:
    """The lines, and the path around each article or main element."""
    reader = LineReader()
    for at in range(0, len(html), p.chunk):
        reader.feed(html[at : at + p.chunk])
    reader.close()
    reader.flush()
    lines = reader.lines
    living = [x for x in lines if not x.dead]
    named = lambda x: [k for k in x.hints if k not in reader.doubtful]

    plain = [x for x in living if reader.holders.issuperset(named(x))]
    inside = Counter[int]()
    for x in plain:
        inside.update(dict.fromkeys(named(x), len(x.text)))
    wrappers = {k for k, n in inside.items() if 2 * n > sum(len(x.text) for x in plain)}
    if living and all(not wrappers.issuperset(named(x)) for x in living):
        own = Counter[tuple[int, ...]]()
        for x in living:  # nothing would be left of the page: the names around most of it say nothing
            own[tuple(named(x))] += len(x.text)
        wrappers = set(max(own, key=lambda hints: (own[hints], hints)))
    for x in lines:
        x.dead = x.dead or not wrappers.issuperset(named(x))

    doubtful = {k for x in lines if not x.dead for k in x.hints} & reader.doubtful
    if doubtful:
        level, border = levels(lines, p)
        high = [x for x, v in zip(lines, level, strict=True) if not x.dead and v >= border]
        for k in doubtful:
            own = [x for x in lines if not x.dead and k in x.hints]
            ratio = sum(len(x.text) for x in own) / max(1, sum(x.tags for x in own))
            if ratio >= border or 2 * sum(len(x.text) for x in high if k in x.hints) > sum(len(x.text) for x in high):
                doubtful = doubtful - {k}
        for x in lines:
            x.dead = x.dead or not x.title and not doubtful.isdisjoint(x.hints)
    return lines, reader.around


def levels(lines: list[Line], p: HtmlParams) -> tuple[np.ndarray, float]:
    """The smoothed ratio of each line, and where the high cluster begins (at most at the highest living line)."""
    ratio = np.array([0.0 if x.dead else len(x.text) / max(1, x.tags) for x in lines])
    level = smooth(ratio, p.sigma)
    return level, min(threshold(level), level[[not x.dead for x in lines]].max())


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratio, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Half-way between the means of a low and a high cluster (two means on a line)."""
    low, high = values.min(), values.max()
    for _ in range(20):
        middle = (low + high) / 2
        upper = values >= middle
        if upper.all():
            return float(low)
        was = low, high
        low, high = values[~upper].mean(), values[upper].mean()
        if was == (low, high):
            break
    return float((low + high) / 2)


def main_text(html: str | None, p: HtmlParams = HtmlParams()) -> str:
    lines, around = read(html or "", p)
    if not any(not x.dead for x in lines):
        return ""
    level, border = levels(lines, p)
    alive = np.array([not x.dead for x in lines])
    content = alive & (level >= border)
    zone = np.array([x.zone for x in lines])
    zones = {z for z in zone[content] if z}
    if zones:  # and the articles beside them
        beside = {around[z] for z in zones}
        zones = {z for z, path in around.items() if path in beside}
        keep = alive & np.isin(zone, list(zones))
    else:
        paths = [lines[k].path for k in np.flatnonzero(content)]
        depth = next((k for k, ids in enumerate(zip(*paths, strict=False)) if len(set(ids)) > 1), min(map(len, paths)))
        keep = alive & np.array([x.path[:depth] == paths[0][:depth] for x in lines])
    titles = np.array([x.title for x in lines])
    if not (keep & titles).any():  # the nearest heading above
        keep[np.flatnonzero(alive & titles & (np.arange(len(lines)) < keep.argmax()))[-1:]] = True
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Controls of forms, labels and buttons are never text; a form around prose is. Of blocks with equally much text the later one
    counts as the larger. The text has a line for each block, white space inside it turned into single spaces. A null or
    empty page, and one with nothing but menus and the like, gives an empty text. Nulls in page_id
    and url stay; repeated rows give repeated results; other columns are not read. Pages of any length are
    read whole. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), p) for x in batch.column("html")]
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
