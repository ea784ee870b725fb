"""HTML extraction: parser events to lines, their ratio of text to tags, Gaussian smoothing and threshold clusters.

The standard library's streaming parser turns a page into lines, one for each block. A line's ratio is its characters
outside links for each tag met; elements and names around it are features that scale the ratio: in menus, headers,
footers, sidebars, notices, adverts, forms and readers' comments it is 0, under a name that content bears as well
(related, share, ...) and outside all articles of a page that has some it is a part. Ratios are smoothed by a Gaussian;
lines above a threshold form clusters, and clusters less than a gap apart are one region. An article of which the
clusters hold at least half of the text is one region, short lines such as headings and list items with it. Lines whose
own ratio is 0 by a feature are in no region.

Null and empty pages have an empty text. Whatever the page, nothing is capped. Repeated rows give repeated results, an
empty table no rows; other columns pass through, but for one named text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Elements that hold no text, that are furniture, that start a block, and that have no end.
SILENT = set("script style noscript template head title svg math iframe object canvas select option textarea button audio video".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
BLOCKS = set("address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class names and ids that mark furniture, and those that content can bear too.
NOTICES = set("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar widget masthead cookie cookies consent gdpr notice newsletter subscribe signup login comment comments disqus respond popup modal toolbar pagination pager skip".split())
DOUBTS = set("share sharing social related recommended header footer reply teaser".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Spread of the smoothing in lines, and the share of the standard deviation above which a line is content.
SIGMA, LEVEL = 1.0, 0.5
#: Regions with fewer lines between them are one.
GAP = 3
#: What is left of a ratio under a doubtful name, and outside the articles of a page that has some.
DOUBTED, OUTSIDE = 0.25, 0.1


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    article: int  # number of the article it stands in, 0 for none
    hidden: bool  # in furniture
    doubted: bool  # under a doubtful name


class Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: tag, silent, furniture, doubtful, link, number of its article (0: none of its own)
        self.stack: list[tuple[str, int, int, int, int, int]] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.articles: list[int] = []
        self.tags = self.silent = self.hidden = self.doubts = self.links = self.linked = self.seen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.articles[-1] if self.articles else 0, self.hidden > 0, self.doubts > 0))
            self.tags = 0
        self.linked = 0

    def _features(self, tag: str, given: dict) -> tuple[bool, bool]:
        """Whether an element is furniture, and whether its name is doubtful."""
        names = set(re.split(r"[^a-z0-9]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower()))
        own = tag in ("html", "body", "main", "article") and not names & {"comment", "comments"}
        head = tag == "header" and bool(self.articles)  # an article's own heading stands in it
        hide = tag in FURNITURE and not head or given.get("role") in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or bool(names & NOTICES) and not own
        return hide, bool(names & DOUBTS) and not head and not (names & {"header"} and self.articles)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self._leave()
        if tag in VOID:
            return
        hide, doubt = self._features(tag, dict(attrs))
        if hide or doubt or tag in ("article", "main"):
            self.flush()
        self.seen += tag in ("article", "main")
        own = (tag, int(tag in SILENT), int(hide), int(doubt), int(tag == "a"), self.seen if tag in ("article", "main") else 0)
        self.stack.append(own)
        self._count(own, 1)
        if own[5]:
            self.articles.append(own[5])

    def _count(self, own: tuple, by: int) -> None:
        self.silent, self.hidden, self.doubts, self.links = self.silent + by * own[1], self.hidden + by * own[2], self.doubts + by * own[3], self.links + by * own[4]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _leave(self) -> None:
        own = self.stack.pop()
        if own[0] in BLOCKS or own[2] or own[3] or own[5]:
            self.flush()
        self._count(own, -1)
        if own[5]:
            self.articles.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if any(own[0] == tag for own in self.stack):
            while self.stack[-1][0] != tag:
                self._leave()
            self._leave()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links for each tag, scaled by the features of each line."""
    some = any(x.article and not x.hidden for x in lines)
    return np.array([0.0 if x.hidden else max(len(x.text) - x.linked, 0) / max(x.tags, 1) * (DOUBTED if x.doubted else 1) * (OUTSIDE if some and not x.article else 1) for x in lines])


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    middle = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(ratio)]
    return middle(ratio) / middle(np.ones(len(ratio)))


def regions(lines: list[Line]) -> np.ndarray:
    """Which lines are content: those of the regions."""
    if not lines:
        return np.zeros(0, bool)
    smooth, shown = smoothed(ratios(lines)), np.array([not x.hidden for x in lines])
    # Half as far again in lines under doubtful names: what stands beside content isn't content for that.
    level = min(LEVEL * smooth.std(), smooth.max()) * np.where([x.doubted for x in lines], 1.5, 1)
    # Lines that are mostly links stand in a region only by what is around them.
    links, doubted = np.array([2 * x.linked > len(x.text) for x in lines]), np.array([x.doubted for x in lines])
    above = np.flatnonzero((smooth >= level) & (smooth > 0) & shown & ~links)
    out = np.zeros(len(lines), bool)
    out[above] = True
    article, size = np.array([x.article for x in lines]), np.array([len(x.text) for x in lines])
    for a, b in zip(above[:-1], above[1:], strict=True):
        if b - a <= GAP and article[a] == article[b]:
            out[a:b] = True
    for number in np.unique(article[out & (article > 0)]):
        own = (article == number) & shown
        if 2 * size[own & out].sum() >= size[own].sum():
            out |= own & ~(doubted & (links | (smooth < level)))
    return out & shown


def extract(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    return "\n".join(x.text for x, keep in zip(page.lines, regions(page.lines), strict=True) if keep)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the html by ``text string``."""
    keep = [c for c in pages.columns if c not in (html, "text")]

    def run(batches):
        for batch in batches:
            out = [extract(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return map_batches(pages, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep), "text string"]))
