"""Main text of web pages by text-to-tag ratios of the lines that parser events form.

The standard library's parser streams a page's events once. Block elements begin lines; a
line has its text, its number of tags and the region it stands in. Lines of menus, forms, adverts
and the like, known by their element or its class, are no candidates. The ratios of text to tags
of the others are smoothed by a Gaussian; regions that reach the standard deviation of the
smoothed ratios are content, with all their lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SIGMA = 1.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
REGION = frozenset("article aside body div dl fieldset main ol section table td ul".split())
LISTS = frozenset("dl ol ul table".split())
STRONG = frozenset(["article", "main"])
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe menu nav noscript object option script select style "
    "svg template textarea title video".split()
)
# Words of a class, id or role that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments "
    "complementary consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation navmenu newsletter notice notification outbrain overlay pager pagination popup promo promoted promotion recommendations "
    "recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription taboola toolbar topbar widget widgets".split()
)
NEGATED = frozenset("has no not with without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# A start tag of the key ends an open element of the value, as omitted end tags do.
ENDS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option", "p": "p"}


def marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role say that an element is not part of an article, or it is hidden."""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            words = [w.lower() for w in _WORD.findall(value)]
            if any(w in MARKS and (k == 0 or words[k - 1] not in NEGATED) for k, w in enumerate(words)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and value and re.search(r"display\s*:\s*none", value):
            return True
    return False


class LineParser(HTMLParser):
    """Lines of a page: text, number of tags, characters in links, region."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # element, skipped, region, inside an article
        self.regions = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def _state(self) -> tuple[bool, int, bool]:
        return self.open[-1][1:] if self.open else (False, 0, False)

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self._state()[1]))
        if text or not self.text:
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if tag == "body":
            self.open.clear()
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        if tag in BLOCK and tag not in ("p", "li", "dt", "dd"):
            self._close("p", REGION)
        if tag in ENDS:
            self._close(ENDS[tag], REGION - {"td"})
        skipped, region, strong = self._state()
        if not skipped:
            keep = tag in ("html", "body") or tag in STRONG
            skipped = tag in SKIPPED or tag == "header" and not strong or not keep and marked(attrs)
        if tag in BLOCK or tag in SKIPPED or skipped and not self._state()[0]:
            if tag in STRONG and not strong:
                self.regions += 1
                region, strong = self.regions, True
            elif tag in REGION and not strong:
                self.regions += 1
                region = self.regions
            self.open.append((tag, skipped, region, strong))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        self._close(tag)

    def _close(self, tag: str, barrier: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of that name, unless a barrier stands before it."""
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self._end_line()
                del self.open[at:]
                return
            if name in barrier:
                return

    def handle_data(self, data):
        if not self._state()[0]:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of each value's neighbourhood; the ends are weighted by what there is."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


def main_text(html: str | None) -> str:
    """The text of the content regions of a page, its lines joined by blanks."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    regions = np.array([r for *_, r in lines])
    size = np.array([len(t) for t, *_ in lines], float)
    linked = np.array([n for _, _, n, _ in lines], float)
    # a line that is mostly links counts as navigation
    ratio = np.where(2 * linked > size, 0.0, size) / np.array([max(1, n) for _, n, _, _ in lines])
    level = smooth(ratio)
    content = np.unique(regions[(level >= level.std()) & (ratio > 0)])
    if not len(content):
        content = np.unique(regions)
    return " ".join(t for (t, *_), kept in zip(lines, np.isin(regions, content)) if kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Null, empty and textless pages have an empty text. Markup that does not fit together is read
    as browsers would roughly do. Rows, repeated ones too, and other columns stay; columns named
    ``text`` or ``n_chars`` are replaced.
    """

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return pages.withColumn("text", extracted(html)).withColumn("n_chars", F.length("text").cast("bigint"))
