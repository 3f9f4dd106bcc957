"""Main text of web pages: parser events, text-to-tag ratios of lines, Gaussian smoothing, threshold clusters (operator 10)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
#: Elements whose text is never part of an article.
_SKIPPED = frozenset(
    "head script style noscript template nav footer aside button select textarea option iframe object svg menu dialog "
    "audio video canvas label legend".split()
)
_CONTENT = frozenset("article main".split())
#: Whole tokens of class, id or role that mark adverts, comments and lists of other articles, with any article in them.
_FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist reply replies "
    "respond disqus related recommended".split()
)
_FORMS = frozenset("newsletter subscribe signup search login".split())
#: Those that count inside an article or main element too, and on headings.
_EVERYWHERE = (_FOREIGN - {"related", "recommended"}) | _FORMS
#: Menus, notices and the like; an article or main element inside is kept.
_MARKS = _FOREIGN | _FORMS | frozenset(
    "banner sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer cookie cookies consent notice notices "
    "gdpr popup modal overlay share sharing social widget toolbar pagination pager complementary contentinfo dialog alert "
    "alertdialog tablist".split()
)
_ROLES = frozenset("navigation complementary contentinfo search menu menubar tablist dialog alertdialog toolbar".split())
#: Those that go inside an article or main element: all but names that text of the article goes by, too.
_WITHIN = _MARKS - frozenset("widget footer overlay dialog".split())
_PAGE_ONLY = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Compounds are marks with such words before and after; any other word makes a name of its own (has-sidebar, related-work).
_BEFORE = frozenset("main site primary secondary left right top bottom global".split())
_AFTER = frozenset("area bar box button buttons form item items left links list posts right slot unit".split())
_AROUND = frozenset("container section wrap wrapper".split())
_SOFT, _HARD = 1, 2


@lru_cache(maxsize=10_000)
def _marks_of(token: str) -> frozenset[str]:
    """The marks that a token consists of, none if it says anything else."""
    if token in _MARKS or token in _PAGE_ONLY:
        return frozenset((token,))
    parts = [w for w in re.split(r"[-_]+", token) if w]
    while parts and parts[0] in _BEFORE:
        del parts[0]
    around = False
    while parts and (parts[-1] in _AFTER or parts[-1] in _AROUND):
        around |= parts.pop() in _AROUND
    marks = frozenset(parts)
    # a wrapper named after a side bar or menu may hold the page, one named after adverts or comments doesn't
    return marks if marks and marks <= (_EVERYWHERE if around else _MARKS) else frozenset()


@dataclass
class Line:
    """A block of text between block tags: how many tags it holds, how much of it is links, where it stands."""

    text: str
    tags: int
    linked: int
    region: int
    content: bool
    form: int
    block: str


class _Open:
    """An open element: what it skips (_SOFT: but for articles), its region, its form, whether it is inside article or main."""

    __slots__ = ("tag", "skipped", "region", "content", "form", "ended")

    def __init__(self, tag="", skipped=0, region=0, content=False, form=0):
        self.tag, self.skipped, self.region, self.content, self.form, self.ended = tag, skipped, region, content, form, False


class _Lines(HTMLParser):
    """Turns parser events into lines; elements that hold no article text are skipped.

    Every event takes constant time on average at any depth: block elements are found by their places in the stack,
    inline ones by the lists of those open in the same block, and an inline element that ends below others is only marked.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = [_Open()]
        self.blocks = [0]  # places of block elements in self.open
        self.inline: list[dict[str, list[_Open]]] = [{}]  # for each of these, the inline elements open in it
        self.count = Counter()
        self.lines: list[Line] = []
        self.regions = self.forms = 0
        self.parts, self.tags, self.linked = [], 0, 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            self.lines.append(Line(text, self.tags, self.linked, top.region, top.content, top.form, self.open[self.blocks[-1]].tag))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE and tag not in _VOID:
            self.flush()
            if self.open[self.blocks[-1]].tag == "p" and tag not in ("html", "body"):
                self._cut(len(self.blocks) - 1)  # a new block ends an open paragraph
        elif tag == "hr":
            self.flush()
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        top = self.open[-1]
        skipped, region, form = top.skipped, top.region, top.form
        within = top.content or tag in _CONTENT
        if tag in _CONTENT:
            form, skipped = 0, 0 if skipped == _SOFT else skipped
        if tag == "form" and not within and not form:
            self.forms += 1
            form = self.forms
        hard = tag in _SKIPPED or (tag == "form" and within)
        skipped = max(skipped, _HARD if hard else self._marked(tag, attrs, within))
        if not top.content and (tag in _CONTENT or tag in ("div", "section", "td", "body")):
            self.regions += 1
            region = self.regions
        new = _Open(tag, skipped, region, within, form)
        self.count[tag] += 1
        if tag in _INLINE:
            self.inline[-1].setdefault(tag, []).append(new)
        else:
            self.blocks.append(len(self.open))
            self.inline.append({})
        self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    @staticmethod
    def _marked(tag, attrs, within):
        if tag in ("html", "body"):
            return 0
        a = dict(attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style") or ""):
            return _HARD
        if tag == "header":
            return 0 if within else _SOFT
        said = {w for k in ("class", "id", "role") for token in (a.get(k) or "").lower().split() for w in _marks_of(token)}
        if said & (_WITHIN if within and tag not in _CONTENT else _FOREIGN) and (tag not in _HEADINGS or said & _EVERYWHERE):
            return _HARD
        if tag in _CONTENT:
            return 0
        if tag in _HEADINGS:
            return _SOFT if said & _EVERYWHERE else 0
        if within:
            return _HARD if _ROLES & set((a.get("role") or "").lower().split()) else 0
        return _SOFT if said else 0

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag in _INLINE:
            self.tags += 1
            if same := self.inline[-1].get(tag):
                # its marks end with it; block elements opened inside stay open
                same.pop().ended = True
                self.count[tag] -= 1
                while self.open[-1].ended:
                    self.open.pop()
            return
        self.flush()
        if self.count[tag]:
            k = len(self.blocks) - 1
            while self.open[self.blocks[k]].tag != tag:
                if tag == "p":
                    return
                k -= 1
            self._cut(k)

    def _cut(self, k):
        """End the k-th open block and all that is open inside."""
        at = self.blocks[k]
        self.count.subtract(e.tag for e in self.open[at:] if not e.ended)
        del self.open[at:], self.blocks[k:], self.inline[k:]
        while self.open[-1].ended:
            self.open.pop()

    def handle_data(self, data):
        if self.open[-1].skipped:
            return
        self.parts.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())


def lines(html: str, chunk: int = 1 << 16) -> list[Line]:
    parser = _Lines()
    for at in range(0, len(html), chunk):
        parser.feed(html[at : at + chunk])
    parser.close()
    parser.flush()
    return parser.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Convolution with a normalised Gaussian kernel; the ends repeat."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None, sigma: float = 1.0, coefficient: float = 0.9) -> str:
    """Blocks of the content regions in page order, joined by two line ends.

    A line's ratio is its text over its tags. Lines whose smoothed ratio reaches `coefficient` standard deviations form
    the clusters; a region (an outermost article or main element, or else the nearest division) with such a line is
    content and is kept whole. If a page has article or main elements, other regions are not. Elsewhere a line that is
    mostly links goes, unless it is a paragraph and those of its region aren't. A form that holds most of the text is a wrapper.
    """
    found = lines(html or "")
    if any(x.content for x in found):
        found = [x for x in found if x.content]
    else:
        inside, size, linked = Counter(), Counter(), Counter()
        for x in found:
            inside[x.form] += len(x.text)
        found = [x for x in found if not x.form or 2 * inside[x.form] > inside.total()]
        for x in found:
            if x.block == "p":
                size[x.region] += len(x.text)
                linked[x.region] += x.linked
        found = [x for x in found if 2 * x.linked <= len(x.text) or (x.block == "p" and 2 * linked[x.region] <= size[x.region])]
    if not found:
        return ""
    score = smoothed(np.array([len(x.text) / max(1, x.tags) for x in found]), sigma)
    bound = min(coefficient * score.std(), score.max())
    content = {x.region for x, s in zip(found, score) if s >= bound}
    return "\n\n".join(x.text for x in found if x.region in content)


def extract(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages; null, empty or blank html has an empty text.

    Every row stands for itself, repeated ones too; other columns are not read. A page is read whole by one task, in time
    and memory that grow with its length alone, however deep its elements nest.
    """

    @F.pandas_udf("text string, n_chars long")
    def read(htmls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in htmls:
            texts = [main_text(h if isinstance(h, str) else None, **options) for h in s]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", read(F.col("html").cast("string")).alias("found")).select("page_id", "url", "found.*")
