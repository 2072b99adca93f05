"""HTML extraction: parser events, text-to-tag ratio per line, smoothing, threshold clustering.

The standard library's parser streams events; every block of text is a line. A line's
ratio is its text outside links by its tags. The ratios are smoothed with a Gaussian; lines above
the spread of the smoothed ratios are content. The content region is the outermost article,
main or element with such an id that holds nearly all text outside links. All its lines are kept,
short ones too, but for those in headers, footers, sidebars, notices, adverts, forms, comments
of readers and scripts, which are known by their elements, roles and class names. A form with
nearly all text is not dropped, and an article ends the drop of an element around it unless
that is closed and may hold other articles, such as comments. Without such a region all other
lines of the page are kept, lines and lists of nothing but links only as paragraphs, as headings,
and between the first content line and the last one.

Null and empty pages, and pages without text, give the empty string. Unclosed and stray tags
are tolerated. Repeated rows are extracted one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from locengine.llm.common import text_columns

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HEAD = set("title meta link script style base noscript template".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADINGS | set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset header hgroup hr html legend li main menu "
    "nav ol option p pre search section select summary table tbody td tfoot th thead title tr "
    "ul".split()
)
_DROPPED = set(
    "aside button canvas dialog embed footer form head iframe input menu nav noscript object "
    "option script search select style svg template textarea title".split()
)
_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
_NAMES = set(
    "ad ads advert advertisement advertisements advertising adverts alert banner breadcrumb "
    "breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead "
    "menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promoted promotion recommended related replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_CONTENT = set("article body content entry main post story".split())
# What may hold other articles than the page's own, and what is never shown.
_OTHERS = set(
    "aside dialog footer alertdialog complementary contentinfo comment comments disqus modal "
    "overlay popup promo promoted promotion recommended related replies reply respond sidebar "
    "sponsored widget widgets".split()
)
_UNSEEN = _DROPPED - _BLOCKS | {"head", "option", "select", "title"}
_NEGATED = {"has", "no", "with", "without"}
_SECTIONS = {"html", "body", "main", "article"}
_WHOLE = _SECTIONS - {"html", "body"}
# Elements that an opening tag of the same kind ends.
_SIBLINGS = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: Element | None
    own: int = 0  # dropped for itself: 1, as one that may hold other articles: 2
    unseen: bool = False
    form: bool = False  # dropped only as a form
    dropped: int = 0
    closed: bool = False
    header: bool = False  # only its headings count
    inside: bool = False  # in an article
    whole: bool = False  # an article, main or element with such an id
    chars: int = 0  # outside links


@dataclass
class Line:
    element: Element
    text: str
    chars: int  # without spaces
    linked: int
    tags: int  # so far in the page, later since the line before


@lru_cache(4096)
def _names(value: str | None) -> frozenset[str]:
    parts = re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value or "").lower())
    return frozenset(p for i, p in enumerate(parts) if not (i and parts[i - 1] in _NEGATED))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None)
        self.open = [self.root]
        self.elements: list[Element] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.links = self.linked = self.tags = 0

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            self.parts.clear()
            if words:
                text = " ".join(words)
                chars = len(text) - len(words) + 1
                self.lines.append(Line(self.open[-1], text, chars, self.linked, self.tags))
        self.linked = 0

    def updatepos(self, i, j):
        return j  # positions are not asked for

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in _BLOCKS and tag not in _DROPPED:
            return
        if tag in _VOID:
            if tag in _BLOCKS:
                self.flush()
            return
        if tag not in _BLOCKS:  # a script may stand within a line
            self.open.append(self._element(tag, attrs))
            return
        self.flush()
        self.links = 0
        while len(self.open) > 1 and self.open[-1].tag in _SIBLINGS.get(tag, ()):
            self.open.pop()
        if tag not in _HEAD and self.open[-1].tag == "head":
            self.open.pop()
        if tag != "p" and self.open[-1].tag == "p":
            self.open.pop()
        self.open.append(self._element(tag, attrs))

    def _element(self, tag: str, attrs: list) -> Element:
        above = self.open[-1]
        element = Element(tag, above, unseen=above.unseen or tag in _UNSEEN)
        self.elements.append(element)
        element.inside = above.inside or tag in ("article", "main")
        element.whole = tag in _WHOLE
        bad, header, others = False, tag == "header", tag in _OTHERS
        if attrs:
            attrs = dict(attrs)
            names = _names(attrs.get("class")) | _names(attrs.get("id"))
            role = (attrs.get("role") or "").lower()
            bad = tag not in _SECTIONS and bool(names & _NAMES) and not names & _CONTENT
            bad |= role in _ROLES and tag not in _SECTIONS
            hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
            element.unseen |= hidden or bool(_HIDDEN.search(attrs.get("style") or ""))
            header |= "header" in names and tag not in _SECTIONS
            others |= bad and bool(names & _OTHERS or role in _OTHERS)
            element.whole |= role == "main"
            named = _names(attrs.get("id")) - {""}
            element.whole |= tag == "div" and bool(named) and named <= _CONTENT
        element.header = above.header or header
        bad |= header and not element.inside
        element.form = tag == "form" and not bad
        if bad or tag in _DROPPED or element.unseen:
            element.own = 2 if others else 1
        return element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # browsers take <p/> for <p>

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in _BLOCKS or tag in _DROPPED:
            if tag in _BLOCKS:
                self.flush()
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    self.open[i].closed = True
                    del self.open[i:]
                    break

    def handle_data(self, data):
        if self.open[-1].unseen:
            return
        self.parts.append(data)
        if self.links:
            self.linked += sum(map(len, data.split()))


    def settle(self, kept: set[int], others: bool = False) -> list[Line]:
        """Lines that are not dropped. An article ends the drop that it stands in, unless that may
        hold other articles and is closed; main ends both. Forms in `kept` are not dropped."""
        for x in self.elements:
            above = x.parent.dropped
            if x.tag == "main" or x.tag == "article" and (above == 1 or others):
                above = 0
            own = 1 if x.own == 2 and not x.closed else x.own
            x.dropped = max(above, 0 if id(x) in kept else own)
        return [x for x in self.lines if not (x.element.dropped or x.element.unseen)]

    def shown(self, share: float) -> list[Line]:
        """Lines that are not dropped; a form with that share of the text is the page itself."""
        lines = self.settle(set())
        forms = {id(x) for x in self.elements if x.form}
        if forms:
            free = self.settle(forms)
            held = Counter()
            for line in free:
                above = line.element
                while above is not None:
                    if above.form:
                        held[id(above)] += line.chars
                    above = above.parent
            total = sum(x.chars for x in free)
            lines = self.settle({k for k, n in held.items() if n >= share * total})
        lines = lines or self.settle(set(), others=True)
        before = 0
        for line in lines:
            line.tags, before = line.tags - before, line.tags
        return lines


def _menus(lines: list[Line]) -> set[int]:
    """Lists of at least three entries that hold nothing but links."""
    lists: dict[int, list[bool]] = {}
    for line in lines:
        if line.element.tag == "li" and line.element.parent is not None:
            full = line.linked >= line.chars
            lists.setdefault(id(line.element.parent), []).append(full)
    return {key for key, full in lists.items() if len(full) >= 3 and all(full)}


def smoothed(ratios: np.ndarray, spread: float = 1.0) -> np.ndarray:
    """The ratios under a Gaussian of three times the spread to either side."""
    reach = max(1, int(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel, mode="valid")


def content_lines(lines: list[Line], factor: float = 1.0) -> np.ndarray:
    """Which lines lie above `factor` times the spread of the smoothed ratios."""
    ratios = np.array([(x.chars - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    smooth = smoothed(ratios)
    found = smooth >= factor * smooth.std()
    return found if found.any() else ratios > 0


def _only_links(line: Line) -> bool:
    return line.linked >= line.chars and line.element.tag not in ("p", *_HEADINGS)


def _within(element: Element | None, best: Element) -> bool:
    while element is not None and element is not best:
        element = element.parent
    return element is not None


def _region(lines: list[Line], share: float) -> Element | None:
    """The outermost article, main or element named so with that share of the text outside links."""
    total = sum(max(0, x.chars - x.linked) for x in lines)
    best = None
    for line in lines:
        above = line.element
        while above is not None:
            above.chars += max(0, line.chars - line.linked)
            if above.whole and (best is None or above.chars > best.chars):
                best = above
            above = above.parent
    if best is None or not total or best.chars < share * total:
        return None
    above = best.parent
    while above is not None:
        best = above if above.whole else best
        above = above.parent
    return best


def main_text(page: str, share: float = 0.85) -> str:
    """The article's lines, joined by line ends."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    lines = reader.shown(share)
    lines = [x for x in lines if not x.element.header or x.element.tag in _HEADINGS]
    if not lines:
        return ""
    best = _region(lines, share)
    if best is not None:
        return "\n".join(x.text for x in lines if _within(x.element, best))
    menus = _menus(lines)
    listed = [id(x.element.parent) in menus for x in lines]
    rest = [i for i, menu in enumerate(listed) if not menu]
    if not rest:
        return ""
    content = np.flatnonzero(content_lines([lines[i] for i in rest]))
    first, last = rest[content[0]], rest[content[-1]]
    kept = (
        x
        for i, x in enumerate(lines)
        if first <= i <= last or not (listed[i] or _only_links(x))
    )
    return "\n".join(x.text for x in kept)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages without the html column, with main_text and n_chars, its code points.

    Columns of the input with these names are replaced.
    """

    def compute(raws):
        texts = [main_text(r.decode("utf-8", "replace")) if r else "" for r in raws]
        return [texts, [len(t) for t in texts]]

    fields = [StructField("main_text", StringType()), StructField("n_chars", LongType())]
    return text_columns(pages, html, fields, compute).drop(html)
