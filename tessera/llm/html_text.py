"""HTML main text by line-block distribution.

Markup is stripped into one line per block element. Text lengths (link text apart) are summed over sliding windows of
lines; a surge is where the sum rises over a threshold, the dive where it falls to nothing. Text between them is main
text. Elements that are never main text (menus, notices, forms, scripts and so on) give no lines; an element whose
class only mentions such a word gives lines of half their length. A range that a surge opens grows to the bounds of the
article element, or smallest element, that holds it, so short paragraphs at its ends are kept whole.

A page is read once from left to right and every step is bounded by what it consumes, so the time of any page, however
broken, grows with its length.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not main text (fixed values).
DROPPED = frozenset("head title nav footer aside form script style noscript template svg canvas iframe object embed button select option textarea input label menu dialog audio video map".split())
#: Dropped only outside an article: a page's header, not a text's.
OUTER = frozenset(["header"])
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Content of these is text up to their end tag, whatever it looks like (fixed values).
RAW = frozenset("script style textarea title xmp noframes".split())
#: Words in class or id that mark what is not main text (fixed values).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist disqus respond reply replies widget widgets pagination pager search skip copyright legal disclaimer".split()
)
#: Words that say what kind of element it is, or where; beside a mark they change nothing (fixed values).
FURNITURE = frozenset(
    "area article articles bar block bottom box btn button card cards center col column container content cta div element entry first floating footer form global group header heading holder icon icons "
    "inner item items js label last left line link links list main message middle mobile outer page panel popular post posts primary reader readers right row secondary section site slot small sticky sub "
    "text title top unit us user users wrap wrapper".split()
)
#: Roles that are not main text (fixed values).
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Elements that can hold a whole article.
ARTICLES = frozenset(["article", "main"])
#: An element of these tags closes an open one of the given tags, if none of _SCOPES was opened after it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote td th".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)(>)?+")
_NAME = re.compile(r"[\s/]*+(?:([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(\s*+=\s*+)?+)?+")
_BARE = re.compile(r"[^\s>]*+")
_PART = re.compile(r"[A-Z]++(?![a-z])|[A-Z]?[a-z]++")
_ZEROS = re.compile(r"&#0++(?=[0-9])")
_HUGE = re.compile(r"&#[0-9]{8,}+;?")


_NONE: dict[str, str] = {}
#: What holds a line of no element: tag, weight, in a link, article depth, page elements, block.
_ROOT = ("", 1.0, False, 0, 0, False)


class _Line(NamedTuple):
    text: str
    size: int  # characters outside links; 0 if most are in links
    depth: int  # open elements that hold it
    common: int  # how many of them hold the line before it too
    page: int  # how many of them, from the outermost, are the page itself
    article: int  # how deep the outermost article element is, 0 if there is none


def _unescape(raw: str) -> str:
    """Character references decoded; numbers beyond all characters are U+FFFD, as a reader shows them."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _HUGE.sub("�", _ZEROS.sub("&#", raw))
    return entities.unescape(raw)


def weight(attributes: dict[str, str]) -> float:
    """Of an element's text: 0 if a class, id or role says that it is not main text, 0.5 if one mentions such a word."""
    if attributes.get("role", "").strip().lower() in ROLES:
        return 0.0
    out = 1.0
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for name in value.split():
            parts = [x.lower() for x in _PART.findall(name)]
            if any(x in MARKS for x in parts):
                if all(x in MARKS or x in FURNITURE for x in parts):
                    return 0.0
                out = 0.5
    return out


class _Page:
    """Reads a page into lines. Where an element of a tag is open is kept per tag, so that no end tag needs a search."""

    def __init__(self, page: str):
        self.page = page
        self.out: list[_Line] = []
        self.stack: list[tuple[str, float, bool, int, int, bool]] = []  # as _ROOT
        self.open: dict[str, list[int]] = {}  # tag: places in the stack
        self.scopes: list[int] = []
        self.text: list[str] = []
        self.linked = self.low = 0
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                depth = len(self.stack)
                _, by, _, article, outer, _ = self.stack[-1] if depth else _ROOT
                size = max(0, len(line) - self.linked)
                self.out.append(_Line(line, int(size * by) if size * 2 >= len(line) else 0, depth, min(self.low, depth), outer, article))
                self.low = depth
            self.text.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if not raw:
            return
        _, by, link, _, _, _ = self.stack[-1] if self.stack else _ROOT
        if by:
            raw = _unescape(raw)
            self.text.append(raw)
            if link:
                self.linked += len(raw.strip())

    def push(self, tag: str, by: float) -> None:
        _, above, link, article, outer, _ = self.stack[-1] if self.stack else _ROOT
        depth = len(self.stack)
        if not article and tag in ARTICLES:
            article = depth + 1
        if outer == depth and tag in ("html", "body"):
            outer += 1
        block = tag in BLOCKS
        self.stack.append((tag, above * by, link or tag == "a", article, outer, block))
        if tag in self.open:
            self.open[tag].append(depth)
        else:
            self.open[tag] = [depth]
        if tag in _SCOPES:
            self.scopes.append(depth)

    def pop_to(self, depth: int) -> None:
        if self.text and any(x[5] for x in self.stack[depth:]):
            self.flush()
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in _SCOPES:
                self.scopes.pop()
        self.low = min(self.low, depth)

    def innermost(self, tags: tuple[str, ...]) -> int:
        """The place in the stack of the innermost open element of these tags, -1 if none is open."""
        out = -1
        for t in tags:
            if at := self.open.get(t):
                out = max(out, at[-1])
        return out

    def tag(self, at: int) -> tuple[int, dict[str, str], bool]:
        """From behind a tag's name: where the tag ends (-1 if it never does), class, id and role, and whether it closes
        itself. A quote that is never closed ends nothing: it is read as a bare value."""
        page, found = self.page, {}
        while True:
            m = _NAME.match(page, at)
            at = m.end()
            if m[1] is None:
                end = page.startswith(">", at)
                return (at + 1 if end else -1), found, page.startswith("/", at - 1)
            if m[2] is None:
                continue
            quote = page[at : at + 1]
            if quote in ('"', "'") and self.last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                b = _BARE.match(page, at)
                value, at = b[0], b.end()
            name = m[1].lower()
            if name in ("class", "id", "role"):
                found.setdefault(name, value)

    def lines(self) -> list[_Line]:
        page, n, at = self.page, len(self.page), 0
        cdata = True
        while at < n:
            mark = _OPEN.search(page, at)
            start = mark.start() if mark else n
            self.add(page[at:start])
            if start > self.last[">"]:
                break  # the text ends, or a tag that never does, which is no text
            m = _TAG.match(page, start)
            if m is None:
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 4)
                    at = n if end < 0 else end + 3
                    continue
                if cdata and page.startswith("<![CDATA[", start):
                    end = page.find("]]>", start + 9)
                    if end >= 0:
                        self.add(page[start + 9 : end])
                        at = end + 3
                        continue
                    cdata = False  # nor will a later one end
                at = page.index(">", start) + 1
                continue
            at, attributes, closed = (m.end(), _NONE, False) if m[2] else self.tag(m.end())
            if at < 0:
                break
            tag = m[1].lower()
            if page[start + 1] == "/":
                depth = self.innermost((tag,))
                if depth >= 0:
                    self.pop_to(depth)
                elif tag in BLOCKS:
                    self.flush()
            else:
                at = self.begin(tag, attributes, closed, at)
        self.pop_to(0)
        self.flush()
        return self.out

    def begin(self, tag: str, attributes: dict[str, str], closed: bool, at: int) -> int:
        if tag == "br":
            self.add(" ")
            return at
        if tag == "hr":
            self.flush()
        if tag in VOID:
            return at
        if tag == "body" and self.innermost(("head",)) >= 0:  # a head that was not closed ends here
            self.pop_to(self.innermost(("head",)))
        closes = self.innermost(_CLOSES.get(tag, ("p",) if tag in BLOCKS else ()))
        if closes >= 0 and closes >= (self.scopes[-1] if self.scopes else 0):
            self.pop_to(closes)
        if tag in BLOCKS:
            self.flush()
        by = weight(attributes) if attributes and tag not in ("html", "body", "main") else 1.0
        if tag in DROPPED or (tag in OUTER and not (self.stack and self.stack[-1][3])):
            by = 0.0
        if closed and tag not in BLOCKS:
            return at
        self.push(tag, by)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
            stop = end.start() if end else len(self.page)
            self.add(self.page[at:stop])
            self.pop_to(len(self.stack) - 1)
            at = self.page.find(">", stop) + 1 if end and self.last[">"] >= stop else len(self.page)
        return at


def lines(page: str) -> list[_Line]:
    """The lines of kept elements in page order."""
    return _Page(page).lines()


def ranges(found: list[_Line], width: int, threshold: int) -> list[tuple[int, int]]:
    """From each surge to its dive: sums over `width` lines that rise over threshold, until a window holds nothing."""
    size = [x.size for x in found]
    sums = [sum(size[i : i + width]) for i in range(len(size))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] > threshold and size[i]:
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            end = j
            while end > i and not size[end - 1]:
                end -= 1
            out.append((i, end))
            i = j
        else:
            i += 1
    return out


def _reach(common: list[int], ask: list[tuple[int, int]]) -> list[int]:
    """For (line, depth), lines ascending: the first of the lines up to it that the same element of that depth holds."""
    out, at, low = [], [], []
    k = 0
    for line, depth in ask:
        while k <= line:
            while low and low[-1] >= common[k]:
                low.pop(), at.pop()
            low.append(common[k]), at.append(k)
            k += 1
        below = bisect_left(low, depth)
        out.append(at[below - 1] if below else 0)
    return out


def main_text(page: str | None, width: int = 3, threshold: int = 60) -> str:
    """The main text: its blocks in page order, joined by newlines; empty if there is none."""
    found = lines(page or "")
    spans = ranges(found, width, threshold)
    if not spans:
        # No surge at all: only an article element, however short its text, is sure to be main text.
        return "\n".join(x.text for x in found if x.article)
    n = len(found)
    keep = [0] * (n + 1)  # +1 where kept lines begin, -1 where they end
    holders: list[tuple[int, int]] = []
    articles = False
    for i, j in spans:
        depth = min([found[i].depth, *(x.common for x in found[i + 1 : j])])
        if 0 < found[i].article <= depth:
            holders.append((i, found[i].article))
        elif depth > found[i].page:
            holders.append((i, depth))
        elif any(x.article for x in found[i:j]):
            articles = True  # the range runs out of an article element: keep the article, not its surroundings
        else:
            keep[i] += 1
            keep[j] -= 1
    common = [0, *(x.common for x in found[1:])]
    first = _reach(common, holders)
    # The same from the other end.
    back = [0, *common[:0:-1]]
    last = _reach(back, [(n - 1 - i, d) for i, d in reversed(holders)])
    for a, b in zip(first, reversed(last), strict=True):
        keep[a] += 1
        keep[n - b] -= 1
    out, level = [], 0
    for x, change in zip(found, keep, strict=False):
        level += change
        if level or (articles and x.article):
            out.append(x.text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the main text of each page, from its whole HTML, to all columns of pages; a column named out_col is replaced.

    A null page is empty and gives an empty text; so does a page whose text is all furniture. Very long and broken
    pages take time in proportion to their length. Rows are independent: repeated rows and null ids change nothing. An
    empty table gives no rows.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(x) for x in b], dtype=object)

    return pages.withColumn(out_col, run(F.coalesce(F.col(html_col), F.lit(""))))
