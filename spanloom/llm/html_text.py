"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's HTMLParser streams events; text gathers in blocks, the
lines of the method, each with its number of characters, tags and characters
inside links. The ratios of unlinked characters to tags of the lines, in page
order, are smoothed with a Gaussian window, and the lines at or over one
standard deviation are content. The content region is the innermost element
that holds all content lines, or the article or else the main element around
it; what lies outside is left out. Blocks of the region are kept, short ones
too, but for parts that stand beside its text: by their tag (navigation,
asides, forms, footers, page headers), or by a name in class, id or role whose
words all tell of such a part (``sidebar-left`` does, ``has-sidebar`` and
``search-algorithms`` do not). Names that may as well belong to the text, such
as ``notice`` or ``tags``, count as an id outside of articles only. Such a name,
or a form, around half of the page's characters or more is a wrapper and does
not count; the other names do not if no text were left. Lists of links outside an article
are left out as well.

Defined results: null or empty html, and pages without text, give the empty
string. Unclosed and stray tags, comments and declarations are tolerated; what
a browser would not show of them is not text. Whole pages are parsed, of any
length and nesting, in time that grows with their length; other columns are
kept unless named like the added one, and repeated rows give equal texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video map".split())
ASIDE = frozenset("nav aside footer menu dialog button select textarea fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "a": {"a"}}
SCOPE = frozenset("body article section div main aside nav footer header table ul ol dl form blockquote".split())

# Words of names that tell of a part beside the text, those that a part of the text may have as well, and words that may go with both.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr masthead menu menubar modal nav navbar navigation navi newsletter pager pagination popup promo promotion "
    "respond sidebar sponsor sponsored subscribe subscription contentinfo complementary".split()
)
DOUBTFUL = frozenset(
    "alert banner copyright disclaimer discussion notice notices notification promoted rail recommended related replies search share "
    "sharing signup skip social tags toolbar topbar widget widgets".split()
)
WITH_BOTH = frozenset(
    "a and area articles bar block body bottom box button buttons by center column container content desktop entry first fixed form global "
    "google group header holder icon icons inner item items js label last layer left link links list local main message mobile more name news "
    "outer overlay page panel post posts primary reader right row secondary section site slot small sticky stories text thread to top "
    "unit us user wrap wrapper x".split()
)
ROOTS = ("article", "main")
CLOSES = {tag: frozenset(name for name, by in CLOSED_BY.items() if tag in by) for tag in {t for by in CLOSED_BY.values() for t in by}}
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_END_OF_COMMENT = re.compile(r"--!?>")
RADIUS, SIGMA = 2, 1.0
LINKED = 0.6
#: Why an element may stand beside the text.
BY_TAG, BY_NAME, IN_DOUBT = 1, 2, 3


def named(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names has words that all tell of a part beside the text, one of them from ``words``."""
    for name in value.split():
        found = _WORDS.findall(_HUMP.sub(r"\1 \2", name).lower())
        if not words.isdisjoint(found) and all(w in BESIDE or w in DOUBTFUL or w in WITH_BOTH for w in found):
            return True
    return False


class Line:
    __slots__ = ("pieces", "tags", "linked", "element")

    def __init__(self, element: int):
        self.pieces: list[tuple[int, str]] = []  # the nearest marked element around, and text
        self.tags, self.linked, self.element = 1, 0, element


class Blocks(HTMLParser):
    """Turns parser events into lines, and numbers elements in page order, so that an element's parts follow it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds: list[str] = [""]
        self.parent: list[int] = [-1]
        self.mark: list[int] = [0]
        self.marked: list[int] = [0]  # the nearest marked element around, itself included; 0 for none
        self.rooted: list[bool] = [False]
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # places on the stack, by tag
        self.scopes: list[int] = [0]
        self.lines: list[Line] = []
        self.now: Line | None = None
        self.links = self.hidden = 0

    def _mark(self, tag: str, attrs: list, rooted: bool) -> int:
        if tag in ASIDE or tag == "header" and not rooted:
            return BY_TAG
        if tag == "form":
            return IN_DOUBT
        doubt = False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                return BY_TAG
            if not value or name not in ("class", "id", "role") or tag in ("body", "html", "main"):
                continue
            if (name != "id" or tag in SCOPE) and named(value, BESIDE):
                return BY_NAME
            doubt = doubt or tag != "article" and (name != "id" or not rooted and tag in SCOPE) and named(value, DOUBTFUL)
        return IN_DOUBT if doubt else 0

    def handle_starttag(self, tag, attrs):
        ends = [self.places[name][-1] for name in CLOSES.get(tag, ()) if self.places.get(name)]
        if ends and max(ends) > self.scopes[-1]:
            self._close(max(ends))
        if tag in BLOCK:
            self.now = None
        elif self.now is not None:
            self.now.tags += 1
        if tag == "br" and self.now is not None:
            self.now.pieces.append((self.marked[self.stack[-1]], " "))
        if tag in VOID:
            return
        above, number = self.stack[-1], len(self.kinds)
        mark = 0 if self.hidden else self._mark(tag, attrs, self.rooted[above])
        self.kinds.append(tag)
        self.parent.append(above)
        self.mark.append(mark)
        self.marked.append(number if mark else self.marked[above])
        self.rooted.append(self.rooted[above] or tag in ROOTS)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(number)
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.kinds[self.stack.pop()]
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            if tag in BLOCK:
                self.now = None

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.now = None
        elif self.now is not None:
            self.now.tags += 1
        places = self.places.get(tag)
        if places and (tag in SCOPE or places[-1] > self.scopes[-1]):
            self._close(places[-1])

    def handle_data(self, data):
        if self.hidden:
            return
        if self.now is None:
            if not data.strip():
                return
            self.now = Line(self.stack[-1])
            self.lines.append(self.now)
        self.now.pieces.append((self.marked[self.stack[-1]], data))
        if self.links:
            self.now.linked += len(data.strip())

    # Declarations and comments end where a browser ends them; those that never end reach to the end of the page.

    def parse_comment(self, i, report=1):
        text = self.rawdata
        if text.startswith(">", i + 4):
            return i + 5
        if text.startswith("->", i + 4):
            return i + 6
        end = _END_OF_COMMENT.search(text, i + 4)
        return end.end() if end else len(text)

    def parse_html_declaration(self, i):
        text = self.rawdata
        at = text.find(">", i)
        subset = text.find("[", i, at) if text[i : i + 9].lower() == "<!doctype" else -1
        if subset >= 0:
            at = text.find("]>", subset) + 1 or -1
        return at + 1 if at >= 0 else len(text)

    def parse_pi(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian window, whose weights count only where there are lines."""
    weights = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    total = np.convolve(ratios, weights, mode="full")[RADIUS : RADIUS + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights, mode="full")[RADIUS : RADIUS + len(ratios)]


def content_lines(ratios: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Which lines are content: free ones whose smoothed ratio is at or over one standard deviation, or all free ones if none is."""
    smooth = smoothed(np.where(free, ratios, 0.0))
    found = free & (smooth >= smooth.std())
    return found if found.any() else free


def _sums(parent: list[int], own: np.ndarray) -> list[float]:
    """Each element's amount and those of all elements in it."""
    total = own.tolist()
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    return total


def _cut(html: str) -> str:
    """The page without a tag that never ends."""
    at = html.rfind("<")
    return html[:at] if at >= 0 and ">" not in html[at:] and re.match(r"[A-Za-z/!?]", html[at + 1 : at + 2]) else html


def _outside(parser: Blocks, amounts: np.ndarray) -> list[bool]:
    """Whether each element is in a part beside the text."""
    held = _sums(parser.parent, amounts)
    wrapper = [2 * x >= held[0] for x in held]
    out: list[bool] = []
    for lifted in ((IN_DOUBT,), (IN_DOUBT, BY_NAME)):
        out = [False]
        for k in range(1, len(parser.mark)):
            out.append(out[parser.parent[k]] or parser.mark[k] != 0 and not (wrapper[k] and parser.mark[k] in lifted))
        if any(x and not out[k] for k, x in enumerate(amounts.tolist())):
            break
    return out


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(_cut(html or ""))
    parser.close()
    lines = [x for x in parser.lines if any(piece.strip() for _, piece in x.pieces)]
    if not lines:
        return ""
    # Amounts stand at the nearest marked element of each piece, or at the line's own if none of it is marked apart.
    amounts = np.zeros(len(parser.kinds))
    for x in lines:
        for at, piece in x.pieces:
            amounts[max(at, x.element)] += len(piece.strip())
    outside = _outside(parser, amounts)
    texts = [" ".join("".join(piece for at, piece in x.pieces if not outside[at]).split()) for x in lines]
    free = np.array([bool(t) for t in texts])
    if not free.any():
        return ""
    unlinked = np.array([max(len(t) - x.linked, 0) for t, x in zip(texts, lines, strict=True)], float)
    content = content_lines(unlinked / [x.tags for x in lines], free)
    # The innermost element whose parts hold all content lines is the last in page order that does.
    many = np.bincount([lines[k].element for k in np.flatnonzero(content)], minlength=len(parser.kinds))
    inside = _sums(parser.parent, many)
    region = max(k for k, n in enumerate(inside) if n == inside[0])
    while region and parser.kinds[region] not in SCOPE:
        region = parser.parent[region]
    for root in ROOTS:
        found, k = 0, region
        while k > 0:
            found = k if parser.kinds[k] == root else found
            k = parser.parent[k]
        if found:
            region = found
            break
    size = _sums(parser.parent, np.ones(len(parser.kinds)))
    kept = []
    for text, x in zip(texts, lines, strict=True):
        if not text or not region <= x.element < region + size[region]:
            continue
        listed = x.linked >= LINKED * len(text) and parser.kinds[x.element] in ("li", "ul", "ol", "td", "div", "a")
        if listed and not parser.rooted[x.element]:
            continue
        kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page."""
    keep = [f for f in pages.schema.fields if f.name != text]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x) for x in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, text])

    return pages.mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))
