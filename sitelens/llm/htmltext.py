"""Operator 4, main text of HTML pages by line-block distribution.

Markup is stripped into lines.  A block element or <br> ends a line; where a
container (div, section, table, cell) begins or ends and where an element that
is never article text was removed (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts: by element, role or whole class name) there is
an empty line; at the edges of article and main there are WINDOW of them.  A line
weighs its text, or nothing if most of it is links and it is no heading.  Weights are
summed over sliding windows of WINDOW lines.  Text surges where the sum leaves
zero and dives where it is back at zero; a stretch between the two is kept if a
window in it reaches SURGE of the page's heaviest window.

Where an article or main element has text, the text surges where they begin and dives where
they end: all their lines are kept, links too, but for the elements above.

Names of controls ("search", "menu", "share") tell nothing of paragraphs, headings and
quotations inside them, and a form that holds an article, main or first or second
heading is the frame of the page, no form of fields.

Elements end where HTML lets their end tags be omitted (head, p, li, dt, dd, rows
and cells) or where an element around them ends.  Quotes only matter after an
equals sign; a slash at a tag's end makes the element empty.

Defined results: null, empty and text-less pages give empty text and 0
characters; raw-text elements and comments that are not closed hide the rest of the page, other
unclosed elements end with what holds them; stretches that tie are kept alike; a page whose
text is all links is kept whole; repeated rows each give theirs.  Extra columns
pass through, those named like a computed one are replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lines of a sliding window.
WINDOW = 3
#: Share of the page's heaviest window that a stretch must reach outside article and main.
SURGE = 0.2
#: Share of a line's characters in links beyond which it weighs nothing.
MOST_LINKED = 0.5

_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))")

# element names of the HTML standard
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LINE_ENDS = frozenset("br hr".split())
_CONTAINERS = frozenset("div section table td th center fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("base link meta noscript template".split())
_SCOPES = frozenset("table td th caption template object button applet marquee".split())
_LISTS = frozenset("ul ol menu dl".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt li fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What an element of a table or list ends when it begins, innermost last.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot")}

# what is never article text: elements, roles, and class names or ids
_DROPPED = frozenset("head nav footer aside form button dialog menu header noscript template svg select object canvas".split())
_MAIN = frozenset("article main".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_COMMENTS = frozenset("comment comments reply replies disqus".split())
#: Names that say so as the last word of a longer name as well ("site-footer").
_DROPPED_NOUNS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comments disqus menu toolbar pagination pager newsletter popup modal notice notices banner consent".split()
)
#: Names that say so alone.
_DROPPED_NAMES = _DROPPED_NOUNS | _COMMENTS | frozenset(
    "header sponsor sponsored promo promotion share sharing social related recommended cookie cookies gdpr subscribe subscription overlay login "
    "signup search widget related-posts related-articles".split()
)
#: Last words that only say what holds the thing ("ad-slot", "comments-area").
_HOLDERS = frozenset("area bar block box button buttons container content form inner item items link links list outer panel region section slot unit wrap wrapper".split())
#: Names of controls and lists of links; a block of running text that has one is text all the same.
_CONTROLS = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs menu toolbar pagination pager share sharing social related related-articles related-posts "
    "login signup search widget header masthead".split()
)
_RUNNING = _HEADINGS | frozenset("p blockquote pre figcaption".split())
_FRAME = re.compile(r"<(?:article|main|h1|h2)(?=[\s/>])", re.IGNORECASE)
_FORM_ENDS = re.compile(r"</form(?=[\s/>])", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")


@lru_cache(maxsize=4096)
def _names_dropped(name: str, in_main: bool, running: bool = False) -> bool:
    """Whether a class name or id tells of something that is no article text."""
    low = name.lower()
    if running and low in _CONTROLS:
        return False
    if low in _DROPPED_NAMES:
        return not (in_main and low == "header")
    words = [w.lower() for w in _WORDS.findall(name)]
    whole = len(words)
    while words and (words[-1] in _HOLDERS or words[-1].isdigit()):
        words.pop()
    if not words:
        return False
    if running and words[-1] in _CONTROLS:
        return False
    if len(words) == 1 and len(words) < whole:
        return words[0] in _DROPPED_NAMES and not (in_main and words[0] == "header")
    return words[-1] in _DROPPED_NOUNS


@lru_cache(maxsize=4096)
def is_dropped(name: str, attributes: str, in_main: bool) -> bool:
    """Elements that hold no article text, by name, role, class or id."""
    if name in _DROPPED:
        return not (name == "header" and in_main)  # an article's own header has its title
    if "=" not in attributes or name in ("html", "body"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "role":
            if value.lower() in _DROPPED_ROLES:
                return True
        elif key in ("class", "id"):
            if name in _MAIN:
                if any(v.lower() in _COMMENTS for v in value.split()):
                    return True
            elif any(_names_dropped(v, in_main, in_main and name in _RUNNING) for v in value.split()):
                return True
    return False


def is_empty_element(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    return attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'" or "=" not in attributes)


class _Page:
    """Lines of a page (text, weight, whether in article or main) and the elements that are open."""

    def __init__(self):
        self.text: list[str] = []
        self.weight: list[int] = []
        self.main: list[bool] = []
        self._parts: list[str] = []
        self._linked, self._heading = 0, False
        # open elements as (name, is a block, is dropped, is main), and where each kind is
        self._open: list[tuple[str, bool, bool, bool]] = []
        self._places: defaultdict[str, list[int]] = defaultdict(list)
        self._blocks, self._scopes, self._lists = [-1], [-1], [-1]
        self.dropped = self._mains = self._headings = 0

    # -- lines --

    def add(self, text: str) -> None:
        if self._open and self._open[-1][0] == "head" and text.strip():
            self._close(len(self._open) - 1)
        if not self.dropped:
            self._parts.append(text)
            self._heading |= self._headings > 0
            if self._places["a"]:
                self._linked += len(text)

    def _end_line(self) -> None:
        if self._parts:
            whole = "".join(self._parts)
            if line := " ".join(whole.split()):
                self.text.append(line)
                self.weight.append(len(line) if self._heading or self._linked <= MOST_LINKED * len(whole) else 0)
                self.main.append(self._mains > 0)
            self._parts, self._linked, self._heading = [], 0, False

    def _gap(self, lines: int) -> None:
        self._end_line()
        self.text += [""] * lines
        self.weight += [0] * lines
        self.main += [self._mains > 0] * lines

    # -- elements --

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            name, block, dropped, main = self._open.pop()
            self._places[name].pop()
            for kind, places in ((block, self._blocks), (name in _SCOPES, self._scopes), (name in _LISTS, self._lists)):
                if kind:
                    places.pop()
            if dropped:
                self.dropped -= 1
            elif not self.dropped:
                if main:
                    self._gap(WINDOW)
                    self._mains -= 1
                elif name in _CONTAINERS:
                    self._gap(1)
                elif block:
                    self._end_line()
                self._headings -= name in _HEADINGS

    def _last(self, *names: str) -> int:
        return max((self._places[n][-1] for n in names if self._places[n]), default=-1)

    def _close_omitted(self, name: str) -> None:
        """End the elements whose end tags may be left out before ``name``."""
        if self._open and self._open[-1][0] == "head" and name not in _IN_HEAD:
            self._close(len(self._open) - 1)
        if name in _ENDS_P and (at := self._last("p")) > self._scopes[-1]:
            self._close(at)
        if name in _HEADINGS and self._open and self._open[-1][0] in _HEADINGS:
            self._close(len(self._open) - 1)
        if name in _ENDS:
            edge = max(self._lists[-1], self._scopes[-1]) if name in ("li", "dt", "dd") else self._last("table")
            if (at := self._last(*_ENDS[name])) > edge:
                self._close(at)
        if name == "a" and (at := self._last("a")) > self._blocks[-1]:
            self._close(at)

    def begin(self, name: str, attributes: str, frame: bool = False) -> None:
        if name in ("html", "body") and self._places[name]:
            return
        self._close_omitted(name)
        if name in _VOID:
            if name in _LINE_ENDS and not self.dropped:
                self._end_line()
            return
        block = name not in _INLINE
        drop = is_dropped(name, attributes, self._mains > 0) and not frame
        main = name in _MAIN and not drop and not self.dropped
        if not self.dropped:
            if main:
                self._gap(WINDOW)
            elif block and (drop or name in _CONTAINERS):
                self._gap(1)
            elif block:
                self._end_line()
        if is_empty_element(attributes):
            return
        if not drop and not self.dropped:
            self._mains += main
            self._headings += name in _HEADINGS
        at = len(self._open)
        self._open.append((name, block, drop, main))
        self._places[name].append(at)
        for kind, places in ((block, self._blocks), (name in _SCOPES, self._scopes), (name in _LISTS, self._lists)):
            if kind:
                places.append(at)
        self.dropped += drop

    def end(self, name: str) -> None:
        if name in ("body", "html"):
            self._close(self._last("body", "html") + 1)
            return
        at = self._last(name)
        if name in _INLINE:
            if at > self._blocks[-1]:
                self._close(at)
        elif at >= 0 and (at >= self._scopes[-1] or name in ("table", "tr", "tbody", "thead", "tfoot") and at >= self._last("table")):
            self._close(at)
        elif name in ("p", "br") and not self.dropped:
            self._end_line()

    def finish(self) -> None:
        self._close(0)
        self._end_line()


def _is_frame(page: str, at: int) -> bool:
    """Whether the form that begins at a place holds an article, main or leading heading."""
    ends = _FORM_ENDS.search(page, at)
    return _FRAME.search(page, at, ends.start() if ends else len(page)) is not None


def strip_markup(page: str) -> _Page:
    """The page's lines, with empty ones where containers meet and elements were removed."""
    out, at = _Page(), 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            out.add(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        if m[2]:
            out.end(m[3].lower())
        else:
            name = m[3].lower()
            out.begin(name, m[4], name == "form" and not out.dropped and _is_frame(page, at))
    if at < len(page):
        out.add(html.unescape(page[at:]))
    out.finish()
    return out


def stretches(weights: np.ndarray, window: int = WINDOW, least: float = 0) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: where sums over ``window`` lines rise from zero and fall back, if one of them reaches ``least``."""
    if not len(weights):
        return []
    total = np.cumsum(np.r_[np.zeros(window, np.int64), weights])
    sums = total[window:] - total[:-window]  # of a line and the window - 1 before it
    on = np.diff(np.r_[0, (sums > 0).astype(np.int8), 0])
    found = zip(np.flatnonzero(on > 0).tolist(), np.flatnonzero(on < 0).tolist(), strict=True)
    return [(a, b) for a, b in found if sums[a:b].max() >= least]


def chosen_lines(text: list[str], weight: list[int], main: list[bool]) -> list[str]:
    """The lines of article and main where they have any, else those between surge and dive points."""
    if any(m and t for m, t in zip(main, text, strict=True)):
        return [t for t, m in zip(text, main, strict=True) if t and m]
    weights = np.array(weight, np.int64)
    if not weights.any():  # nothing but links
        return [t for t in text if t]
    total = np.cumsum(np.r_[np.zeros(WINDOW, np.int64), weights])
    out = []
    for a, b in stretches(weights, WINDOW, SURGE * int((total[WINDOW:] - total[:-WINDOW]).max())):
        last = a + int(np.flatnonzero(weights[a:b])[-1]) + 1
        while last < b and text[last]:  # links right below, in the same container
            last += 1
        out += [t for t in text[a:last] if t]
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    if not page:
        return ""
    lines = strip_markup(page)
    return "\n".join(chosen_lines(lines.text, lines.weight, lines.main))


@F.arrow_udf(StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` and its number of code points, ``n_chars``."""
    out = pages.withColumn("main_text", _main_text(F.col(source)))
    return out.withColumn("n_chars", F.length("main_text").cast("long"))
