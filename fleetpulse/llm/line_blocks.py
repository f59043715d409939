"""HTML extraction by line-block distribution (operator 2).

Markup is stripped to lines: one line per block element. Tags are read as HTML5 reads them, attributes by their exact names,
in one pass. Text of elements that never hold an article (by element or role, hidden, or a container of reader comments,
articles inside it included) leaves an empty line, as scripts and styles do. Text lengths, links counted out, are summed over
sliding windows of ``WINDOW`` lines that hold text. A stretch begins at the surge, where a window's sum rises to the
threshold, and ends at the dive, which is the next container of boilerplate; the text of the lines between is kept, but for
lines half in links. Of the others those are kept that belong to kept lines (``_between``). What is lost: linked lines before
the first and after the last kept line or in a container of their own, and blocks below the threshold that have a container
of their own and precede the surge or stand between containers of boilerplate. The threshold is a share of the page's
fullest window, at most ``SURGE`` characters.

Forms and blocks with a whole class or id name that hints at boilerplate (teasers, side bars, adverts, ...) go with what they
hold, articles included, unless the page's text is there: a block that holds the fullest window is the text, where no article
outside such blocks has a full window (adverts and notices only where there is no other text). Where a part of a name hints at
boilerplate (``has-sidebar``), text counts by a share. Where the page names its article (``article``, ``main``, ``role=main`` or
``itemprop=articleBody``) and no window outside is fuller than the fullest inside, the lines inside are the text; a named
element that is only a teaser is a line block like others.

Defined cases: null or empty html gives an empty text; unclosed elements end where HTML has
their kind end (at the next of their kind, a block after ``p``), with an element around them, or with the page; a tag without
an end runs to the page's end; character references are decoded as HTML5 has it; white space (as HTML has it, and no-break
spaces) becomes one space. The time is linear in the page's length.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80
SURGE_SHARE = 0.2
LINK_SHARE = 0.5
#: What a character counts whose container is weakly hinted at as boilerplate.
WEAK_SHARE = 0.5

#: Element names of HTML by their role here.
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img picture source svg path math".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset(
    "head nav header footer aside menu button select option svg math object audio video canvas dialog template noscript".split()
)
#: Elements whose text belongs to the container around them.
TRANSPARENT = frozenset(
    "html body p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th".split()
)
#: Opening tag -> (open elements it ends, elements it does not look beyond). Any block but these ends an open ``p``.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}
ENDS_P = ({"p"}, {"button", "object", "table", "td", "th"})
INSIDE_P = (INLINE | VOID | set("button select option optgroup svg math object audio video canvas".split())) - {"hr"}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert".split())
#: Whole class and id names. Reader comments are never text; adverts and notices only where there is nothing else; blocks
#: are judged by their windows (on containers only, not on a paragraph or list item).
COMMENTS = re.compile(
    r"(?:comments?|commentlist|respond|disqus(?:_thread)?)"
    r"|comments?[-_](?:area|block|body|box|container|content|entry|form|item|list|respond|section|text|thread|wrap|wrapper)"
)
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe pagination pager".split()
)
BLOCKS = frozenset("banner sidebar side-bar aside header masthead share sharing social related recommended widget toolbar".split())
HINTS = ADVERTS | BLOCKS

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_VALUE = re.compile(r"[^\s>]*")
_HINT = re.compile(r"[a-z]+(?:-bar)?")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


_NONE: dict[str, str] = {}


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, place behind the tag) from behind the tag's name; of one name the first counts."""
    out: dict[str, str] = {}
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n or page[at] == ">":
            return out, min(at + 1, n)
        name = _ATTR.match(page, at)
        at = name.end()
        value, equals = "", _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:  # a quote without an end: the tag ends at the next >
                    end = page.find(">", at)
                    at = end if end >= 0 else n
            else:
                m = _VALUE.match(page, at)
                value, at = m[0], m.end()
        out.setdefault(name[0].lower(), value)


def tags(page: str) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
    """(start, end, name, whether it is an end tag, attributes) of the page's tags, in order; comments and declarations have
    no name, nor have elements of raw text, which end behind their end tag."""
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        closes = page.startswith("/", at)
        name = _NAME.match(page, at + closes)
        if name:
            at = name.end()
            attrs, at = (_NONE, at + 1) if page.startswith(">", at) else _attributes(page, at)
            low = name[0].lower()
            if low in RAW_TEXT and not closes:
                close = _raw_end(low).search(page, at)
                at = (page.find(">", close.end()) + 1 or n) if close else n
                low = ""
            yield start, at, low, closes, attrs
        elif closes or page.startswith(("!", "?"), at):
            mark = "-->" if page.startswith("!--", at) else ">"
            end = page.find(mark, at + 1)
            at = end + len(mark) if end >= 0 else n
            yield start, at, "", False, _NONE


def _verdict(name: str, attrs: dict[str, str]) -> str:
    """'out' for what is never text, 'advert' and 'block' for what is only under conditions, 'main' for the article,
    'weak' where a part of a class or id name hints at boilerplate, '' for others."""
    if not attrs:
        return "out" if name in BOILERPLATE else "main" if name in ("article", "main") else "block" if name == "form" else ""
    role = attrs.get("role", "").strip().lower()
    if name in BOILERPLATE or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return "out"
    if "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return "out"
    marks = {x for k in ("class", "id") for x in attrs.get(k, "").lower().split()}
    if name in ("html", "body"):
        return ""
    if any(map(COMMENTS.fullmatch, marks)):
        return "out"
    if marks & ADVERTS:
        return "advert"
    if name == "form" or role == "form" or (marks & BLOCKS and name not in TRANSPARENT):
        return "block"
    if name in ("article", "main") or role == "main" or attrs.get("itemprop", "").lower() == "articlebody":
        return "main"
    return "weak" if any(w in HINTS or COMMENTS.fullmatch(w) for x in marks for w in _HINT.findall(x)) else ""


class _Open:
    """Stack of the open elements' names, with the places of every name."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, name: str) -> None:
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.places[name].append(len(self.names))
        self.names.append(name)

    def cut(self, at: int) -> None:
        for name in self.names[at:]:
            self.places[name].pop()
        del self.names[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def _highest(self, names) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def _lowest(self, ends: set[str], stops: set[str], at: int) -> int:
        """Lowest open element of ``ends`` above the highest of ``stops``."""
        open_ = [own for x in ends if (own := self.places.get(x))]
        if open_:
            floor = self._highest(stops)
            for own in open_:
                if own[-1] > floor:
                    at = min(at, own[bisect_right(own, floor)])
        return at

    def ended_by(self, name: str) -> int:
        """Height of the stack that an opening tag leaves: elements whose end tag may be left out end before it."""
        at = len(self.names)
        if at and self.names[-1] == "head" and name not in VOID:
            return at - 1
        if name not in INSIDE_P:
            at = self._lowest(*ENDS_P, at)
        return self._lowest(*ENDS[name], at) if name in ENDS else at

    def closed_by(self, name: str, skip: int) -> int:
        """Height of the stack that an end tag leaves; ``skip`` is the place of the skipped element, or -1."""
        n = len(self.names)
        if not self.places.get(name):
            return n
        at = self.places[name][-1]
        if name in INLINE and self.blocks and self.blocks[-1] > at:  # does not close the block it stands in
            return skip if skip >= 0 and self.names[skip] == name else n
        if name in ENDS and self._highest(ENDS[name][1]) > at:
            return n
        return at


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    inside: bool  # inside the article
    weak: bool  # a part of a class or id name around it hints at boilerplate
    parent: int  # number of the container around it, 0 for the page
    block: int = 0  # number of the innermost block that may be boilerplate, 0 for none
    broken: bool = False  # stands for a container of boilerplate


class Block(NamedTuple):
    """A form, teaser, advert, ...: text or boilerplate, by the page's windows."""

    around: int  # the next one around it
    advert: bool  # an advert or the like, or in one


def lines(page: str) -> tuple[list[Line], list[Block]]:
    """Every line of the page, and the blocks that lines refer to; a container of boilerplate gives an empty line."""
    out: list[Line] = []
    blocks = [Block(0, False)]
    text: list[str] = []
    linked, in_link = 0, 0
    stack, skip = _Open(), -1
    mains: list[int] = []  # places in the stack
    weak: list[int] = []
    judged: list[tuple[int, int, int]] = []  # (place in the stack, block, in a link before it)
    parents: list[tuple[int, int]] = []  # (place in the stack, number)
    containers = at = 0

    def flush() -> None:
        nonlocal linked
        if not text:
            return
        line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if line:
            out.append(Line(line, min(linked, len(line)), bool(mains), bool(weak), parents[-1][1] if parents else 0, judged[-1][1] if judged else 0))
        text.clear()
        linked = 0

    def boilerplate() -> None:
        out.append(Line("", 0, bool(mains), False, 0, judged[-1][1] if judged else 0, True))

    def close(height: int) -> None:
        nonlocal in_link
        for own in (weak, mains):
            while own and own[-1] >= height:
                own.pop()
        while parents and parents[-1][0] >= height:
            parents.pop()
        while judged and judged[-1][0] >= height:
            _, _, in_link = judged.pop()

    for start, end, name, closes, attrs in tags(page):
        if skip < 0 and start > at:
            part = page[at:start]
            text.append(part)
            if in_link:
                linked += len(part.strip())
        at = end
        if not name:
            continue
        opens = not closes and name not in VOID and not page.endswith("/", 0, at - 1)
        height = stack.closed_by(name, skip) if closes else stack.ended_by(name)
        if skip < 0 and (name not in INLINE or (judged and judged[-1][0] >= height)):
            flush()
        if height <= skip:
            skip = -1
            boilerplate()
        if height < len(stack.names):
            close(height)
            stack.cut(height)
        if skip >= 0:
            if opens:
                stack.push(name)
            continue
        if name == "a":
            in_link = 0 if closes else 1
        if not opens:
            continue
        verdict = _verdict(name, attrs)
        if verdict in ("out", "advert", "block") and name in INLINE:
            flush()
        if verdict == "out":
            skip = len(stack.names)
        elif verdict == "main":
            mains.append(len(stack.names))
        elif verdict in ("advert", "block"):
            if name in ("article", "main"):
                mains.append(len(stack.names))
            around = judged[-1][1] if judged else 0
            blocks.append(Block(around, verdict == "advert" or blocks[around].advert))
            judged.append((len(stack.names), len(blocks) - 1, in_link))
        elif verdict == "weak" and name not in INLINE:
            weak.append(len(stack.names))
        if name not in INLINE and name not in TRANSPARENT:
            containers += 1
            parents.append((len(stack.names), containers))
        stack.push(name)
    if skip < 0 and at < len(page):
        text.append(page[at:])
    flush()
    return out, blocks


def _windows(sizes: list[float]) -> np.ndarray:
    """Sum of every line's size and the next ones', ``WINDOW`` in all."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    return total[np.minimum(np.arange(n) + WINDOW, n)] - total[:-1]


def _size(x: Line) -> float:
    return 0 if x.linked >= LINK_SHARE * max(1, len(x.text)) else len(x.text) * (WEAK_SHARE if x.weak else 1)


def _judged(found: list[Line], blocks: list[Block]) -> list[Line]:
    """The lines with blocks of boilerplate turned into empty ones (one for each run)."""
    if len(blocks) == 1 or not any(x.text for x in found):
        return found
    own: dict[int, list[Line]] = defaultdict(list)
    for x in found:
        if x.text:
            own[x.block].append(x)
    full = {b: float(_windows([_size(x) for x in rows]).max()) for b, rows in own.items()}
    most = full.get(0, 0.0)
    article = max(_windows([_size(x) if x.inside else 0 for x in own[0]]), default=0) if own[0] else 0
    text = {0}
    for b in sorted(full, key=lambda b: (-full[b], b)):
        if full[b] <= most:
            break
        if (most == 0) if blocks[b].advert else (article < SURGE):
            while b:
                text.add(b)
                b = blocks[b].around
            break
    out: list[Line] = []
    for x in found:
        if x.block in text:
            out.append(x)
        elif not (out and out[-1].broken):
            out.append(Line("", 0, False, False, 0, 0, True))
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    found = _judged(*lines(page or ""))
    article = [len(x.text) if x.inside else 0 for x in found if x.text]
    if any(article) and _windows(article).max() >= _windows([0 if x.inside else _size(x) for x in found if x.text]).max():
        return " ".join(x.text for x in found if x.inside and x.text)
    blocks: list[list[Line]] = [[]]
    for x in found:
        if x.broken:
            blocks.append([])
        else:
            blocks[-1].append(x)
    rows = [x for own in blocks for x in own]
    sizes = [_size(x) for x in rows]
    if not any(sizes):
        return ""
    at = np.cumsum([0, *map(len, blocks)])
    sums = [_windows(sizes[i:j]) for i, j in zip(at, at[1:])]
    surge = min(SURGE, SURGE_SHARE * max(x.max() for x in sums if len(x)))
    kept = []
    for own, i in zip(sums, at):
        going = False
        for k, window in enumerate(own, i):
            going = going or (window >= surge and sizes[k] > 0)
            kept.append(going and sizes[k] > 0)
    return " ".join(x.text for x, k in zip(rows, _between(rows, sizes, kept)) if k)


def _between(rows: list[Line], sizes: list[float], kept: list[bool]) -> list[bool]:
    """``kept`` with the lines that belong to kept ones: linked or short lines between two of one parent, or in the parent
    of either; short lines in the parent of the next kept line before or after."""
    last, before = None, []
    for x, k in zip(rows, kept):
        last = x.parent if k else last
        before.append(last)
    out, after = list(kept), None
    for i in range(len(rows) - 1, -1, -1):
        if kept[i]:
            after = rows[i].parent
            continue
        both = before[i] is not None and after is not None
        beside = rows[i].parent in (before[i], after)
        out[i] = (both and before[i] == after) or (beside and (both or sizes[i] > 0))
    return out


def main_text(pages: DataFrame, *, html: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Rows without ``html`` but with their main text and its number of code points."""
    rest = [c for c in pages.columns if c not in (html, text, chars)]
    fields = [pages.schema[c] for c in rest]
    schema = T.StructType([*fields, T.StructField(text, T.StringType(), False), T.StructField(chars, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(len(rest))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            cols = [*batch.columns[: len(rest)], pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return pages.select(*rest, html).mapInArrow(run, schema)
