"""Main-text extraction by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm.common import BOX, ROWS_AT_ONCE, boxed, small_batches, table, text_or_empty, unboxed

#: Lines of a sliding window, and the window's text length at which the main text surges.
WINDOW, SURGE = 3, 80
#: Elements that end a line of text (fixed values).
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never main text (fixed values).
OUTSIDE = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input menu nav noscript object option select svg template textarea title video".split())
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "xmp"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the first kind, up to the nearest element of the second (HTML's optional end tags; fixed values).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}),
}
#: Words in class, id or role that mark what is not the article: kinds of content, and places on the page (fixed values).
KINDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr newsletter notice notices popup promo promoted related replies reply respond share sharing sponsor sponsored subscribe subscription alert".split()
)
PLACES = frozenset("banner breadcrumb breadcrumbs complementary contentinfo dialog footer header masthead menu menubar modal nav navbar navigation pager pagination search sidebar skip social tags toc toolbar widget widgets".split())
#: Kinds that an article or main element itself can be marked by.
OF_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored".split())
#: Elements that hold lines side by side.
HOLDERS = frozenset("html body main article section div td th li blockquote dd center details figure".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    inside: bool  # in an article or main element
    marked: tuple[int, ...]  # open elements that mark it as something else
    holder: int


class _Element(NamedTuple):
    number: int
    name: str
    left_out: bool  # by its name
    marked: bool  # by its class, id or role
    place: bool  # only by words for places
    article: bool


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """(marked as something else, by words for places only)."""
    if not attributes or name in ("html", "body"):
        return False, False
    words = {p.lower() for v in _NAMED.findall(attributes) for p in _PART.findall(v)}
    if name in ("article", "main"):
        return bool(words & OF_ARTICLE), False
    kinds = words & KINDS
    return bool(kinds or words & PLACES), not kinds


def lines_of(page: str) -> list[Line]:
    """The page's lines of text without markup, in order, marked or not; elements that are left out by name give an empty line.

    Open elements follow HTML's rules for end tags that may be left out: a block ends an open p, an li the li before it.
    An element marked by a word for a place that turns out to hold an article is a wrapper and marks nothing.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[_Element] = []
    wrappers: set[int] = set()
    hidden = articles = anchors = number = 0

    def end() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            holder = next((e.number for e in reversed(stack) if e.name in HOLDERS), 0)
            lines.append(Line(text, linked, articles > 0, tuple(e.number for e in stack if e.marked), holder))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        """Closes the stack's elements from index to on."""
        nonlocal hidden, articles, anchors
        for e in stack[to:]:
            hidden -= e.left_out
            articles -= e.article
            anchors -= e.name == "a"
        del stack[to:]

    def nearest(names: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in fence:
                break
        return -1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            piece = page[at:stop]
            parts.append(piece)
            if anchors:
                linked += len(" ".join(piece.split()))
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not closing and name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if closing:
            fence = frozenset() if name in ("article", "main", "body", "html") else frozenset(["article", "main", "table"] if name != "table" else ["article", "main"])
            i = nearest({name}, fence)
            if name in BLOCKS:
                end()
            if i >= 0:
                pop(i)
            continue
        if name in BLOCKS:
            end()
            i = nearest({"p"}, {"button", "td", "th", "table", "article", "main"}) if name not in ("br", "option") else -1
            if i >= 0:
                pop(i)
        if name in IMPLIED:
            names, fence = IMPLIED[name]
            i = nearest(names, fence)
            while i >= 0:
                pop(i)
                i = nearest(names, fence)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        number += 1
        marked, place = _marks(name, attributes)
        inline = name not in BLOCKS
        article = name in ("article", "main") and not marked
        left_out = name in OUTSIDE or name == "header" and not articles or marked and inline  # a line goes on after an inline element
        if article:
            wrappers.update(e.number for e in stack if e.marked and e.place)
        if left_out and not inline:
            lines.append(Line("", 0, False, (), 0))
        stack.append(_Element(number, name, left_out, marked and not inline, place, article))
        hidden += left_out
        articles += article
        anchors += name == "a"
    end()
    return [x._replace(marked=tuple(i for i in x.marked if i not in wrappers)) for x in lines]


def weights(lines: list[Line]) -> np.ndarray:
    """The text length that each line brings to the distribution.

    Marked lines bring none. Where the page has an article with text, lines outside bring none either, and a line inside
    brings SURGE on top, so that short ones count. Without one, a line that is mostly links brings none.
    """
    plain = [not x.marked for x in lines]
    if any(x.inside and x.text and ok for x, ok in zip(lines, plain)):
        return np.array([(len(x.text) + SURGE) * bool(x.text and x.inside and ok) for x, ok in zip(lines, plain)], np.int64)
    own = [max(0, len(x.text) - x.linked) for x in lines]
    return np.array([n * (ok and n >= len(x.text) / 3) for x, ok, n in zip(lines, plain, own)], np.int64)


def main_text(page: str) -> str:
    """The main text's lines joined by newlines: line weights are summed over WINDOW lines.

    The text surges where a sum reaches SURGE and dives where the weights fall to nothing; all lines between are kept, and
    with them other weighty lines that the same element holds, as a heading before an advert. A page that never surges
    keeps its longest run of lines.
    """
    lines = lines_of(page)
    size = weights(lines)
    if not size.any():
        return ""
    sums = np.convolve(size, np.ones(WINDOW, np.int64))[: len(size)]
    edges = np.flatnonzero(np.diff((size > 0).astype(np.int8), prepend=0, append=0))
    runs = list(zip(edges[0::2].tolist(), edges[1::2].tolist()))
    surged = [(a, b) for a, b in runs if sums[a:b].max() >= SURGE] or [max(runs, key=lambda r: int(size[r[0] : r[1]].sum()))]
    kept = {i for a, b in surged for i in range(a, b)}
    holders = {lines[i].holder for i in kept}
    return "\n".join(x.text for i, x in enumerate(lines) if i in kept or size[i] and x.holder in holders)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns but html_col + out_col STRING: each page's main text.

    A null, empty or text-free page gives an empty text. Very long pages are read whole, a few rows at a time. Rows are
    independent, so ties and repeated rows change nothing; an input column named out_col is replaced. An empty table gives
    an empty result. No shuffle.
    """
    rows = small_batches(pages).select(boxed(pages, html_col), text_or_empty(html_col).alias("_html"))
    schema = StructType([rows.schema[BOX], StructField("_got", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                got = pa.array([main_text(x) for x in part.column("_html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(BOX), got], schema.names)

    return unboxed(rows.mapInArrow(run, schema), pages, {out_col: F.col("_got")}, html_col)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
