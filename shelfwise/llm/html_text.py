"""Main text of HTML pages by the distribution of text over their lines.

A page is stripped of its markup: what a browser sets on a line of its own becomes a line, and what is no text of an
article by its kind (scripts, menus, forms, adverts, notices, comments of readers) goes. The lengths of the
remaining lines are summed over a sliding window. Text begins where the sums surge, ends where they dive to nothing, and
all between is kept. Links count for nothing, so lists of links make no surge.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines whose lengths are summed.
WINDOW = 3
#: Characters in a window that make a surge, or this share of the page's fullest window if that is less.
SURGE, SHARE = 80, 0.25

# A tag, with quoted values that may hold anything; a stray "<" before a letter ends at the next angle bracket.
_MARKUP = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|(?P<name>/?[a-zA-Z][^\s/<>"']*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|[a-zA-Z/!?][^<>]*>?)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: What stands between links of a list.
_APART = " \t\r\n|/,;:.·•-–—<>«»‹›"
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements whose content is no markup, elements without content, elements that stay in a line,
# elements that hold others, and those of them that never hold an article's text.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math",
       "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
HOLDERS = {"address", "article", "aside", "blockquote", "body", "button", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
           "figure", "footer", "form", "header", "html", "main", "menu", "nav", "ol", "section", "select", "span", "table", "ul"}
NEVER = {"aside", "button", "dialog", "footer", "form", "header", "menu", "nav", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Fixed words of class, id and role that name what is not the article, and what is.
SIDE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
        "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr",
        "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
        "notification", "outbrain", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended",
        "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
        "subscribe", "taboola", "teaser", "toolbar", "widget", "widgets"}
NOT_ITSELF = {"has", "with", "no", "without", "wrapper", "page"}
MAIN = {"article", "articlebody", "main", "post", "story", "entry"}
MAIN_PARTS = {"content", "body", "text"}


@dataclass(slots=True)
class Line:
    text: str
    weight: int
    region: int  # lines of different regions are far from each other
    main: bool


def _kind(name: str, rest: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is beside the article, and whether it holds it."""
    side, main = name in NEVER, name in ("article", "main")
    if not rest:
        return side, main
    for attribute, value in _NAMED.findall(rest):
        attribute, value = attribute.lower(), value.strip("\"'")
        if attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
            side = True
        elif attribute == "style":
            side |= "display:none" in value.replace(" ", "").lower()
        else:
            words = {w.lower() for w in _WORDS.findall(value)}
            if words & SIDE:
                side |= not words & NOT_ITSELF
            elif words & MAIN and (len(words) == 1 or words & MAIN_PARTS) or attribute == "itemprop" and "body" in words:
                main = True
    if name in ("html", "body"):  # classes of these name the page, not a part of it
        return False, False
    return side, main and not side


def lines_of(page: str) -> list[Line]:
    """The page's lines of text in order, without those beside the article by their kind."""
    lines: list[Line] = []
    open_: list[tuple[str, bool, bool, int]] = []  # name, beside the article, in its holder, region
    named: Counter[str] = Counter()
    buffer: list[str] = []
    region = regions = weight = 0
    in_link = side = main = heading = skipped = False

    def end_line() -> None:
        nonlocal weight
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                lines.append(Line(text, min(weight, len(text)), region, main))
            buffer.clear()
        weight = 0

    def add(piece: str) -> None:
        nonlocal weight
        if piece and not skipped and (not side or heading and main):
            buffer.append(piece)
            if not in_link:
                weight += len(piece.strip(_APART))

    at = 0
    while True:
        match = _MARKUP.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at:match.start()])
        at = match.end()
        name = match["name"]
        if not name:
            continue
        closing, name = name[0] == "/", name.lstrip("/").lower()
        if name == "a":
            in_link = not closing
        if name not in INLINE:
            end_line()
            in_link = skipped = False
        if closing:
            if name in HEADINGS:
                heading = False
            if named[name]:
                gone = None
                while gone != name:
                    gone = open_.pop()[0]
                    named[gone] -= 1
                side, main, region = open_[-1][1:] if open_ else (False, False, 0)
        elif name in RAW:
            if not match["rest"].endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = len(page) if end is None else end.start()
        elif name in HEADINGS:
            heading = True
        elif name in HOLDERS:
            beside, holds = _kind(name, match["rest"], main)
            if name != "span" or beside:
                if beside and not side or holds and not main:
                    regions += 1
                    region = regions
                named[name] += 1
                open_.append((name, side or beside, main or holds, region))
                side, main, region = open_[-1][1:]
        elif match["rest"] and name not in VOID and name not in INLINE:
            skipped = _kind(name, match["rest"], main)[0]
    end_line()
    return lines


def surges(weight: np.ndarray, enough: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and a dive of the window sums of ``weight``.

    A stretch of sums above nothing counts if one of them is ``enough`` or ``SHARE`` of the greatest; lines without length at its
    ends fall off.
    """
    n = len(weight)
    if not n:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(weight)])
    sums = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    surge = min(enough, SHARE * sums.max())
    keep, start = np.zeros(n, bool), None
    for i in np.flatnonzero(np.diff(np.concatenate([[False], sums > 0, [False]]).astype(np.int8))):
        if start is None:
            start = i
        else:  # the sums have dived to nothing at i
            if sums[start:i].max() >= surge:
                text = start + np.flatnonzero(weight[start:i])
                keep[text[0]:text[-1] + 1] = True
            start = None
    return keep


def main_text(page: str | None) -> str:
    """The article of a page: its lines between surge and dive, joined by a blank.

    Regions are set apart by empty lines, a window's number, so that no sum reaches from one into the next. Where an
    element is marked as the article, the lines beside it have no length and its own have all theirs, links too; then any
    text is a surge.
    """
    lines = lines_of(page or "")
    marked = any(line.main for line in lines)
    places, weights, before = [], [], None
    for line in lines:
        region = line.main if marked else line.region
        if before is not None and region != before:
            weights += [0] * WINDOW
        before = region
        places.append(len(weights))
        weights.append((len(line.text) if line.main else 0) if marked else line.weight)
    keep = surges(np.array(weights, np.int64), 1 if marked else SURGE)
    return " ".join(line.text for line, place in zip(lines, places, strict=True) if keep[place])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page; other columns are not read.

    A NULL or empty page, and one without text, has an empty text. Pages may be of any length; they are read once from start
    to end. Repeated rows are rows of their own, an empty table gives no rows, ``page_id`` and ``url`` pass unchanged.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")
