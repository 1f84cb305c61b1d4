"""HTML extraction by line-block distribution.

Markup is stripped into lines (the blocks of the page). Each line has a weight, and tags only set weights: a line's
text length up to ``LONGEST``, 0 where it can't be main text (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, lines of links), and if the page marks its article (or main part), the most a line can weigh
inside it and 0 outside. Weights are summed over sliding windows of lines. Main text begins where the sums surge for
the first time and ends where they dive for the last time; every line of non-zero weight between the two points stays.

Defined results: a null or empty page has the empty text; a page without main text too; null ids stay; repeated rows
are extracted one by one; an empty table gives an empty result; other columns are left out, whatever their names. Very
long pages are read whole in linear time, unclosed tags and quotes included. Of equal sums the outermost count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed at a time, and the most that a line weighs.
SPAN, LONGEST = 3, 400
#: Share of the highest sum from which sums have surged, and share of link text from which a line weighs nothing.
SURGE, LINKED = 0.2, 0.5

# Whatever a tag scans it also takes, so that no page needs more than linear time: an unclosed tag ends before the next one.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|object|math|canvas)\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset("head nav footer aside form menu dialog button title".split())
_ROLE = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|dialog|alert|form)\b", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Parts of a class or id that mark what isn't main text.
_UNWANTED = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related respond "
    "share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets".split()
)


def _unwanted(name: str, attrs: str, inside: bool) -> bool:
    if name in _NEVER or (name == "header" and not inside):
        return True
    if not attrs:
        return False
    if _ROLE.search(attrs) or _HIDDEN.search(attrs):
        return True
    if name in ("body", "html", "article", "main") and not re.search(r"comment", attrs, re.I):
        return False
    return any(part in _UNWANTED for m in _NAMED.finditer(attrs) for part in re.split(r"[^a-z]+", m[1].lower()))


class _Page:
    """Lines of a page: (text, length of link text, wanted, in an article, in a main part, heading)."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, bool, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False
        skip: list[str] = []  # open elements from the outermost unwanted one on, of its name
        article = main = link = 0
        mains: list[tuple[str, int]] = []
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()], bool(link))
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                if m[1] and m[1].lower() not in ("svg", "math"):
                    self.parts.append(" ")
                continue
            ends, attrs = bool(m[2]), m[4]
            if name == "a":
                link = 0 if ends else 1
            if name not in _INLINE:
                self._line(not skip, article > 0, main > 0)
                self.heading = name in _HEADING and not ends
            if skip:
                if name == skip[0] and not (attrs.endswith("/") or name in _VOID):
                    skip.pop() if ends else skip.append(name)
                elif name == "body" and skip[0] == "head":
                    skip.clear()
                if name in _INLINE and not skip:
                    self._line(False, article > 0, main > 0)
                continue
            if ends:
                article -= name == "article" and article > 0
                if mains and mains[-1][0] == name:
                    depth = mains[-1][1] - 1
                    mains[-1:] = [(name, depth)] if depth else []
                    main = len(mains)
                continue
            if name in _VOID or attrs.endswith("/"):
                continue
            if _unwanted(name, attrs, article > 0 or main > 0):
                self._line(True, article > 0, main > 0)
                skip.append(name)
            else:
                article += name == "article"
                if mains and mains[-1][0] == name:
                    mains[-1] = (name, mains[-1][1] + 1)
                elif name == "main" or _MAIN.search(attrs):
                    mains.append((name, 1))
                main = len(mains)
        if at < len(source):
            self._text(source[at:], bool(link))
        self._line(not skip, article > 0, main > 0)

    def _text(self, raw: str, link: bool) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if link:
            self.linked += len(text)

    def _line(self, wanted: bool, article: bool, main: bool) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.linked, wanted, article, main, self.heading))
            self.parts, self.linked = [], 0


def main_part(weights: list[float]) -> tuple[int, int]:
    """From the line where window sums surge first to the one where they dive last, end exclusive.

    At either end of the outermost window whose sum has surged, lines below that sum's share of one line don't count."""
    sums = [sum(weights[i : i + SPAN]) for i in range(max(1, len(weights) - SPAN + 1))]
    least = SURGE * max(sums)
    if not least:
        return 0, 0
    high = [i for i, total in enumerate(sums) if total >= least]
    start = next(i for i in range(high[0], len(weights)) if weights[i] >= least / SPAN)
    end = next(i for i in range(min(high[-1] + SPAN, len(weights)), 0, -1) if weights[i - 1] >= least / SPAN)
    return start, end


def line_weights(page: _Page) -> list[float]:
    """What each line of a page weighs."""
    lines = page.lines
    marked = 3 if any(x[2] and x[3] for x in lines) else 4 if any(x[2] and x[4] for x in lines) else 0

    def weight(line: tuple[str, int, bool, bool, bool, bool]) -> float:
        text, linked, wanted, _, _, heading = line
        if not wanted or (marked and not line[marked]):
            return 0
        if marked:
            return LONGEST
        if linked >= LINKED * len(text):
            return 0
        # a heading is at least as much as an edge of main text has to be
        return max(min(len(text), LONGEST), SURGE * LONGEST if heading else 0)

    return [weight(x) for x in lines]


def main_text(source: str | None) -> str:
    """The main text of a page; blocks are joined by one space."""
    if not source:
        return ""
    page = _Page(source)
    weights = line_weights(page)
    start, end = main_part(weights)
    return " ".join(page.lines[i][0] for i in range(start, end) if weights[i])


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text and n_chars."""
    source = pages.select(*keep, F.col(page).alias("__html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in batch.pop("__html")]
            yield batch.assign(text=text, n_chars=[len(t) for t in text])

    # ids travel as text: pandas would turn a nullable integer into a float
    texts = source.withColumns({k: F.col(k).cast("string") for k in keep})
    out = texts.mapInPandas(run, ", ".join(f"`{k}` string" for k in keep) + ", text string, n_chars long")
    return out.select(*(F.col(k).cast(source.schema[k].dataType) for k in keep), "text", "n_chars")
