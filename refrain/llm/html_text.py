"""Operator 7, main text of web pages.

The standard library's streaming parser turns a page into lines: the text between two block
tags, with the number of tags on the way. A line's text-to-tag ratio, smoothed by a Gaussian,
is compared with the page's threshold; runs of lines above it are the content regions. The
regions say which element of the page is the article: an article or main element, else the innermost
one with all of the regions, and the headings just before it. Its whole text is then returned, short lines
too, without the parts that are not reading matter by their tag, role or class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.scratch import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Not reading matter, whatever is in it.
SKIP = frozenset(
    "head title script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video dialog menu map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A word of a class or id that marks such a part.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidebars menu menus
    nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar cookie cookies consent gdpr notice notices newsletter subscribe
    subscription signup login popup modal overlay share sharing social related recommended comment comments reply replies respond disqus
    widget widgets pagination pager paging toolbar disclaimer skip copyright paywall""".split()
)
#: Words that a class or id may hold beside hints and still name such a part: comment-list, but not share-prices.
FURNITURE = frozenset(
    """container wrapper wrap box list bar area block section panel holder inner outer body header title row col column grid item items link links button
    buttons btn icon icons group slot unit top bottom left right side js module content form posts post articles article stories news count site page main
    global primary secondary tertiary fixed sticky thread text message info more small large mobile desktop zone region card cards tag tags a x""".split()
)
#: A hint word after or before one of these tells of the layout: has-sidebar, comments-open.
QUALIFIERS, STATES = frozenset("has no not with without is".split()), frozenset("open closed enabled disabled on off".split())
#: Characters of a paragraph.
PARAGRAPH = 140
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Never a page's article by themselves; a cell is one when it holds other blocks.
TEXT = HEADINGS | frozenset("p pre blockquote li dt dd ul ol dl tr tbody thead tfoot table caption figure figcaption address summary".split())
CELLS = frozenset(["td", "th"])


def marked(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether role, hidden or aria-hidden says that a part is not reading matter."""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value and value.lower() in ROLES:
            return True
    return False


def hinted(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id is made of hint words, with others only that say nothing of the content.

    In a form that tells of the layout a hint says nothing.
    """
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = [x.lower() for x in PIECES.findall(token)]
                known = [w in HINTS for w in words]
                if not any(known) or not all(k or w in FURNITURE or w.isdigit() for k, w in zip(known, words, strict=True)):
                    continue
                for k, word in enumerate(words):
                    if word in HINTS and QUALIFIERS.isdisjoint(words[:k]) and STATES.isdisjoint(words[k + 1 : k + 2]):
                        return True
    return False


class Lines(HTMLParser):
    """lines: [text pieces, tags, element, skipped]; parent: each element's; kind: its tag; hint: whether its class or id is a hint."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.hint = [-1], ["#root"], [False]
        self.open: list[tuple[str, int, bool]] = [("#root", 0, False)]
        self.lines: list[list] = [[[], 0, 0, False]]

    def line(self) -> None:
        _, element, skipped = self.open[-1]
        last = self.lines[-1]
        if last[0]:
            self.lines.append([[], 0, element, skipped])
        else:
            last[2:] = element, skipped

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1][1] += 1
        if tag in VOID:
            if tag == "br":
                self.lines[-1][0].append(" ")
            elif tag == "hr":
                self.line()
            return
        hint = bool(attrs) and tag not in ("html", "body", *CONTENT) and hinted(attrs)
        if tag in INLINE and not hint and not (attrs and marked(attrs)):
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            self.leave(tag, implied=True)
        skipped = self.open[-1][2] or tag in SKIP or (bool(attrs) and tag not in ("html", "body") and marked(attrs))
        if tag == "header" and not any(t in CONTENT for t, _, _ in self.open):
            skipped = True
        self.parent.append(self.open[-1][1])
        self.kind.append(tag)
        self.hint.append(hint)
        self.open.append((tag, len(self.kind) - 1, skipped))
        self.line()

    def leave(self, tag: str, implied: bool = False) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                self.line()
                return
            if implied and self.open[k][0] in ("ul", "ol", "dl", "table", "div", "article", "main", "section", "body", "nav", "footer", "aside", "form", "blockquote"):
                return

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        self.leave(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_data(self, data: str) -> None:
        self.lines[-1][0].append(data)


def smoothed(ratio: np.ndarray, radius: int = 2) -> np.ndarray:
    weights = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * 1.0))
    padded = np.pad(ratio, radius)
    return np.convolve(padded, weights, "valid") / np.convolve(np.pad(np.ones(len(ratio)), radius), weights, "valid")


def under_hints(parser: Lines, found: list[tuple]) -> list[bool]:
    """For each element whether its class or id, or that of one around it, keeps it out.

    One with most of the page's text is no such part where no article or main element stands free of them,
    or inside one that has no paragraph besides.
    """
    count = len(parser.kind)
    under, article, total = list(parser.hint), [k in CONTENT for k in parser.kind], [0] * count
    for e in range(1, count):
        under[e] = under[e] or under[parser.parent[e]]
        article[e] = article[e] or article[parser.parent[e]]
    if sum(len(text) for text, _, e, skipped in found if article[e] and not under[e] and not skipped) >= PARAGRAPH:
        return under
    free = any(k in CONTENT and not u for k, u in zip(parser.kind, under, strict=True))
    for text, _, e, skipped in found:
        total[e] += 0 if skipped else len(text)
    for e in range(count - 1, 0, -1):
        total[parser.parent[e]] += total[e]
    under = [hint and (total[e] * 2 <= total[0] or (free and not article[e])) for e, hint in enumerate(parser.hint)]
    for e in range(1, count):
        under[e] = under[e] or under[parser.parent[e]]
    return under


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    found = []
    for pieces, tags, element, skipped in parser.lines:
        text = " ".join("".join(pieces).split())
        if text:
            found.append((text, tags, element, skipped))
    if any(parser.hint):
        under = under_hints(parser, found)
        found = [(text, tags, e, skipped or under[e]) for text, tags, e, skipped in found]
    if not found or all(f[3] for f in found):
        return ""
    ratio = np.array([0.0 if skipped else len(text) / (tags + 1) for text, tags, _, skipped in found])
    level = smoothed(ratio)
    content = (level >= level.std()) & (ratio > 0)
    if not content.any():
        content = ratio > 0
    # An element's number is larger than its parent's, so that one pass up or down the numbers is enough.
    count = len(parser.kind)
    size, depth = [0] * count, [0] * count
    for (text, _, element, _), good in zip(found, content, strict=True):
        size[element] += len(text) if good else 0
    for e in range(count - 1, 0, -1):
        size[parser.parent[e]] += size[e]
    outer = [-1] * count  # the outermost article or main element that it is in
    for e in range(1, count):
        depth[e] = depth[parser.parent[e]] + 1
        outer[e] = outer[parser.parent[e]]
        if outer[e] < 0 and size[e] and parser.kind[e] in CONTENT:
            outer[e] = e
    roots = {e for e in outer if e >= 0}
    whole = sum(size[e] for e in roots) * 2 < size[0] or not roots
    if whole:
        # No article element: the innermost one that holds all of the regions and is more than a block of text.
        root = max((e for e in range(count) if size[e] == size[0]), key=depth.__getitem__)
        holds = set(parser.parent)
        while parser.kind[root] in TEXT or (parser.kind[root] in CELLS and root not in holds):
            root = parser.parent[root]
        roots = {root}
    inside = [e in roots for e in range(count)]
    for e in range(1, count):
        inside[e] = inside[e] or inside[parser.parent[e]]
    kept = [line for line in found if not line[3]]
    first = next((i for i, line in enumerate(kept) if inside[line[2]]), 0)
    while whole and first and parser.kind[kept[first - 1][2]] in HEADINGS:
        first -= 1
        inside[kept[first][2]] = True
    return "\n".join(t for t, _, e, _ in kept if inside[e])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Null html is an empty page. A page of any length or depth is read whole. Repeated rows give repeated results; other columns are not read;
    an empty table gives no rows. Broken markup is read as far as it goes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.iloc[at : at + 500]
                texts = [main_text(h or "") for h in rows["html"]]
                out = pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))})
                yield out.astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
