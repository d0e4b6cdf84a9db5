"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text.  A line weighs as many characters as it has outside
links; lines of menus, adverts, forms and the like weigh nothing.  Weights are summed over windows of ``WIDTH`` lines,
within and outside of article and main elements apart; within them they count ``MARKED`` times.  The text surges where
a window's sum rises above nothing, dives where it falls back.  Where the densest window lies in such an element, all
stretches in these elements are kept, and others that are as dense as it is without the factor.  Where it lies outside, the
text from the first to the last stretch whose densest window holds ``DENSE`` characters, or the densest there is, is kept.

Pages are read from left to right once, so broken markup takes no longer than whole markup of its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3
DENSE = 120
#: How many times text in an article or main element counts.
MARKED = 3
_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "math", "title")
_ASIDE = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ITEMS = frozenset(("p", "li", "dt", "dd", "tr", "td", "th"))
_OUTER = frozenset(("article", "main"))
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
# words in a class, an id or a role that mark what isn't the article
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|widget\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|"
    r"header|masthead|footer|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|social|share|sharing|"
    r"related|recommended|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|toolbar|skip-link|complementary|contentinfo|dialog)"
    r"(?:$|[\s_-])", re.I,
)


def _marked(attributes: str) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    return bool(_HIDDEN.search(attributes)) or any(_MARKS.search(" ".join(m.groups(""))) for m in _ATTRIBUTE.finditer(attributes))


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag whose attributes begin at ``at``; there must be one.

    A ``>`` between two equal quotes belongs to a value, unless no other one follows.
    """
    place = at
    while found := _STOP.search(page, place):
        if found[0] == ">":
            return found.start()
        place = page.find(found[0], found.end()) + 1 or found.end()
    return page.find(">", at)


def line_blocks(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The non-empty lines of a page, the weight of each, and which lie in a marked article.

    There a line of links weighs 1, so that it is kept and doesn't make a stretch dense.  A link ends with its
    element, at the next link, at the end of a block and at a new paragraph or item.
    """
    lines: list[str] = []
    weights: list[int] = []
    inside: list[bool] = []
    parts: list[str] = []
    linked = 0
    links = outer = 0
    aside: list[str] = []  # the open element that is left out and those of the same name within it
    at = 0
    lowered = page.lower()
    if len(lowered) != len(page):
        lowered = page
    last = page.rfind(">")
    closings: dict[str, int] = {}

    def closes(name: str, after: int) -> bool:
        """Whether the element's end tag stands anywhere after a place."""
        if name not in closings:
            closings[name] = lowered.rfind(f"</{name}")
        return closings[name] >= after

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(text)
                plain = max(len(text) - linked, 0) if linked < 0.5 * len(text) else 0
                weights.append(0 if aside else max(plain, int(outer > 0)))
                inside.append(outer > 0)
            parts.clear()
        linked = 0

    while True:
        found = _OPEN.search(page, at)
        if found is None:
            put(page[at:])
            break
        put(page[at : found.start()])
        name = found[2]
        if name is None:
            end = page.find("-->" if found[0] == "<!--" else ">", found.end())
            at = len(page) if end < 0 else end + len("-->" if found[0] == "<!--" else ">")
            continue
        if found.end() > last:  # no tag ends behind this place
            put(found[0])
            at = found.end()
            continue
        end = _tag_end(page, found.end())
        attributes = page[found.end() : end]
        at = end + 1
        name = name.lower()
        closing = bool(found[1])
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                if closes(name, at):
                    end = page.find(">", lowered.find(f"</{name}", at))
                    at = len(page) if end < 0 else end + 1
                elif name != "title":
                    at = len(page)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE and not (aside and name == aside[0]) and (closing or not _marked(attributes)):
            continue
        if name in _INLINE and not aside and not closes(name, at):
            continue
        end_line()
        if name in _VOID:
            continue
        if closing or name in _ITEMS:
            links = 0
        if closing:
            if aside and name == aside[0]:
                aside.pop()
            elif aside and name in ("body", "article", "main"):
                aside.clear()  # what was left open ends with its parent
            if name in _OUTER:
                outer = max(0, outer - 1)
        elif aside:
            if name == aside[0]:
                aside.append(name)
            elif name in _OUTER and aside[0] in ("nav", "head", "header"):
                aside.clear()  # an article never stands in these: they were left open
                outer += 1
        elif name in _ASIDE or (name == "header" and not outer) or (name not in ("html", "body", "main") and _marked(attributes)):
            if not attributes.endswith("/"):
                aside.append(name)
        elif name in _OUTER:
            outer += 1
    end_line()
    return lines, np.array(weights, np.int64), np.array(inside, bool)


def main_text(page: str | None) -> str:
    """The kept lines joined by single spaces; empty for null, empty or textless pages."""
    if not page:
        return ""
    lines, weights, inside = line_blocks(page)
    if not weights.any():
        return ""
    stretches = []  # densest window, whether it lies in a marked element, and the lines
    borders = [0, *(np.flatnonzero(np.diff(inside)) + 1), len(lines)]
    for start, stop in zip(borders[:-1], borders[1:]):
        total = np.concatenate([[0], np.cumsum(weights[start:stop])])
        windows = total[np.minimum(np.arange(stop - start) + WIDTH, stop - start)] - total[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], windows > 0, [False]]).astype(int)))
        stretches += [(int(windows[a:b].max()), bool(inside[start]), range(start + a, start + b)) for a, b in zip(edge[::2], edge[1::2])]
    marked = max((dense for dense, tag, _ in stretches if tag), default=0)
    plain = max((dense for dense, tag, _ in stretches if not tag), default=0)
    if marked * MARKED >= plain:
        kept = [rows for dense, tag, rows in stretches if tag or dense >= marked]
    else:
        enough = min(DENSE, plain)
        good = [k for k, (dense, tag, _) in enumerate(stretches) if dense * (MARKED if tag else 1) >= enough]
        kept = [rows for _, _, rows in stretches[good[0] : good[-1] + 1]]
    return " ".join(lines[k] for rows in kept for k in rows if weights[k] > 0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; others are ignored).

    Null and empty pages have empty text; unclosed elements end with their parent or the page; repeated rows give
    equal results; an empty table gives an empty table.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
