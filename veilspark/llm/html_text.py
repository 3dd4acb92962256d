"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block. A line weighs its text's length: nothing if it is mostly links, WEIGHT times in an article, a FAINT share in a part whose name hints at
furniture. Weights are summed over sliding windows of `width` successive lines of a container (an article or main element, else the innermost div, section or table cell; the page itself).
With the greatest sum of the page as measure, text surges with the first window that holds at least `share` of it and dives after the last line of such a window.

What lies between is kept: of the page itself the lines from its first surge to its last dive, of any other container in which text surges all lines, however short, and between two such
containers with the same parent all lines of the parts in between. Where text does not surge nothing is kept.

Markup that leaves no doubt does not enter the sums: elements such as nav, footer or form, what is hidden, and classes, ids and roles that are names of furniture (ad, comments, sidebar).
They end where HTML ends them: a paragraph at the next block, a list item at the next item, a cell at the next cell. An article inside furniture that is properly closed (reader comments,
related cards) is furniture; one inside furniture that is never closed ends it, as main always does. Only where a page would have no text at all, articles inside closed furniture count.

Defined results: null and empty pages, and pages without text, give an empty text; unclosed tags, comments and scripts end
with the page; plain text is one block; rows and extra columns pass, a column with the output's name is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WIDTH, SHARE, WEIGHT, FAINT = 3, 0.25, 2.0, 0.3
# HTML's element names by role, and words of class, id and role that name furniture or hint at it.
SKIPPED = frozenset("head nav footer aside form menu dialog template noscript iframe object svg canvas button select textarea audio video map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option caption".split())
CONTAINERS = frozenset("div section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related respond rss share sharing sidebar social sponsor sponsored subscribe subscription toolbar complementary contentinfo search".split())
#: Parts of longer names that are as sure: comment-list, site-footer; other words of FURNITURE in a longer name, such as search-results or share-text, are hints.
SURE = frozenset("ad ads advert advertisement adsense breadcrumb breadcrumbs comment comments cookie cookies footer masthead menu nav navbar navigation newsletter pagination sidebar sponsored".split())
CONTENT = frozenset("article body content entry main post review story text".split())
HINTS = (FURNITURE - SURE) | {"widget", "widgets"}
#: What ends an element without its end tag: start tags, and end tags of elements around it.
ENDED_BY = {
    "p": (BLOCKS, BLOCKS),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody tfoot".split()), frozenset("tr tbody tfoot table".split())),
    "th": (frozenset("td th tr tbody tfoot".split()), frozenset("tr tbody tfoot table".split())),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset("tbody tfoot table".split())),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
    "head": (frozenset(["body"]), frozenset()),
}
#: What an element may hold that has such elements of its own.
NESTS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</?[a-z][^>]*>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[a-z]+")
SURELY, PERHAPS = 2, 1


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """SURELY, PERHAPS or 0."""
    if tag in SKIPPED or (tag == "header" and not in_article):
        return SURELY
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    found = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if (name == "hidden" and value.lower() not in ("false", "until-found")) or (name == "aria-hidden" and value.lower() == "true"):
            return SURELY
        if name == "style" and re.search(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I):
            return SURELY
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            parts = set(PART.findall(CAMEL.sub(" ", token).lower()))
            if in_article:
                parts -= {"header", "masthead"}  # an article's own header holds its heading
            if token.lower() in FURNITURE & parts or (parts & SURE and not parts & CONTENT):
                return SURELY
            found = PERHAPS if parts & (HINTS | SURE) else found
    return found


def _closed(page: str) -> set[int]:
    """Where the elements start that are closed, as are all elements of the same name around them."""
    opened: dict[str, list[int]] = {}
    outermost: dict[int, int] = {}
    ended = set()
    for m in TOKEN.finditer(page):
        tag = (m[3] or "").lower()
        if not tag or m[4].endswith("/"):
            continue
        held = opened.setdefault(tag, [])
        if not m[2]:
            held.append(m.start())
            outermost[m.start()] = held[0]
        elif held:
            ended.add(held.pop())
    return {at for at, first in outermost.items() if first in ended}


class Lines:
    """The lines of a page, (text, weight, container), and the parent of each container. Container 0 is the page."""

    def __init__(self, page: str, nested: bool = False) -> None:
        """nested: articles inside closed furniture count too."""
        self.lines: list[tuple[str, float, int]] = []
        self.parent = [0]
        self.held: list[str] = []
        self.links = self.in_link = self.in_article = self.mains = 0
        self.inside: list[tuple[str, int, float]] = []  # tag, container, share that its text weighs
        self._read(page, nested)
        self._close()

    def _close(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            _, at, share = self.inside[-1] if self.inside else ("", 0, 1.0)
            linked = 2 * self.links > len(text)
            weight = len(text) * share * (WEIGHT if self.in_article else 1.0) * (0.0 if linked and not self.in_article else FAINT if linked else 1.0)
            self.lines.append((text, weight, at))
        self.held.clear()
        self.links = 0

    def _take(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.held.append(text)
        if self.in_link:
            self.links += len(text)

    def _open(self, tag: str, share: float) -> None:
        self._close()
        _, at, outer = self.inside[-1] if self.inside else ("", 0, 1.0)
        self.parent.append(at)
        self.inside.append((tag, len(self.parent) - 1, outer * share))

    def _end(self, tag: str) -> None:
        upto = next((i for i in range(len(self.inside) - 1, -1, -1) if self.inside[i][0] == tag), None)
        if upto is not None:
            self._close()
            self.in_article -= sum(t == "article" for t, *_ in self.inside[upto:])
            self.mains -= sum(t == "main" for t, *_ in self.inside[upto:])
            del self.inside[upto:]

    def _read(self, page: str, nested: bool) -> None:
        at = depth = skip_at = 0
        skip, around, closed = "", 0, None
        for m in TOKEN.finditer(page):
            if m.start() > at and not skip:
                self._take(page[at : m.start()])
            at = m.end()
            tag, end = (m[3] or "").lower(), bool(m[2])
            if not tag:
                continue
            if skip:
                starts, ends = ENDED_BY.get(skip, ((), ()))
                if tag == "main" and not end:
                    skip = ""
                elif tag == "article" and not end:
                    if closed is None:
                        closed = set() if nested else _closed(page)
                    if skip_at not in closed:
                        skip = ""  # the furniture was never closed
                elif tag in NESTS.get(skip, ()) and (around or not end):
                    around += -1 if end else 1
                elif around:
                    pass
                elif tag == skip and end:
                    depth -= 1
                    if not depth:
                        skip = ""
                        continue
                elif depth == 1 and tag in (ends if end else starts):
                    skip = ""  # ended by what follows, which is read
                elif tag == skip and not m[4].endswith("/"):
                    depth += 1
                if skip:
                    continue
            if tag == "a":
                self.in_link = 0 if end else 1
            if tag == "br":
                self.held.append(" ")
            if tag in BLOCKS or tag in SKIPPED:
                self._close()
            if end:
                if tag in CONTAINERS or tag in ("article", "main"):
                    self._end(tag)
                continue
            sure = 0 if tag in VOID else _furniture(tag, m[4], self.in_article + self.mains > 0)
            if sure == SURELY:
                if not m[4].endswith("/"):
                    self._close()
                    skip, depth, around, skip_at, self.in_link = tag, 1, 0, m.start(), 0
            elif tag in ("article", "main"):
                self._open(tag, 1.0)
                self.in_article += tag == "article"
                self.mains += tag == "main"
            elif tag in CONTAINERS and (sure or not self.in_article):
                self._open(tag, FAINT if sure else 1.0)
            elif tag in CONTAINERS:  # parts of an article are the article's
                self._close()
                self.inside.append((tag, self.inside[-1][1], self.inside[-1][2]))
        if at < len(page) and not skip:
            self._take(page[at:])


def surges(weights: list[float], least: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Half-open spans of the lines that windows of `width` successive lines with a sum of at least `least` cover: each from a surge to a dive."""
    out: list[tuple[int, int]] = []
    total = 0.0
    for i, w in enumerate(weights):
        total = total + w - (weights[i - width] if i >= width else 0.0)
        if total >= least and total > 0:
            a = max(0, i - width + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def _kept(page: Lines, width: int, share: float) -> list[str]:
    of: dict[int, list[int]] = {}
    for i, (_, _, c) in enumerate(page.lines):
        of.setdefault(c, []).append(i)
    weights = {c: [page.lines[i][1] for i in at] for c, at in of.items()}
    most = max((sum(w[max(0, i - width + 1) : i + 1]) for w in weights.values() for i in range(len(w))), default=0.0)
    if not most:
        return []
    found = {c: spans for c, w in weights.items() if (spans := surges(w, share * most - 1e-9, width))}
    stay: set[int] = set()
    for c, spans in found.items():
        at = of[c]
        stay.update(at if c else at[spans[0][0] : spans[-1][1]])
    beside: dict[int, list[int]] = {}
    for c in found:
        if c:
            beside.setdefault(page.parent[c], []).append(c)
    for parent, some in beside.items():
        if len(some) > 1:  # between containers with the same parent
            first, last = min(of[c][0] for c in some), max(of[c][-1] for c in some)
            for i in range(first, last):
                c, faint = page.lines[i][2], page.lines[i][1] == 0
                while c and c != parent:
                    c = page.parent[c]
                if c == parent and not faint:
                    stay.add(i)
    return [page.lines[i][0] for i in sorted(stay)]


def main_text(page: str | None, width: int = WIDTH, share: float = SHARE) -> str:
    if not page:
        return ""
    return "\n".join(_kept(Lines(page), width, share) or _kept(Lines(page, nested=True), width, share))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", width: int = WIDTH, share: float = SHARE) -> DataFrame:
    @pandas_udf(StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x, width, share) for x in s], dtype=object)

    return pages.withColumn(out_col, text(F.col(html_col)))
