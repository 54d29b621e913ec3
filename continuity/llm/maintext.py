"""Main text of web pages by composite text density.

A page is read into a tree. For every node, with the characters C and tags T below it, and the
characters LC and tags LT below it that are in links, the composite text density is

    (C / T) * log base ln(C / NC * LC + LCb / Cb * C + e) of (C / LC * T / LT)

where NC = C - LC, Cb and LCb are those of the body, and a zero divisor counts as one: characters
per tag, cut down where links prevail. The density sum of a node adds up its children's
densities; marks within a text (``b``, ``span``, ...) are no children, a paragraph that is bold as a
whole is no container. The node with the largest sum holds the main text; the least density on the path
from it to the body is the threshold, and every node that reaches it contributes the subtree of
the largest sum below it. Where such a subtree lies in an ``article`` or ``main`` element, that
whole element is taken, so that headings and short paragraphs stay; of ``article`` elements side
by side all are taken that are not mostly links.

Elements that are not text of the page (scripts, styles, forms) and page furniture (menus,
headers, footers, sidebars, notices, adverts, reader comments, by element, role, class or id)
are left out before densities are taken, unless they hold the article themselves: a class or id
word drops no element with more than half of the text, and a form that holds an ``article`` or
``main``, or most of the text in paragraphs, is read. Of a header inside an article the headings
stay.

Blocks are what block-level elements separate; character references are decoded, white space
within a block becomes one space, blocks are joined by one line feed.

Defined cases: a null or empty page, or one without text, gives the empty string. Unclosed and
misnested tags are closed where HTML closes them. Rows are independent of each other.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column

# Fixed values of HTML: elements without content, with raw content, and of block level.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul "
    "caption".split()
)
# Marks within a text; they are no parts of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that close an open element of these names, up to one of the names behind the bar.
CLOSES = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
    "option": ("option", "select datalist optgroup"),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# Not text of the page.
NEVER = frozenset(
    "head script style noscript template textarea select button input form svg math canvas "
    "object iframe audio video map datalist dialog noembed noframes xmp title".split()
)
# Of these, elements that may hold the page: some sites put all of it into one form.
HOLDERS = frozenset("form dialog object".split())
FURNITURE = frozenset("nav footer aside menu search".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form".split()
)
# Words of class and id names.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor "
    "sponsored promo promotion promoted menu nav navbar navigation topnav subnav breadcrumb "
    "breadcrumbs footer header masthead topbar sidebar rail widget widgets cookie cookies consent "
    "gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription "
    "signup signin login register paywall share sharing social related recommended "
    "recommendations pagination pager toolbar skip search copyright".split()
)
READER_WORDS = frozenset(
    "comment comments commentlist disqus discussion replies reply respond".split()
)
MAIN = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
# One attribute after the other, so that names and values inside of others are not taken for some.
_ATTRIBUTE = re.compile(
    r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?|\"[^\"]*\"?|'[^']*'?"
)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Page:
    """The tree of a page: parallel lists by node, parents before children; and its text."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#"]
        self.parent: list[int] = [0]
        self.attributes: list[str] = [""]
        # (node, block, text) in page order.
        self.text: list[tuple[int, int, str]] = []
        self._open: list[int] = [0]
        self._names: dict[str, int] = {}
        self._block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if not found:
                self._say(source[at:])
                break
            self._say(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._end(name)
                continue
            self._start(name, found[3] or found[6] or "")
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                self._end(name)

    def _say(self, text: str) -> None:
        if text and not text.isspace():
            self.text.append((self._open[-1], self._block, text))
        elif text and self.text:
            self.text.append((self._open[-1], self._block, " "))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._block += 1
            self._close_until(frozenset(["p"]), frozenset())
        if name in _CLOSES:
            self._close_until(*_CLOSES[name])
        if name in ("html", "body", "head") and self._names.get(name):
            return
        if name == "body" and self._names.get("head"):
            self._end("head")
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.attributes.append(attributes)
        if name in VOID:
            if name == "br":
                self._say(" ")
            return
        self._open.append(len(self.tag) - 1)
        self._names[name] = self._names.get(name, 0) + 1

    def _close_until(self, names: frozenset, limit: frozenset) -> None:
        """Close the outermost open element of ``names`` that lies within the innermost of
        ``limit`` (for p: within the innermost block)."""
        if not any(self._names.get(n) for n in names):
            return
        found = 0
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                found = depth
            elif tag in limit or (not limit and tag in BLOCK):
                break
        if found:
            self._pop(found)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._block += 1
        if not self._names.get(name) or name in VOID:
            return
        depth = len(self._open) - 1
        while self.tag[self._open[depth]] != name:
            depth -= 1
        self._pop(depth)

    def _pop(self, depth: int) -> None:
        for node in self._open[depth:]:
            self._names[self.tag[node]] -= 1
        del self._open[depth:]


def _is_furniture(tag: str, attributes: str, most: bool = False) -> bool:
    """``most``: the element holds most of the page's text, so that a word like ``sidebar`` in
    its class tells of a part of it, not of all of it."""
    if tag in FURNITURE or tag == "header":
        return True
    if not attributes:
        return False
    words = READER_WORDS if most else FURNITURE_WORDS | READER_WORDS
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = html.unescape(value.strip("\"'"))
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name in ("class", "id") and any(
            part.lower() in words
            for word in value.split()
            for part in (word, *_NAME_PART.findall(word))
        ):
            return True
    return False


def _left_out(page: Page) -> list[bool]:
    """Which nodes are furniture or lie in it."""
    n = len(page.tag)
    plain = [0] * n
    for node, _, text in page.text:
        plain[node] += len(text.strip())
    holds_text = [False] * n
    for node in range(n - 1, 0, -1):
        tag = page.tag[node]
        if (tag not in NEVER or tag in HOLDERS) and tag != "a":
            plain[page.parent[node]] += plain[node]
            if holds_text[node] or (tag == "p" and plain[node]):
                holds_text[page.parent[node]] = True
    most = [2 * size > plain[0] for size in plain]
    holds_main = [False] * n
    for node in range(n - 1, 0, -1):
        tag = page.tag[node]
        main = tag in MAIN and not _is_furniture(tag, page.attributes[node], most[node])
        if main or holds_main[node]:
            holds_main[page.parent[node]] = True
    out, in_main = [False] * n, [False] * n
    header = [False] * n
    for node in range(1, n):
        up, tag = page.parent[node], page.tag[node]
        in_main[node] = in_main[up] or tag in MAIN
        header[node] = header[up]
        holder = tag in HOLDERS and (holds_main[node] or (most[node] and holds_text[node]))
        if tag in NEVER and not holder:
            out[node] = True
        elif header[up] and tag in HEADINGS:
            # A heading in the header of an article.
            header[node] = False
        elif out[up] and not header[up]:
            out[node] = True
        elif tag in ("html", "body") or holds_main[node]:
            out[node] = False
        elif tag == "header" and in_main[up]:
            out[node] = header[node] = True
        else:
            out[node] = out[up] or _is_furniture(tag, page.attributes[node], most[node])
    return out


class Measured:
    """Densities and their sums by node, and the decoded text (node, block, text) they are of."""

    def __init__(self, page: Page, out: list[bool]) -> None:
        n = len(page.tag)
        self.chars, self.links = [0] * n, [0] * n
        self.density, self.total = [0.0] * n, [0.0] * n
        self.decoded: list[tuple[int, int, str]] = []
        self.body = 0
        self._read(page, out)

    def _read(self, page: Page, out: list[bool]) -> None:
        n, chars, links = len(page.tag), self.chars, self.links
        tags, link_tags = [0] * n, [0] * n
        in_link = [False] * n
        for node in range(1, n):
            in_link[node] = in_link[page.parent[node]] or page.tag[node] == "a"
        for node, block, text in page.text:
            if out[node]:
                continue
            text = html.unescape(text) if "&" in text else text
            self.decoded.append((node, block, text))
            size = len(text.strip())
            chars[node] += size
            if in_link[node]:
                links[node] += size
        for node in range(n - 1, 0, -1):
            if out[node]:
                continue
            up = page.parent[node]
            chars[up] += chars[node]
            links[up] += links[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (page.tag[node] == "a")
        body = next((k for k in range(n) if page.tag[k] == "body"), 0)
        self.body = body if chars[body] else 0
        if not chars[self.body]:
            return
        share = links[self.body] / chars[self.body]
        # The innermost part of the page around each node.
        above = [0] * n
        for node in range(1, n):
            up = page.parent[node]
            above[node] = above[up] if page.tag[up] in INLINE else up
        for node in range(n - 1, -1, -1):
            if out[node]:
                continue
            self.density[node] = _density(chars[node], tags[node], links[node], link_tags[node], share)
            if page.tag[node] not in INLINE and node:
                self.total[above[node]] += self.density[node]


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    out = _left_out(page)
    found = Measured(page, out)
    if not found.chars[found.body]:
        return ""
    chosen = _content(page, out, found)
    blocks: dict[int, list[str]] = {}
    for node, block, text in found.decoded:
        if chosen[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _density(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
    ratio = (chars / max(1, links)) * (max(1, tags) / max(1, link_tags))
    if base <= 1.0 + 1e-12:
        base = 1.0 + 1e-12 if ratio <= 1 else math.e
    return chars / max(1, tags) * max(0.0, math.log(max(ratio, 1.0)) / math.log(base))


def _content(page: Page, out: list[bool], found: Measured) -> list[bool]:
    """Which nodes belong to the main text."""
    n, body = len(page.tag), found.body
    chars, links, density, total = found.chars, found.links, found.density, found.total
    within = [False] * n
    within[body] = True
    for node in range(body + 1, n):
        within[node] = within[page.parent[node]] and not out[node]
    candidates = [k for k in range(body, n) if within[k] and page.tag[k] not in INLINE]
    best = max(candidates, key=lambda k: (total[k], -k))
    if total[best] <= 0:
        best = body
    threshold, node = density[best], best
    while node != body:
        node = page.parent[node]
        threshold = min(threshold, density[node])
    # Largest sum at or below each node.
    peak = list(range(n))
    for node in range(n - 1, body, -1):
        if within[node]:
            up = page.parent[node]
            if total[peak[node]] > total[peak[up]]:
                peak[up] = peak[node]
    # Innermost article or main element around each node.
    whole = [-1] * n
    for node in range(body + 1, n):
        if within[node]:
            whole[node] = node if page.tag[node] in MAIN else whole[page.parent[node]]
    chosen = [False] * n
    peaks = {peak[k] for k in candidates if k != body and chars[k] and density[k] >= threshold}
    for node in peaks | {best}:
        chosen[node if whole[node] < 0 else whole[node]] = True
    # Parts of one story: articles side by side, unless they are mostly links.
    parts = {page.parent[k] for k in candidates if chosen[k] and page.tag[k] == "article"}
    for node in candidates:
        if page.tag[node] == "article" and page.parent[node] in parts:
            chosen[node] = chosen[node] or 2 * links[node] < chars[node]
    for node in range(body + 1, n):
        chosen[node] = within[node] and (chosen[node] or chosen[page.parent[node]])
    return chosen


def with_main_text(df: DataFrame, source: str = "html", out: str = "main_text") -> DataFrame:
    """``df`` with the main text of the pages in ``source``."""
    if out.lower() in {name.lower() for name in df.columns}:
        raise ValueError(f"column exists: {out}")

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in pages], dtype=object)

    return df.withColumn(out, extract(column(source)))
