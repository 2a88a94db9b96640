"""Main text of web pages by composite text density.

A page is read into a tree of elements. For every element: C characters of text, T elements, LC
characters and LT elements of links below it. Its density is ``C / T`` times the logarithm of
``(C / LC) * (T / LT)`` to the base ``ln(C / (C - LC) * LC + LCb / Cb * C + e)``, where ``b`` is the body:
much text and few links make it high. The density sum of an element is that of its children.

The element with the largest density sum below the body is the main one. The smallest density on
the path from it to the body is the threshold: of every element that reaches it, the subtree with
the largest sum is content. All text of content is returned, short and link-rich blocks included.

Elements and roles that say by themselves that they are a menu, header, footer, side bar, notice, form, script or style are left
out from the start. The words of class and id leave nothing out: an element that they call an advert, comments and so on has
its density and that of all it holds multiplied by ``DOUBT``, and goes only where that is below the threshold, inside content too.
So an article stays the main element under any name, as the path to the body is measured by the same densities.

Defined results: null, empty pages and pages without text give ''. Broken markup is read as browsers do
in the main: an unclosed element ends with its parent, a block ends an open paragraph, a stray end
tag is ignored, an unfinished tag or raw element at the end is dropped, ``<`` before anything but a
letter, ``/``, ``!`` or ``?`` is text. Nesting of any depth is walked without recursion. Repeated rows give equal
rows; other columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by what they do to a text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Further elements that stand in a line of text: they neither end a block nor close a paragraph.
IN_LINE = INLINE | frozenset(
    "img picture input button select textarea output meter progress svg math canvas object embed audio video map area iframe "
    "script noscript style template slot link meta source track param".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that end an open one of the same kind, and the elements they don't reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOISE = frozenset(
    "head nav footer aside form button select menu dialog template svg canvas object audio video map datalist".split()
)
#: Noise unless they are part of an article.
PAGE_PART = frozenset({"header"})
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments "
    "commentlist disqus respond replies pagination pager toolbar".split()
)
DOUBT = 0.1
#: Elements whose names count if a noise word is the first or last word of them; of others it must be the whole name.
CONTAINERS = frozenset("div section ul ol dl table fieldset details article main center".split())
#: Before a noise word these say that something else is meant.
NOT_ITSELF = frozenset("no has with without not".split())
HOLDERS = frozenset({"html", "body", "main", "article"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    for m in _ATTRIBUTE.finditer(text or ""):
        if m.start() and not text[m.start() - 1].isspace() and text[m.start() - 1] not in "\"'/":
            continue  # the end of a longer name
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def _is_noise(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> bool:
    if tag in HOLDERS:
        return False
    if tag in NOISE or (tag in PAGE_PART and not in_article):
        return True
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _is_doubtful(tag: str, attributes: list[tuple[str, str]]) -> bool:
    """Whether class or id call the element noise."""
    if tag in ("html", "body"):
        return False
    for part in (p for name, value in attributes if name in ("class", "id") for p in value.split()):
        words = [w.lower() for w in _WORD.findall(part)]
        if words and (len(words) == 1 or tag in CONTAINERS):
            if words[0] in NOISE_WORDS or (words[-1] in NOISE_WORDS and words[-2] not in NOT_ITSELF):
                return True
    return False


class Page:
    """The tree of one page as lists over its elements; parents come before their children."""

    def __init__(self, page: str):
        self.tag, self.parent, self.noise, self.link, self.doubtful = ["#page"], [-1], [False], [False], [False]
        self.texts: list[tuple[int, int, str]] = []  # element, number of its block, text
        self._read(page)

    def _read(self, page: str) -> None:
        stack, block, at = [0], 0, 0
        open_articles = 0
        size = len(page)
        # How many of each element are open, and where in the stack the elements are that are not inline: no search through deep nesting.
        opened: Counter[str] = Counter()
        blocks: list[int] = []

        def close(depth: int) -> None:
            nonlocal open_articles
            for i in stack[depth:]:
                opened[self.tag[i]] -= 1
                open_articles -= self.tag[i] in ("article", "main")
            del stack[depth:]
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        while at < size:
            m = _TOKEN.search(page, at)
            stop = m.start() if m else size
            if stop > at and not self.noise[stack[-1]]:
                self.texts.append((stack[-1], block, html.unescape(page[at:stop])))
            if not m:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag not in IN_LINE and (opened[tag] or tag == "p"):
                    block += 1
                if opened[tag]:
                    # Inline end tags do not close blocks.
                    lowest = blocks[-1] if tag in INLINE and blocks else 0
                    depth = next((d for d in range(len(stack) - 1, lowest, -1) if self.tag[stack[d]] == tag), 0)
                    if depth:
                        close(depth)
                continue
            if tag == "br":
                if not self.noise[stack[-1]]:
                    self.texts.append((stack[-1], block, " "))
                continue
            if tag not in IN_LINE:
                block += 1
                if blocks and self.tag[stack[blocks[-1]]] == "p":
                    close(blocks[-1])
            if tag in ENDS and any(opened[t] for t in ENDS[tag][0]):
                same, bounds = ENDS[tag]
                for depth in reversed(blocks):
                    if self.tag[stack[depth]] in bounds:
                        break
                    if self.tag[stack[depth]] in same:
                        close(depth)
                        break
            parent = stack[-1]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size
                if end:
                    at = (page.find(">", end.end()) + 1) or size
                continue
            self.tag.append(tag)
            self.parent.append(parent)
            attributes = list(_attributes(m[3]))
            self.noise.append(self.noise[parent] or _is_noise(tag, attributes, open_articles > 0))
            self.doubtful.append(_is_doubtful(tag, attributes))
            self.link.append(self.link[parent] or tag == "a")
            if tag not in VOID and not (m[3] or "").endswith("/"):
                stack.append(len(self.tag) - 1)
                opened[tag] += 1
                open_articles += tag in ("article", "main")
                if tag not in INLINE:
                    blocks.append(len(stack) - 1)

    def text(self) -> str:
        """The blocks of the content, two line ends between them."""
        content = self.content()
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.texts:
            if content[node]:
                blocks.setdefault(block, []).append(text)
        found = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(filter(None, found))

    def densities(self) -> tuple[list[float], int]:
        """The density of each element, and the body."""
        n = len(self.tag)
        kept = [i for i in range(n) if not self.noise[i]]
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text in self.texts:
            size = len(text) - text.count(" ") if text != " " else 0
            chars[node] += size
            if self.link[node]:
                link_chars[node] += size
        for i in reversed(kept[1:]):
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in kept if self.tag[i] == "body"), 0)
        density = [0.0] * n
        doubt = list(self.doubtful)
        for i in kept[1:]:
            doubt[i] = doubt[i] or doubt[self.parent[i]]
        share = link_chars[body] / max(1, chars[body])
        for i in kept:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            if c:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1 else 0.0)
                if doubt[i]:
                    density[i] *= DOUBT
        return density, body

    def content(self) -> list[bool]:
        """Whether the text of each element is content."""
        density, body = self.densities()
        n = len(self.tag)
        kept, sums = [i for i in range(n) if not self.noise[i]], [0.0] * n
        for i in kept[1:]:
            sums[self.parent[i]] += density[i]
        # The element with the largest sum in each subtree; of equal ones the outermost.
        best = list(range(n))
        for i in reversed(kept[1:]):
            p = self.parent[i]
            if sums[best[i]] > sums[best[p]] or (sums[best[i]] == sums[best[p]] and best[p] != p and best[i] < best[p]):
                best[p] = best[i]
        threshold, i = density[body], best[body]
        while i > body:
            threshold, i = min(threshold, density[i]), self.parent[i]
        marked = [False] * n
        for i in kept:
            if i > body and density[i] >= threshold:
                marked[best[i]] = True
        if best[body] == body:
            marked[body] = True
        for i in kept[1:]:
            marked[i] = (marked[i] or marked[self.parent[i]]) and not (self.doubtful[i] and density[i] < threshold)
        return marked


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the main text of the markup in ``page``."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return df.withColumn(out, texts(F.col(f"`{page}`")))
