"""HTML extraction by tag-path ratios.

A page becomes blocks of text, each with the path of tags from the root to its leaf (classes and
ids included, inline tags left out). For each path the text length, the number of its nodes, and
the punctuation are summed over the page; length per node and punctuation per node are smoothed
over the blocks in page order, fused by their geometric mean, and paths above a threshold (a share
of the length-weighted mean) are content. The content node is the lowest one around all blocks of
content paths (an article or main it lies in, where there is one); the main text is every block in it
that is not boilerplate.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers
and hidden parts are left out, by tag, role, class or id, and so are blocks that are nearly all
links beside real text. Classes and ids only tell parts of a page from each other: where all text
has such names they don't count. Character references are decoded, white space in a block becomes one
space, blocks are joined by a line feed. Unclosed and stray tags are repaired as browsers do for
paragraphs, items and cells; a tag cut off at the page's end is dropped. Null and empty pages, and
pages without text, give an empty text. Pages are used whole, in time linear in their length however
deep they nest; equal pages give equal texts. Columns named as the results (any case) give way.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _mapped

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|textarea|title|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr br img".split())
BOILER = frozenset("nav footer aside form button select option dialog menu fieldset input head".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tags that an opening tag closes first, within the nearest of the tags after it.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}
BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|side-?bars?|menus?|nav(?:bar|igation)?|bread-?crumbs?|comments?|comment-?list|disqus|replies|reply|respond|footers?|headers?|masthead|cookies?|consent|gdpr|notices?|alerts?|disclaimer|popups?|modals?|overlay|newsletter|subscribe|subscription|sign-?up|log-?in|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|toolbar|pagination|pager|skip|toc|copyright|legal)(?:$|[\s_-])",
    re.I,
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Parts of a text that don't stand for the whole: the content node is around them.
LONE = frozenset("p li blockquote pre td th tr tbody thead tfoot table ul ol dl dt dd h1 h2 h3".split())
#: A path is content from this share of the length-weighted mean score.
SHARE = 0.35
LINKS = 0.6


#: An open paragraph is looked for up to the nearest of these.
AROUND_P = ("p", "div", "article", "section", "td", "th", "li", "body", "blockquote", "main")


class _Node:
    """An open element: what its ancestors say about it is kept on it, so no block walks to the root."""

    __slots__ = ("tag", "boiler", "named", "inline", "up", "block", "path", "inside", "header", "holder", "depth", "number")

    def __init__(self, tag: str, attributes: str, up: _Node | None, paths: dict[tuple[int, str], int]):
        self.tag, self.up, self.inline, label = tag, up, tag in INLINE, ""
        if up is None:
            self.boiler = self.named = self.inside = self.header = False
            self.holder, self.block, self.path, self.depth, self.number = None, self, 0, 0, 0
            return
        #: boiler: by tag, role or hidden; named: by class or id; inside: an article or main; header: in a header.
        self.boiler, self.named, self.inside, self.header = up.boiler or tag in BOILER, up.named, up.inside or tag in ("article", "main"), up.header or tag == "header"
        self.depth = up.depth + 1
        if attributes and not attributes.isspace():
            got = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            label = (got.get("class", "") + " " + got.get("id", "")).strip()
            if label and tag not in ("body", "html", "article", "main") and BOILER_NAME.search(label):
                self.named = True
            style = got.get("style", "").replace(" ", "").lower()
            if got.get("role", "").lower() in BOILER_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
                self.boiler = True
        if tag == "header" and not self.inside:  # a page's header; inside an article only its headings stay
            self.boiler = True
        self.block = up.block if self.inline else self
        self.path = up.path if self.inline else paths.setdefault((up.path, tag + ("." + label if label else "")), len(paths) + 1)
        #: The innermost article or main.
        self.holder = self if tag in ("article", "main") else up.holder


class _Open:
    """The open elements, with the places of each tag, so that the nearest of a tag is found at once."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes = [_Node("", "", None, self.paths)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.number = 0

    def nearest(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these tags, 0 where there is none."""
        return max(self.places[t][-1] if self.places.get(t) else 0 for t in tags)

    def push(self, tag: str, attributes: str) -> None:
        self.places[tag].append(len(self.nodes))
        node = _Node(tag, attributes, self.nodes[-1], self.paths)
        self.number += 1
        node.number = self.number
        if not node.inline:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if not node.inline:
                self.blocks.pop()


def blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(node, text, characters in links) of the page's blocks in order."""
    at, out = _Open(), []
    text: list[str] = []
    owner, links, in_link = at.nodes[0], 0, 0

    def end() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((owner, joined, links))
            text.clear()
        links = 0

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not text:
                    owner = at.nodes[-1].block
                text.append(piece)
                if in_link:
                    links += len(piece.strip())
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[2]:
            place = at.nearest((tag,))
            if not place or (inline and place < at.blocks[-1]):  # a stray inline end tag does not close blocks
                continue
            if not inline:
                end()
            at.close(place)
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img"):
                text.append(" " if tag == "br" else "") if text else None
            else:
                end()
            continue
        if not inline:
            end()
            in_link = 0
            if tag == "p" or at.nodes[-1].block.tag == "p":
                # blocks end an open paragraph
                place = at.nearest(AROUND_P)
                if place and at.nodes[place].tag == "p":
                    at.close(place)
            if tag in CLOSES:
                names, stop = CLOSES[tag]
                within = at.nearest(stop)
                found = [x for n in names for x in at.places[n][bisect.bisect_right(at.places[n], within) :][:1]]
                if found:
                    at.close(min(found))
        at.push(tag, m[4])
        if tag == "a":
            in_link += 1
    end()
    return out


def _around(one: _Node, two: _Node) -> _Node:
    """The lowest block around both."""
    while one.depth > two.depth:
        one = one.up
    while two.depth > one.depth:
        two = two.up
    while one is not two:
        one, two = one.up, two.up
    return one.block


def path_scores(live: list[tuple[_Node, str, int]]) -> tuple[dict[int, float], float]:
    """Score of each tag path, and the score from which a path is content."""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    nodes: dict[int, int] = defaultdict(int)
    paths = [n.path for n, _, _ in live]
    for path, (_, text, links) in zip(paths, live, strict=True):
        length[path] += max(0, len(text) - links)
        marks[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
    text_ratio = np.array([length[p] / nodes[p] for p in paths])
    mark_ratio = np.array([marks[p] / nodes[p] for p in paths])
    kernel = np.array([1.0, 2.0, 1.0])
    weight = np.convolve(np.ones(len(paths)), kernel)[1:-1]
    fused = np.sqrt((np.convolve(text_ratio, kernel)[1:-1] / weight) * (np.convolve(mark_ratio, kernel)[1:-1] / weight))
    sums: dict[int, float] = defaultdict(float)
    for p, f in zip(paths, fused, strict=True):
        sums[p] += float(f)
    # a path scores its mean, and no more than its own ratios: what stands beside content is not content for that
    score = {p: min(sums[p] / nodes[p], 2 * float(np.sqrt((length[p] / nodes[p]) * (marks[p] / nodes[p])))) for p in length}
    total = sum(length.values())
    return score, SHARE * sum(score[p] * n for p, n in length.items()) / total if total else 0.0


def main_text(page: str | None) -> str:
    found = [b for b in blocks(page or "") if not b[0].boiler and (not b[0].header or b[0].tag in HEADINGS)]
    # names only tell parts of a page from each other: a page all of whose text has such names is not empty
    live = [b for b in found if not b[0].named] or found
    if not live:
        return ""
    score, line = path_scores(live)
    content = [node for node, _, _ in live if score[node.path] >= line]
    if not content:
        return ""
    # the lowest node around all blocks of content paths: that around the first and the last in the order of their tags
    holds = _around(min(content, key=lambda x: x.number), max(content, key=lambda x: x.number))
    # a lone paragraph, list or row stands for the node around it, and anything inside an article for the article
    while holds.tag in LONE and holds.up is not None and holds.up.up is not None and holds.up.tag not in ("body", "html"):
        holds = holds.up
    holds = holds.holder or holds
    article = holds.tag in ("article", "main")
    inside: dict[_Node, bool] = {holds: True}
    out = []
    for node, text, links in live:
        up, x = [], node
        while x is not None and x not in inside:
            up.append(x)
            x = x.up
        here = x is not None and inside[x]
        inside |= dict.fromkeys(up, here)
        if not here:
            continue
        chosen = score[node.path] >= line
        if not article and not chosen and node.tag not in HEADINGS and node.tag not in ("p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"):
            continue
        if links > LINKS * len(text) and (node.tag == "li" or PUNCTUATION.search(text) is None) and not chosen:
            continue
        out.append(text)
    return "\n".join(out)


def with_main_text(pages: DataFrame, source: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each and its number of code points."""

    def run(rows: list) -> list[pa.Array]:
        out = [main_text(r) for r in rows]
        return [pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]

    return _mapped(pages, source, [(text, T.StringType()), (n_chars, T.LongType())], lambda: run)
