"""Operator 6: main text of html pages.

The standard library's parser streams events; they become lines, one for each
block, with their text-to-tag ratio. The ratios are smoothed by a Gaussian and
a threshold splits the lines into clusters of content and of other matter. The
section of the page that holds the content gives the text: all its blocks, but
none of its menus, forms, notices and the like.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import map_rows

#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose whole content is no article text.
SKIPPED = frozenset("aside audio button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title video".split())
#: Words of class, id and role values that mark such content on other elements.
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice popup promo related replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
SKIPPED_NAMES = frozenset("header page-header site-header top-bar skip-link".split())
#: Sections that can hold an article, and those that say they do.
SECTIONS = frozenset("article body center div main section table td tr tbody".split())
ARTICLES = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())
WORDS = re.compile(r"[^a-z0-9]+")
#: Names such as has-sidebar tell of the page, not of the element.
STATES = re.compile(r"(?:has|is|no|with|without)[-_]")
#: An element ends those of the second kind that are still open inside the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Node:
    tag: str
    parent: int
    article: bool = False
    skipped: bool = False


@dataclass
class Line:
    node: int
    text: list[str] = field(default_factory=list)
    tags: int = 1


def marked(attrs: list) -> tuple[bool, bool]:
    """Whether class, id or role say that an element is no article text, or that it is an article."""
    names = [v.lower() for k, v in attrs if k in ("class", "id", "role") and v]
    whole = {w for n in names for w in n.split() if not STATES.match(w)}
    words = {w for n in whole for w in WORDS.split(n)}
    hidden = any(k == "hidden" for k, _ in attrs)
    return hidden or bool(words & SKIPPED_WORDS) or bool(whole & SKIPPED_NAMES), bool(words & ARTICLE_WORDS)


class Lines(HTMLParser):
    """Lines of a page and the element that each stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.lines = [Node("", -1)], [Line(0)]
        self.open = [0]  # the open elements, as numbers of nodes

    def _line(self) -> None:
        if self.lines[-1].text or self.lines[-1].tags > 1:
            self.lines.append(Line(self.open[-1]))
        else:
            self.lines[-1].node = self.open[-1]

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        self._line()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            for k in range(len(self.open) - 1, 0, -1):  # a block ends an open paragraph
                name = self.nodes[self.open[k]].tag
                if name == "p":
                    self._close(k)
                    break
                if name in SECTIONS or name in SKIPPED or name in ("li", "dd", "blockquote"):
                    break
            if tag in IMPLIED:
                ended, inside = IMPLIED[tag]
                for k in range(len(self.open) - 1, 0, -1):
                    name = self.nodes[self.open[k]].tag
                    if name in inside:
                        break
                    if name in ended:
                        self._close(k)
        if tag == "br":
            self.lines[-1].text.append(" ")
        self.lines[-1].tags += 1
        if tag in VOID:
            if tag in BLOCK:
                self._line()
            return
        skip, article = marked(attrs)
        above = self.nodes[self.open[-1]]
        known = tag in ("html", "body", "main")
        node = Node(tag, self.open[-1], tag in ARTICLES or (article and tag in SECTIONS), above.skipped or tag in SKIPPED or (skip and not known))
        self.nodes.append(node)
        self.open.append(len(self.nodes) - 1)
        if tag in BLOCK or node.skipped != above.skipped:
            self._line()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self.lines[-1].tags += 1
        for k in range(len(self.open) - 1, 0, -1):
            node = self.nodes[self.open[k]]
            if node.tag == tag:
                if tag in BLOCK or node.skipped != self.nodes[node.parent].skipped:
                    self._close(k)
                else:
                    del self.open[k:]
                return
            if node.tag in SECTIONS and tag not in BLOCK and tag not in SKIPPED:
                return  # a stray end tag of an inline element

    def handle_data(self, data):
        line = self.lines[-1]
        if line.node != self.open[-1] and self.nodes[line.node].skipped != self.nodes[self.open[-1]].skipped:
            self._line()
            line = self.lines[-1]
        line.text.append(data)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over three sigmas to each side; at the ends the weights that exist are used."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(values[j] * weights[abs(i - j)] for j in near) / sum(weights[abs(i - j)] for j in near))
    return out


def content_lines(lengths: list[int], tags: list[int]) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio reaches the threshold, the mean less half a standard deviation."""
    ratio = smoothed([n / t for n, t in zip(lengths, tags)])
    if not ratio:
        return []
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    return [n > 0 and r >= max(mean - spread / 2, 1e-9) for n, r in zip(lengths, ratio)]


#: A section is chosen if it holds this share of the characters in content lines.
SHARE = 0.6
#: Lines whose text-to-tag ratio is this share of the mean of content lines belong to the article wherever they stand.
PART = 0.5


def main_text(html: str) -> str:
    """The blocks of the section that holds the content, joined by empty lines."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    nodes = parser.nodes
    kept = []
    for line in parser.lines:
        text = " ".join("".join(line.text).split())
        if not nodes[line.node].skipped:
            kept.append((line.node, text, line.tags))
    kept = [x for x in kept if x[1]]
    if not kept:
        return ""
    content = content_lines([len(t) for _, t, _ in kept], [n for _, _, n in kept])
    held, total = [0] * len(nodes), 0
    for (node, text, _), good in zip(kept, content):
        if good:
            held[node] += len(text)
            total += len(text)
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
    chosen = 0
    if total:
        least = PART * sum(len(t) / n for (_, t, n), good in zip(kept, content) if good) / sum(content)
        enough = [k for k in range(1, len(nodes)) if held[k] >= SHARE * total and not nodes[k].skipped]
        stated = [k for k in enough if nodes[k].article]
        own = {node for node, _, _ in kept}
        sections = [k for k in enough if nodes[k].tag in SECTIONS and k not in own]
        if stated:
            chosen = stated[-1] if nodes[stated[-1]].tag in ARTICLES or not any(nodes[k].tag in ARTICLES for k in stated) else [k for k in stated if nodes[k].tag in ARTICLES][-1]
        elif sections:
            chosen = sections[-1]  # the innermost: children have higher numbers
        text_like = [good or len(text) / tags >= least for (_, text, tags), good in zip(kept, content)]
        parts = [0] * len(nodes)
        for (node, _, _), good in zip(kept, text_like):
            parts[node] += good
        for k in range(len(nodes) - 1, 0, -1):
            parts[nodes[k].parent] += parts[k]
        while chosen and parts[chosen] < parts[0]:
            chosen = nodes[chosen].parent  # text beside the section is a part of the article too
    inside = [False] * len(nodes)
    inside[chosen] = True
    for k in range(chosen + 1, len(nodes)):
        inside[k] = inside[nodes[k].parent]
    return "\n\n".join(text for node, text, _ in kept if inside[node])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of each whole page, one row per input row, without a shuffle.

    White space inside a block, also no-break spaces, becomes one blank. A null
    or empty page, or one with furniture only, has an empty text; null ids and
    urls stay null; repeated rows are parsed alike; an empty table gives no rows.
    """

    def start():
        def row(page_id, address, page):
            text = main_text(page or "")
            return page_id, address, text, len(text)

        return row

    rows = pages.select(F.col(key).cast("bigint"), F.col(url).cast("string"), F.col(html).cast("string"))
    return map_rows(rows, start, "page_id bigint, url string, text string, n_chars bigint")
