"""HTML extraction by minimum-cut labelling.

A page is scanned once into blocks: runs of text between block-level tags, each with its place in the tree, its share of
link text and the roles that tags, classes and ids around it say. A linear classifier over length, links, punctuation,
kind of block, roles and place in the page turns these into a cost of calling the block content or one of calling it
boilerplate, the capacities of its edges to the two terminals. Neighbours in page order, the more so the fewer steps of the
tree lie between them, and children of one parent are tied by smoothness edges: what a block's own few words leave open,
the blocks around it decide. The minimum cut, by augmenting along shortest paths level by level, is the labelling of least
total cost; the blocks on the content side are the text. Scanning takes time in proportion to the page, however its
tags are nested.

Subtrees that never hold text to read (scripts, styles, forms, markup comments and the like) have no blocks. The head
of a page, menus, headers, footers, sidebars, notices, adverts and reader comments are known by tag, role, class and
id; a header inside an article is part of it.

Defined results: null and empty pages have an empty text. Unclosed, wrongly nested and cut-off tags are read as far as
they go; a cut-off tag at the end is dropped. Equal pages have equal texts. Character references are decoded, no-break
spaces count as white space. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import with_columns

#: Tags by how a page shows them.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
MUTE_TAGS = frozenset("button canvas datalist dialog form head input map math menu object audio video svg select".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "p": (), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
TAG_WEIGHTS = {"nav": -5.0, "footer": -5.0, "aside": -5.0, "header": -5.0, "menu": -5.0, "article": 3.0, "main": 2.0}
ROLE_WEIGHTS = {"navigation": -5.0, "banner": -5.0, "contentinfo": -5.0, "complementary": -5.0, "search": -5.0, "dialog": -5.0, "alertdialog": -5.0, "alert": -5.0, "form": -5.0, "main": 2.0, "article": 3.0}
BAD_WORDS = frozenset("ad ads adv alert alerts announcement announcements discussion feedback notice notices advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications overlay pager pagination paywall popup promo promoted promotion recommendation recommendations recommended related reply replies respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription teaser toc toolbar topbar widget widgets".split())
STATES = frozenset("has no with without free".split())
#: Parts of class names that say nothing of what an element holds.
SHAPES = frozenset("area bar block body bottom box col column container full group holder inner item items large left list mobile outer page panel primary right row secondary section site slot small top unit view wrap wrapper".split())
GOOD_WORDS = frozenset("article articlebody body-text content entry entry-content main maincontent post postcontent story storybody".split())
BAD_WEIGHT, GOOD_WEIGHT = -5.0, 1.5
#: Roles together count for no more than this either way.
MOST = 5.0
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    weight: float  #: of the roles of this element and those around it
    inside: bool  #: in an article or the main part
    muted: bool
    link: bool


@dataclass
class Block:
    node: int
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def bad_share(name: str, inside: bool) -> float:
    """How much of a class name says boilerplate: the share of its parts, those of its shape left out."""
    if name in BAD_WORDS:
        return float(not (inside and name == "header"))
    parts = [x for x in name.split("-") if x not in SHAPES]
    if not parts or parts[0] in STATES:
        return 0.0
    return sum(x in BAD_WORDS and not (inside and x == "header") for x in parts) / len(parts)


def role_weight(tag: str, attributes: str, inside: bool) -> float:
    """What an element's tag, role, class and id say: for content if positive."""
    weight = 0.0 if tag == "header" and inside else TAG_WEIGHTS.get(tag, 0.0)
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "role":
                weight += ROLE_WEIGHTS.get(value, 0.0)
            elif name in ("class", "id") and tag not in ("html", "body"):
                said = WORD.findall(value.replace("_", "-"))
                # a name of which only a part says boilerplate is weak evidence
                weight += BAD_WEIGHT * max((bad_share(x, inside) ** 3 for x in said), default=0.0)
                if {*said, *(x for w in said for x in w.split("-"))} & GOOD_WORDS and not any(bad_share(x, inside) == 1 for x in said):
                    weight += GOOD_WEIGHT
            elif name in ("hidden", "aria-hidden") and value in ("", "true", "hidden") or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                weight += BAD_WEIGHT
    return max(-MOST, min(MOST, weight))


BARRIERS = ("table", "article", "body")


class Open:
    """The open elements, innermost last, with the places of each tag and of block-level ones."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.by_tag, self.blocks = [0], [""], {}, [0]

    def push(self, node: int, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.nodes))
        self.by_tag.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            self.nodes.pop()
            self.by_tag[self.tags.pop()].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """Closes the innermost element of the tag, if there is one that the tag may close."""
        k = self.last(tag)
        if k and not (tag in ("p", "li", "span", "b", "i", "a") and any(self.last(x) > k for x in BARRIERS)):
            self.cut(k)

    def last(self, tag: str) -> int:
        places = self.by_tag.get(tag)
        return places[-1] if places else 0

    def make_room(self, tag: str) -> None:
        """Ends an open paragraph, or an item of the same list, before a block-level tag."""
        k = self.blocks[-1]
        t = self.tags[k]
        if k and (t == "p" and tag != "br" or t == tag and tag in SAME_LEVEL or {t, tag} == {"dt", "dd"} or {t, tag} == {"td", "th"}):
            self.cut(k)


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks with text, in order, and its tree."""
    nodes = [Node("", -1, 0, 0.0, False, False, False)]
    stack = Open()
    out: list[Block] = []
    now: Block | None = None

    def text(raw: str) -> None:
        nonlocal now
        top = nodes[stack.nodes[-1]]
        if top.muted or not raw:
            return
        if now is None:
            if raw.isspace():
                return
            holder = stack.nodes[stack.blocks[-1]]
            now = Block(holder, nodes[holder].tag)
        now.parts.append(raw)
        if top.link:
            now.linked += len(raw)

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
            now = None

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[2] or not m[4]:  # a comment or declaration, or a tag cut off at the end
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            close()
        if m[1]:
            stack.close(tag)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK_TAGS:
            stack.make_room(tag)
        if tag in VOID_TAGS:
            continue
        up = nodes[stack.nodes[-1]]
        weight = role_weight(tag, m[3], up.inside)
        inside = up.inside or tag in ("article", "main")
        if weight < 0:  # what an element says of itself outweighs the article around it
            weight += min(up.weight, 0.0)
        elif tag == "article" and up.weight < 0:  # a reader's comment or a teaser
            weight = up.weight
        elif tag != "main":
            weight += up.weight
        weight = max(-MOST, min(MOST, weight))
        nodes.append(Node(tag, stack.nodes[-1], up.depth + 1, weight, inside, up.muted or tag in MUTE_TAGS, up.link or tag == "a"))
        stack.push(len(nodes) - 1, tag)
    close()
    return out, nodes


def costs(b: Block, node: Node, edge: bool) -> tuple[float, float]:
    """The costs of calling a block boilerplate and of calling it content. edge: it stands before the first or after the last long block of the page."""
    words = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
    score = node.weight + 2.5 * words / (words + 15) - 0.75 - 3.0 * density - 0.4 * edge
    if b.tag in ("p", "pre", "blockquote"):
        score += 0.6
    elif b.tag in ("h1", "h2", "h3"):
        score += 0.75
    elif b.tag in ("li", "td", "th", "dt", "dd") and density > 0.5:
        score -= 0.5
    if b.text[-1] in ".!?:;…。\"”»":
        score += 0.4
    if b.text[0] in "©®" or re.match(r"copyright\b|\(c\)|all rights reserved", b.text, re.I):
        score -= 3.0
    return max(score, 0.0), max(-score, 0.0)


#: Of neighbours without steps between them, and of children of one parent with other blocks between them.
ADJACENT, SIBLING = 2.4, 0.5
#: Steps of the tree beyond which blocks are as far as can be, and words of a long block.
FAR, LONG = 6, 20


def steps(nodes: list[Node], a: int, b: int) -> int:
    """Steps of the tree between two nodes, up to FAR."""
    n = 0
    while a != b and n < FAR:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        n += 1
    return n


def edges(found: list[Block], nodes: list[Node]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, more between near places of the tree, and between children of one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        up = nodes[b.node].parent
        if i:
            out.append((i - 1, i, ADJACENT / (1 + steps(nodes, found[i - 1].node, b.node))))
        if up in last and last[up] < i - 1:
            out.append((last[up], i, SIBLING))
        last[up] = i
    return out


def minimum_cut(source: list[float], sink: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source's side of a minimum cut; nodes on either side of equal cuts lie there only if flow from the source can still reach them."""
    n = len(source)
    more = [source[i] - sink[i] for i in range(n)]  # what is left after flow straight through a node
    around: list[list[list]] = [[] for _ in range(n)]
    for a, b, c in ties:
        x, y = [b, c, None], [a, c, None]
        x[2], y[2] = y, x
        around[a].append(x)
        around[b].append(y)
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if more[i] > tiny)
        for i in queue:
            level[i] = 0
        goal = -1
        while queue:
            i = queue.popleft()
            if more[i] < -tiny:
                goal = level[i]
            if goal >= 0 and level[i] >= goal:
                continue
            for e in around[i]:
                if e[1] > tiny and level[e[0]] < 0:
                    level[e[0]] = level[i] + 1
                    queue.append(e[0])
        if goal < 0:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in range(n):
            while more[start] > tiny and level[start] == 0:
                path: list[list] = []
                i = start
                while not (more[i] < -tiny and i != start):
                    step = None
                    while place[i] < len(around[i]):
                        e = around[i][place[i]]
                        if e[1] > tiny and level[e[0]] == level[i] + 1:
                            step = e
                            break
                        place[i] += 1
                    if step is not None:
                        path.append(step)
                        i = step[0]
                    elif path:
                        level[i] = -2
                        i = path.pop()[2][0]
                        place[i] += 1
                    else:
                        break
                if not path:
                    break
                amount = min(more[start], -more[i], min(e[1] for e in path))
                for e in path:
                    e[1] -= amount
                    e[2][1] += amount
                more[start] -= amount
                more[i] += amount


def labels(found: list[Block], nodes: list[Node]) -> list[bool]:
    """Whether each block is content."""
    long = [i for i, b in enumerate(found) if b.text.count(" ") >= LONG - 1]
    both = [costs(b, nodes[b.node], not long or not long[0] <= i <= long[-1]) for i, b in enumerate(found)]
    return minimum_cut([x for x, _ in both], [y for _, y in both], edges(found, nodes))


def extract(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    found, nodes = blocks(page)
    return " ".join(b.text for b, good in zip(found, labels(found, nodes), strict=True) if good) if found else ""


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = with_columns(pages, page_id="bigint", url="string", html="string").select("page_id", "url", "html")

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py()) for x in col], pa.string())

    return pages.select("page_id", "url", run("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
