"""Main text of web pages by minimum-cut labelling of their blocks.

A block is text between two block-level tags. A linear classifier gives each block the costs of calling it content or
boilerplate, which become its terminal capacities; neighbours in the page and in the tree are joined by smoothness
edges. The minimum cut between the terminals, found by maximum flow, is the cheapest labelling of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import columns

# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
UNSEEN = frozenset("script style textarea title noscript template head iframe object svg canvas select option datalist audio video map math".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Parts of class, id and role names that mark boilerplate and content.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist disqus consent contentinfo complementary cookie cookies copyright "
    "disclaimer dropdown feedback footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promoted promotion reader recommended recommendations related reply replies respond responses search share sharing sidebar signin signup skip social sponsor sponsored "
    "subscribe subscription tagcloud toolbar topbar trackback tracking widget widgets alert warning"
    .split()
)
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())

# Weights of the classifier: log odds of content.
WEIGHTS = {
    "bias": -0.4, "boiler": -7.0, "page header": -6.0, "article header": -0.5, "boiler outside": -2.5, "content tag": 4.0, "content name": 2.0,
    "links": -4.0, "length": 0.9, "sentences": 0.8, "heading": 0.4, "paragraph": 0.8, "item": -0.6,
}
# Smoothness of neighbours in the page and of the next blocks in the tree; across sections they hardly pull.
ADJACENT, TREE, ACROSS = 0.8, 0.6, 0.05
TREE_REACH = 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+))(?:>|\Z)",
    re.S,
)
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    depth: int
    boiler: bool = False
    unseen: bool = False
    names: frozenset = frozenset()
    section: Node | None = None


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _element(tag: str, rest: str, parent: Node) -> Node:
    node = Node(tag, parent, parent.depth + 1, unseen=parent.unseen or tag in UNSEEN)
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "style":
            node.unseen |= "display:none" in value.replace(" ", "")
        elif key == "hidden" or key == "aria-hidden":
            node.unseen |= (key == "hidden" and value != "until-found") or value == "true"
        else:
            names.update(_NAME_PART.findall(value))
    node.names = frozenset(names)
    marked = tag in BOILER_TAGS or tag in CONTENT_TAGS or tag in ("header", "section") or bool(names & BOILER_NAMES) or bool(names & CONTENT_NAMES)
    node.section = node if marked else parent.section
    return node


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in page order; broken markup is closed where an ancestor ends."""
    root = Node("", None, 0)
    root.section = root
    node, block, links, out = root, None, 0, []
    at = 0

    def put(raw: str) -> None:
        nonlocal block
        if not raw or node.unseen:
            return
        if block is None:
            home = node
            while home.tag in INLINE and home.parent is not None:
                home = home.parent
            block = Block(home)
            out.append(block)
        text = html.unescape(raw)
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    while True:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                node = up.parent
                links = max(0, links - (tag == "a"))
            if tag not in INLINE:
                block = None
            continue
        if tag not in INLINE:
            block = None
            links = 0
        if tag in CLOSES_P:
            up = node
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        elif tag in SELF_NESTING:
            up = node
            while up.parent is not None and up.tag not in SELF_NESTING[tag] and up.tag != tag:
                up = up.parent
            if up.tag == tag:
                node = up.parent
        if tag == "body":
            while node.parent is not None:
                node = node.parent
        if tag in VOID:
            continue
        child = _element(tag, m["rest"], node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or len(page)
            continue
        node = child
        links += tag == "a"
    return [b for b in out if b.text()]


def log_odds(block: Block) -> float:
    """Log odds that a block is content."""
    text = block.text()
    s = WEIGHTS["bias"]
    boiler, outside, content, named, header, own_header = False, False, False, False, False, False
    node: Node | None = block.node
    while node is not None and node.tag != "":
        # body and html name whole pages, so their classes say nothing of a block. The nearest mark counts most.
        if node.tag not in ("body", "html"):
            about = node.tag in CONTENT_TAGS or bool(node.names & CONTENT_NAMES)
            if node.tag in BOILER_TAGS or node.names & BOILER_NAMES:
                outside |= content
                boiler |= not content
            elif node.tag == "header" or "header" in node.names:
                own_header |= about
                header = True
            elif not boiler:
                content |= node.tag in CONTENT_TAGS
                named |= about
        node = node.parent
    s += WEIGHTS["boiler"] * boiler + WEIGHTS["boiler outside"] * outside + WEIGHTS["content tag"] * content + WEIGHTS["content name"] * (named and not content)
    s += header * (WEIGHTS["article header"] if content or own_header else WEIGHTS["page header"])
    words = text.split()
    s += WEIGHTS["links"] * min(1.0, block.linked / max(1, len(text)))
    s += WEIGHTS["length"] * (min(3.0, math.log1p(len(words) / 4)) - 0.7)
    s += WEIGHTS["sentences"] * min(2, len(_SENTENCE_END.findall(text)))
    tag = block.node.tag
    s += WEIGHTS["heading"] * (tag[:1] == "h" and tag[1:].isdigit()) + WEIGHTS["paragraph"] * (tag in ("p", "blockquote", "pre")) + WEIGHTS["item"] * (tag in ("li", "td", "th", "dd", "dt"))
    return s


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and between near blocks in the tree, weaker with their distance."""
    edges = []
    for i, block in enumerate(blocks):
        for j in range(i + 1, min(len(blocks), i + 1 + TREE_REACH)):
            other = blocks[j]
            weight = TREE / (1 + _distance(block.node, other.node)) + (ADJACENT if j == i + 1 else 0.0)
            edges.append((i, j, weight if block.node.section is other.node.section else weight * ACROSS))
    return edges


def minimum_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    ``costs`` has for each node the cost of lying on the source's and on the sink's side, ``edges`` what two nodes cost
    when they are parted. Flow is sent along shortest paths, level by level, until the sink is out of reach.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(there)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, (on_source, on_sink) in enumerate(costs):
        # What both terminals would take passes straight through the node.
        through = min(on_source, on_sink)
        if on_sink > through:
            arc(source, k, on_sink - through, 0.0)
        elif on_source > through:
            arc(k, sink, on_source - through, 0.0)
    for a, b, weight in edges:
        arc(a, b, weight, weight)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(left[e] for e in path)
                for e in path:
                    left[e] -= push
                    left[e ^ 1] += push
                path, a = [], source
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str) -> tuple[str, int, int]:
    """(text of the content blocks joined by blanks, number of blocks, number of content blocks)."""
    blocks = blocks_of(page)
    scores = [log_odds(b) for b in blocks]
    costs = [(math.log1p(math.exp(-min(s, 50.0))), math.log1p(math.exp(min(s, 50.0)))) for s in scores]
    content = minimum_cut(costs, smoothness(blocks))
    kept = [b.text() for b, yes in zip(blocks, content) if yes]
    return " ".join(kept), len(blocks), len(kept)


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_content", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_id, url, pages = columns(batch, "page_id", "url", "html")
        found = [main_text(p) for p in pages]
        values = (page_id, url, [f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _RESULT)], schema=_RESULT)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Null html is empty; a page without content blocks gives an empty text; broken markup is read as far as it goes and
    nothing is cut off. Blocks have their white space turned into single blanks, character references decoded, and are
    joined by a blank. Repeated rows are extracted each; an empty table gives an empty result; other columns are ignored.
    Result: page_id, url, text, n_chars, n_blocks, n_content.
    """
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return read.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
