"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks in page order. A linear classifier gives each block a cost for
being called content and one for being called boilerplate; they become the capacities of its
edges to the two terminals. Blocks that follow each other are joined by smoothness edges, the
stronger the fewer elements lie between them; so are blocks under the same parent. An edge
between an element marked as boilerplate or article and one that is not has a quarter of its
capacity. The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIP = frozenset(
    "noscript template svg math canvas object audio video select button datalist dialog".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILER = frozenset("nav footer aside form menu fieldset".split())
CONTENT = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("ul ol dl table select".split())
# A start tag of the first kind ends an open element of the second kind.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor"
    " sponsored nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead"
    " sidebar side aside widget comment comments disqus respond reply replies discussion cookie"
    " cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup"
    " login form search share sharing social related recommended toolbar pagination pager legal"
    " copyright disclaimer feedback complementary contentinfo skip".split()
)
CONTENT_WORDS = frozenset("article articlebody content main post entry story".split())
# Weights of the block classifier (log odds of being content). A text alone weighs -4.6 (one
# linked word) to about 4 (a paragraph of hundreds of words). What HTML defines as navigation,
# complement, form or footer outweighs any text; a class name outweighs a text of usual length.
WEIGHTS = {
    "bias": -1.0, "in_content": 4.0, "boiler_tag": -8.0, "boiler_class": -5.5, "heading": 0.5,
    "paragraph": 1.0, "log_words": 0.6, "link_share": -4.0, "sentence": 0.5,
}
# Two paragraphs in a row, two steps apart, are joined by 3.0 / 3 + 0.8: an inner block's edges
# weigh 3.6, as much as its text.
NEXT_EDGE, PARENT_EDGE, ACROSS = 3.0, 0.8, 0.25
UNITS = 1000  # capacities are whole numbers of 1/1000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_SPACE = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}


def _tag_end(page: str, at: int, closed: dict[str, int]) -> int:
    """Index of the ``>`` that ends the tag, outside quotes; -1 if there is none."""
    end = page.find(">", at)
    while end >= 0:
        start, quote = at, None
        # The first quote that is still open at ``end``.
        while True:
            a, b = page.find('"', start, end), page.find("'", start, end)
            quote = min(x for x in (a, b, end) if x >= 0)
            if quote == end:
                return end
            mark = page[quote]
            if quote >= closed[mark]:  # never closed: the tag ends at the next >
                return end
            start = page.find(mark, quote + 1) + 1
            if start > end:
                break
        at, end = start, page.find(">", start)
    return -1


def _hints(attributes: str) -> tuple[bool, bool]:
    boiler = content = False
    for _, value in _ATTR.findall(attributes):
        words = {w.lower() for w in _CAMEL.split(value.strip("\"'")) if w}
        boiler |= bool(words & BOILER_WORDS)
        content |= bool(words & CONTENT_WORDS)
    return boiler, content


class _Open(NamedTuple):
    """An open element. ``block`` is the stack's index of the nearest element, itself included,
    that is not inline; ``depth`` counts those around it."""

    name: str
    by_tag: bool
    by_class: bool
    content: bool
    skip: bool
    number: int
    block: int
    depth: int


class _Block(NamedTuple):
    """A text block; ``steps`` are the block elements between it and the block before."""

    text: str
    linked: int
    by_tag: bool
    by_class: bool
    content: bool
    name: str
    parent: int
    steps: int

    @property
    def role(self) -> int:
        return -1 if self.by_tag or self.by_class else int(self.content)


class _Blocks:
    """The text blocks of one page. Work per tag does not grow with the open elements."""

    def __init__(self, page: str):
        self.blocks: list[_Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack = [_Open("", False, False, False, False, 0, 0, 0)]
        self.at: dict[str, list[int]] = {}  # name: places on the stack
        self.scopes: list[int] = []  # places of lists and tables
        self.count = 0
        self.last = self.low = 0  # depth of the last block, least depth since
        self.read(page)
        self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        linked, self.parts, self.linked = self.linked, [], 0
        if text:
            own = self.stack[self.stack[-1].block]
            place = self.stack[-1].block
            parent = self.stack[self.stack[place - 1].block].number if place else 0
            low = min(self.low, own.depth)
            steps = self.last + own.depth - 2 * low
            self.last = self.low = own.depth
            self.blocks.append(
                _Block(text, linked, own.by_tag, own.by_class, own.content, own.name, parent, steps)
            )

    def text(self, s: str) -> None:
        if s and not self.stack[-1].skip:
            s = entities.unescape(s)  # by itself: a reference does not reach across a tag
            self.parts.append(s)
            if self.at.get("a"):
                self.linked += len(s)

    def pop(self) -> None:
        name = self.stack.pop().name
        self.at[name].pop()
        if name in SCOPES:
            self.scopes.pop()
        self.low = min(self.low, self.stack[-1].depth)

    def close(self, name: str) -> None:
        if self.at.get(name):
            while self.stack[-1].name != name:
                self.pop()
            self.pop()

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
        if name not in INLINE:
            self.flush()
            self.close("p")
            for other in ENDS.get(name, ()):
                # Only inside the nearest list or table.
                places = self.at.get(other)
                if places and places[-1] > (self.scopes[-1] if self.scopes else 0):
                    self.close(other)
        if name in VOID:
            return
        _, by_tag, by_class, content, skip, _, block, depth = self.stack[-1]
        if name not in ("html", "body"):
            b, c = _hints(attributes) if attributes else (False, False)
            # What an article calls its header or its menu of sections is judged by the tag;
            # a page header is boilerplate, an article's own is not.
            by_tag = by_tag or name in BOILER or (name == "header" and not content)
            by_class = (
                by_class
                or (b and name not in CONTENT and name != "header")
                or (b and name in CONTENT and not c and content)
            )
            if name == "main":  # a page has one: a name around all of it says nothing
                by_class = False
            content = (content or name in CONTENT or c) and not by_tag and not by_class
            skip = skip or name in SKIP
        self.count += 1
        place = len(self.stack)
        if name not in INLINE:
            block, depth = place, depth + 1
        self.stack.append(_Open(name, by_tag, by_class, content, skip, self.count, block, depth))
        self.at.setdefault(name, []).append(place)
        if name in SCOPES:
            self.scopes.append(place)

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        closed = {'"': page.rfind('"'), "'": page.rfind("'")}
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                return
            self.text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            ending = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + ending)
            if not m:
                self.text("<")
                at = lt + 1
                continue
            end = page.find(">", m.end()) if ending else _tag_end(page, m.end(), closed)
            if end < 0:  # a cut-off tag
                return
            name, at = m[0].lower(), end + 1
            if ending:
                if name == "br":
                    self.text(" ")
                elif name not in INLINE:
                    self.flush()
                self.close(name)
            elif name in RAW:
                if name in ("title", "iframe"):
                    self.flush()
                stop = _CLOSE[name].search(page, at)
                if not stop:
                    return
                end = page.find(">", stop.end())
                at = n if end < 0 else end + 1
            else:
                self.start(name, page[m.end() : end])


def _log_odds(block: _Block) -> float:
    w, text = WEIGHTS, block.text
    z = w["bias"] + w["log_words"] * math.log1p(text.count(" ") + 1)
    z += w["link_share"] * min(1.0, block.linked / max(1, len(text)))
    z += w["in_content"] * block.content
    z += w["boiler_tag"] * block.by_tag + w["boiler_class"] * block.by_class
    z += w["heading"] * (block.name in HEADING)
    z += w["paragraph"] * (block.name in ("p", "pre", "blockquote"))
    z += w["sentence"] * (text[-1] in ".!?。")
    return z


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of a minimum cut.

    ``terminal[i] > 0`` is a capacity from the source to i, ``< 0`` one from i to the sink;
    ``edges`` (i, j, capacity) go both ways. A node whose terminal capacity outweighs all its
    edges is on that terminal's side in some minimum cut and is fixed first; the rest is
    solved by augmenting flow along shortest paths, level by level. Nodes that a cut could
    leave on either side go to the sink.
    """
    n = len(terminal)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    excess, side = list(terminal), [None] * n
    around = [sum(c for _, c in near[i]) for i in range(n)]
    todo = deque(i for i in range(n) if abs(excess[i]) > around[i])
    while todo:
        i = todo.popleft()
        if side[i] is not None:
            continue
        side[i] = excess[i] > 0
        for j, c in near[i]:
            if side[j] is None:
                excess[j] += c if side[i] else -c
                around[j] -= c
                if abs(excess[j]) > around[j]:
                    todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        to: list[int] = []
        cap: list[int] = []
        out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

        def arc(a: int, b: int, forth: int, back: int) -> None:
            out[a].append(len(to))
            to.append(b)
            cap.append(forth)
            out[b].append(len(to))
            to.append(a)
            cap.append(back)

        for i in rest:
            if excess[i] > 0:
                arc(s, number[i], excess[i], 0)
            elif excess[i] < 0:
                arc(number[i], t, -excess[i], 0)
        for i, j, c in edges:
            if i in number and j in number:
                arc(number[i], number[j], c, c)
        level = _max_flow(s, t, to, cap, out)
        for i, k in number.items():
            side[i] = level[k] >= 0
    return side


def _max_flow(s: int, t: int, to: list[int], cap: list[int], out: list[list[int]]) -> list[int]:
    """Saturates the network; the levels of the last search are >= 0 on the source side."""
    while True:
        level = [-1] * len(out)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return level
        nxt = [0] * len(out)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, u = [], s
                continue
            while nxt[u] < len(out[u]):
                e = out[u][nxt[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(out[u]):
                path.append(out[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                u = to[path.pop() ^ 1]
                nxt[u] += 1


def labelled(page: str | None) -> list[tuple[str, bool, bool]]:
    """Per block in page order: its text, the classifier's own label, and that of the cut."""
    blocks = _Blocks(page or "").blocks
    terminal, edges, last = [], [], {}

    def join(i: int, j: int, capacity: float) -> None:
        across = 1.0 if blocks[i].role == blocks[j].role else ACROSS
        edges.append((i, j, round(UNITS * capacity * across)))

    for i, b in enumerate(blocks):
        terminal.append(round(UNITS * _log_odds(b)))
        if i:
            join(i - 1, i, NEXT_EDGE / (1 + b.steps))
        if b.parent in last:
            join(last[b.parent], i, PARENT_EDGE)
        last[b.parent] = i
    return [(b.text, z > 0, keep) for b, z, keep in zip(blocks, terminal, min_cut(terminal, edges))]


def main_text(page: str | None) -> str:
    """The content blocks of a page in order, joined by a newline. Nothing: an empty text."""
    return "\n".join(text for text, _, keep in labelled(page) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``.

    Null, empty and text-free html give an empty text of 0 characters; a page of any length is
    read whole, in time that grows with its length. Broken markup is read
    as far as it goes: an unclosed element ends with its parent, a cut-off tag ends the page.
    Repeated rows stay repeated; other columns are not read. Each page is a piece of work of
    its own, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
