"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks at block-level tags. Fixed classifier weights turn the features of a block into a cost
of calling it boilerplate or content (the capacities to the two terminals). Neighbouring blocks, and blocks of the same
parent, are joined by edges that cost more the nearer the blocks are in the tree. The cheapest labelling is a minimum
cut, found by maximum flow.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags by kind.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select
summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template svg math object canvas iframe noembed noframes xmp".split())
#: An opening tag ends an open element of these, up to the next enclosing container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
CONTAINER = frozenset("article aside body div dl fieldset figure footer form header main nav ol section table ul blockquote".split())
#: Words of class, id and role attributes that speak for and against content.
GOOD_WORDS = frozenset("article content entry main post story".split())
BAD_WORDS = frozenset("""ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs button comment commentlist comments
complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header login masthead menu menubar modal
nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies reply
respond review reviews search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget""".split())
BAD_TAGS = frozenset("nav footer aside form button select dialog menu noscript head label fieldset search".split())
#: Classifier weights.
IN_ARTICLE, GOOD_NAME, BAD_PLACE, HEADER, HIDDEN = 3.0, 1.5, -9.0, -9.0, -20.0
PARAGRAPH, HEADING, ITEM, WORDS, SENTENCE, LINKS, BARE = 0.6, 0.4, -0.4, 0.35, 0.5, -3.0, -0.9
#: Most that an edge between neighbours, and between blocks of one parent, can cost.
NEXT, SAME_PARENT = 1.2, 0.4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']+|"[^"]*"|'[^']*'){0,200}+|[^<>]*)>""", re.S)
_UNFINISHED = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Element:
    __slots__ = ("bad", "good", "id", "link", "parent", "tag", "depth")

    def __init__(self, tag, parent, number, rest):
        self.tag, self.parent, self.id = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.good, self.bad = (parent.good, parent.bad) if parent else (0.0, 0.0)
        self.link = tag == "a" or bool(parent and parent.link)
        if tag in ("article", "main"):
            self.good = max(self.good, IN_ARTICLE)
        if tag in BAD_TAGS:
            self.bad = min(self.bad, BAD_PLACE)
        if tag == "header" and self.good < IN_ARTICLE:
            self.bad = min(self.bad, HEADER)
        if rest and not rest.isspace() and tag not in ("html", "body"):
            names = {w.lower() for m in _NAMES.findall(rest) for w in _PART.findall(m)}
            if names & BAD_WORDS and not (tag in ("article", "main") and names & GOOD_WORDS):
                self.bad = min(self.bad, BAD_PLACE)
            if names & GOOD_WORDS:
                self.good = max(self.good, GOOD_NAME)
            if _HIDDEN.search(rest):
                self.bad = min(self.bad, HIDDEN)


class Block:
    __slots__ = ("cost", "home", "linked", "parts", "text")

    def __init__(self, home: _Element):
        self.home, self.parts, self.linked = home, [], 0


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with their costs; positive costs speak for content."""
    root = top = _Element("", None, 0, "")
    number, at, out, current = 0, 0, [], None

    def add(text):
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(top)
        current.parts.append(text)
        if top.link:
            current.linked += len(text)

    def flush():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                current.cost = _cost(current)
                out.append(current)
            current = None

    last = page.rfind(">")
    while at < len(page):
        m = _TAG.search(page, at) if at <= last or "<!" in page[at:] else None
        if m is None:
            add(entities.unescape(_UNFINISHED.sub("", page[at:])))
            break
        add(entities.unescape(page[at:m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in BLOCK:
            flush()
        if tag == "br":
            add(" ")
        if m["end"]:
            e = top
            while e is not root and e.tag != tag:
                # Inline and paragraph ends don't close the container around them.
                if tag not in CONTAINER and e.tag in CONTAINER:
                    e = root
                    break
                e = e.parent
            if e is not root:
                top = e.parent
            continue
        if tag in RAW and not m["rest"].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in VOID or tag in RAW:
            continue
        while top is not root and (top.tag in ENDS.get(tag, ()) or top.tag == "p" and tag in BLOCK or tag in BLOCK and top.tag not in BLOCK):
            top = top.parent
        number += 1
        top = _Element(tag, top, number, m["rest"])
    flush()
    return out


def _block_home(e: _Element) -> _Element:
    while e.tag not in BLOCK and e.parent is not None:
        e = e.parent
    return e


def _cost(b: Block) -> float:
    home = _block_home(b.home)
    words = b.text.count(" ") + 1
    linked = min(1.0, b.linked / max(1, len(b.text)))
    cost = BARE + WORDS * math.log2(words) + LINKS * linked + b.home.good + b.home.bad
    cost += PARAGRAPH if home.tag in ("p", "pre", "blockquote") else HEADING if re.fullmatch("h[1-6]", home.tag) else ITEM if home.tag in ("li", "td", "option") else 0
    return cost + SENTENCE * (b.text[-1] in ".!?…。" and words > 3)


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    homes = [_block_home(b.home) for b in found]
    for i, home in enumerate(homes):
        if i:
            out.append((i - 1, i, NEXT / (1 + _distance(homes[i - 1], home) / 2)))
        parent = home.parent.id if home.parent else -1
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    return out


def min_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of the cheapest labelling: a block labelled against its cost pays it, a cut edge pays its weight.

    A block whose cost outweighs all its edges has its label in any cheapest labelling. Such blocks are settled first,
    one after the other; only what is left needs a flow.
    """
    n, unit = len(costs), 1 << 20
    cost = [round(c * unit) for c in costs]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[j][i] = near[i].get(j, 0) + round(w * unit)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += w if label[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    return _flow(rest, cost, near, label) if rest else label


def _flow(rest, cost, near, label):
    """Labels of the unsettled blocks: content is what the residual graph reaches from the source (n)."""
    n = len(cost)
    room = {i: dict(near[i]) for i in rest}
    room[n], room[n + 1] = {}, {}
    for i in rest:
        a, b = (n, i) if cost[i] > 0 else (i, n + 1)
        room[a][b] = abs(cost[i])
        room[b].setdefault(a, 0)
    while True:
        level, queue = {n: 0}, deque([n])
        while queue:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if n + 1 not in level:
            break
        todo = {a: list(room[a]) for a in level}
        path = [n]
        while path:
            a = path[-1]
            if a == n + 1:
                push = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= push
                    room[y][x] = room[y].get(x, 0) + push
                path = [n]
                continue
            while todo[a] and not (room[a].get(todo[a][-1], 0) > 0 and level.get(todo[a][-1]) == level[a] + 1):
                todo[a].pop()
            if todo[a]:
                path.append(todo[a][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()
    for i in rest:
        label[i] = i in level
    return label


def main_text(page: str) -> str:
    """Content blocks of a page, two line ends apart; empty if there are none."""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, min_cut([b.cost for b in found], edges(found))) if keep)


def extracted(page: Column) -> Column:
    """Main text of a column of pages; null counts as an empty page."""
    @F.pandas_udf(T.StringType())
    def f(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype="object")

    return f(F.coalesce(page, F.lit("")))


def labelled_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All blocks of all pages: id, position, tag, text, cost, is_content. Pages without text have none."""
    kind = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()),
                                     T.StructField("cost", T.DoubleType()), T.StructField("is_content", T.BooleanType())]))

    @F.pandas_udf(kind)
    def f(column: pd.Series) -> pd.Series:
        out = []
        for page in column:
            found = blocks(page)
            keep = min_cut([b.cost for b in found], edges(found))
            out.append([{"position": i, "tag": _block_home(b.home).tag, "text": b.text, "cost": b.cost, "is_content": k} for i, (b, k) in enumerate(zip(found, keep))])
        return pd.Series(out, dtype="object")

    found = pages.select(F.col(id_col).alias("id"), F.explode(f(F.coalesce(F.col(html_col), F.lit("")))).alias("b"))
    return found.select(F.col("id").alias(id_col), "b.*")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
