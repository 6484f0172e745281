"""Main content of web pages by wrapper induction.

Pages of one host and layout are aligned, as trees, with one page of that kind by simple tree matching.  Nodes of that
page whose text is the same on most of the different pages of its kind are template; what varies, and what no node of the
template meets, is content.
"""

from __future__ import annotations

import html as _entities
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm._shared import BROADCAST_BYTES, map_arrow, slices, written

_SLICE = 2 << 20
#: Levels of a tree that tell layouts apart: html, body, its children and theirs.
_LAYOUT_DEPTH = 4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|[^<]+|<", re.S)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Elements that are part of the text of the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base col embed hr link meta param source track".split())
#: A tag that opens closes these open ones first.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
#: Closing stops there.
_SCOPES = frozenset("ul ol dl table tbody thead div article section main nav body html aside header footer td th".split())
#: Landmarks and class names of what is not a page's own text, even where it varies.
_FRAME_TAGS = frozenset("nav footer aside form button select menu head dialog".split())
_FRAME_CLASSES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies footer menu nav navbar navigation promo related share sharing sidebar social sponsored".split())


class Node:
    """A block element with the text that stands directly in it (inline elements included)."""

    __slots__ = ("label", "shape", "parts", "links", "children", "frame", "size", "tag")

    def __init__(self, tag: str, label: str, frame: bool):
        self.tag, self.label, self.frame = tag, label, frame
        self.parts: list[str] = []
        self.links = 0
        self.children: list[Node] = []
        self.shape: int | None = None
        self.size = 1

    @property
    def text(self) -> str:
        if not self.parts:
            return ""
        text = "".join(self.parts)
        return " ".join((_entities.unescape(text) if "&" in text else text).split())


def parse(source: str) -> Node:
    """The page's tree; anything unclosed is closed at the end."""
    root = Node("", "", False)
    stack = [root]
    in_link = 0
    for m in _TOKEN.finditer(source):
        tag = m.group(3)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                top = stack[-1]
                if in_link:
                    top.links += len(piece.strip())
                if top.parts or not piece.isspace():
                    top.parts.append(piece)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m.group(2) else 1
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        if m.group(2):
            in_link = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            if stack[-1].parts:
                stack[-1].parts.append(" ")
            continue
        if tag in _VOID:
            continue
        closing = _CLOSES.get(tag, ("p",))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closing:
                del stack[k:]
            elif stack[k].tag in _SCOPES or not stack[k].tag:
                break
        in_link = 0
        parent = stack[-1]
        c = _CLASS.search(m.group(4)) if "class" in m.group(4) else None
        names = (c.group(1) or c.group(2) or c.group(3) or "").lower().split() if c else ()
        frame = parent.frame or tag in _FRAME_TAGS or not _FRAME_CLASSES.isdisjoint(names)
        node = Node(tag, f"{tag}.{names[0]}" if names else tag, frame)
        if parent.parts:
            parent.parts.append(" ")
        parent.children.append(node)
        stack.append(node)
    _shape(root)
    return root


def _shape(root: Node) -> None:
    """Sizes and shapes (equal for subtrees that are alike but for their texts), bottom up without recursion."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    for n in reversed(order):
        n.size = 1 + sum(c.size for c in n.children)
        n.shape = hash((n.label, *[c.shape for c in n.children])) if n.children else hash(n.label)


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def _ends(x: list[Node], y: list[Node]) -> tuple[int, int, int]:
    """How many children are alike at the beginning, and where the alike ends begin in either list.  Pairing those
    outright loses nothing: a largest matching that does otherwise can be changed into one that does."""
    lo, hx, hy = 0, len(x), len(y)
    while lo < hx and lo < hy and x[lo].shape == y[lo].shape:
        lo += 1
    while hx > lo and hy > lo and x[hx - 1].shape == y[hy - 1].shape:
        hx -= 1
        hy -= 1
    return lo, hx, hy


def _table(x: list[Node], y: list[Node], memo: dict) -> list[list[int]]:
    table = [[0] * (len(y) + 1)]
    for p in x:
        above, row = table[-1], [0]
        for j, q in enumerate(y):
            best = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if p.label == q.label:
                w = above[j] + weight(p, q, memo)
                if w > best:
                    best = w
            row.append(best)
        table.append(row)
    return table


def weight(a: Node, b: Node, memo: dict) -> int:
    """The size of the largest matching of two trees with one label; known by their shapes once it is found."""
    if a.shape == b.shape:
        return a.size
    x, y = a.children, b.children
    if not x or not y:
        return 1
    key = (a.shape, b.shape)
    w = memo.get(key)
    if w is None:
        lo, hx, hy = _ends(x, y)
        w = 1 + sum(c.size for c in x[:lo]) + sum(c.size for c in x[hx:])
        if lo < hx and lo < hy:
            w += _table(x[lo:hx], y[lo:hy], memo)[-1][-1]
        memo[key] = w
    return w


def matching(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two trees with one label: a largest set of pairs of nodes that keeps labels, parents
    and the order of siblings."""
    memo: dict = {}
    pairs, stack = [], [(a, b)]
    while stack:
        p, q = stack.pop()
        if p.shape == q.shape:
            pairs += zip(preorder(p), preorder(q), strict=True)
            continue
        pairs.append((p, q))
        x, y = p.children, q.children
        lo, hx, hy = _ends(x, y)
        stack += zip(x[:lo], y[:lo], strict=True)
        stack += zip(x[hx:], y[hy:], strict=True)
        x, y = x[lo:hx], y[lo:hy]
        if not x or not y:
            continue
        table = _table(x, y, memo)
        i, j = len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i -= 1
                j -= 1
                stack.append((x[i], y[j]))
    return pairs


def slots(page: Node, pivot: Node | None) -> list[tuple[int, bool, str, bool]]:
    """(pivot's node or -1, same text as there, text, framed) of each node with text, in reading order.  Framed: inside
    a landmark that is not content, or mostly links."""
    if pivot is None:
        at, theirs = {}, []
    else:
        theirs = preorder(pivot)
        number = {id(n): k for k, n in enumerate(theirs)}
        at = {id(p): number[id(q)] for p, q in matching(page, pivot)}
    out = []
    for n in preorder(page):
        if not n.parts:
            continue
        text = n.text
        if not text:
            continue
        k = at.get(id(n), -1)
        out.append((k, k >= 0 and theirs[k].text == text, text, n.frame or 2 * n.links > len(text)))
    return out


def layout_of(page: Node) -> int:
    """A hash of the set of label paths from the root down to ``_LAYOUT_DEPTH`` (below ``head``: none)."""
    paths, level = set(), [("", page)]
    for _ in range(_LAYOUT_DEPTH):
        level = [(f"{path}/{c.label}", c) for path, n in level if n.tag != "head" for c in n.children]
        paths.update(path for path, _ in level)
    return int.from_bytes(blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_SLOTS = "nodes array<int>, same array<boolean>, texts array<string>, framed array<boolean>"


def host_of(url):
    """The lower-cased host of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit(""))


def extract(pages: DataFrame, share: float = 0.6, min_pages: int = 3, key: str = "page_id", url: str = "url", html: str = "html", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, host, title, content, n_slots, n_template) of every row of ``pages``.

    Every layout (see ``layout_of``) with at least ``min_pages`` different pages of a host has a wrapper of its own; the
    host's other pages have one together.  A node of such a group's pivot is template if at least ``min_pages``
    different pages of the group meet it and ``share`` of them have its text.  Content is the text of all other nodes, one line each, but for those inside
    landmarks (nav, footer, aside, head, forms), in blocks named like advertisements or menus, and those that are
    mostly links.  ``n_slots`` counts the nodes with text, ``n_template`` those of them
    that the template takes.

    The pivot is the page with the smallest hash, so the result does not depend on the order of rows.  Pages with the
    same source count once.  Pages without a host (null or malformed addresses) are read without a template, and
    so are pages of groups with fewer than ``min_pages`` different pages.  A null source gives null content, an
    empty one or one without text an empty content.  Repeated rows give repeated results; other columns are
    ignored.  All pages are aligned, however many a host has: alignment is with one page, and only counts are
    gathered per group.
    """
    base = pages.select(F.col(f"`{key}`").alias("k"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("t"))
    base = base.withColumn("h", F.xxhash64("t")).withColumn("bytes", F.octet_length("t"))
    kind = base.schema["k"].dataType.simpleString()

    def laid(rows: DataFrame, keep: dict[str, str]) -> DataFrame:
        """The columns ``keep`` of ``rows`` and their layout.  Pages are parsed again wherever this is read: sources are
        never written."""

        def lay(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))
            for part in slices(batch, "t", _SLICE):
                layouts = [None if host is None or text is None else layout_of(parse(text)) for host, text in zip(part.column("host").to_pylist(), part.column("t").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(layouts, pa.int64())], names=[*keep, "layout"])

        return map_arrow(rows.select(*dict.fromkeys([*keep, "host", "t"])), lay, ", ".join(f"{c} {x}" for c, x in keep.items()) + ", layout long")

    there = base.where(F.col("host").isNotNull() & F.col("t").isNotNull())
    known = written(laid(there, {"host": "string", "h": "long", "bytes": "int"}), "laid")
    # Rare layouts share group 0 of their host.
    common = known.select("host", "layout", "h").dropDuplicates().groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    common = written(common.select("host", "layout", F.col("layout").alias("own")), "layouts")
    size = common.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0))).first()[0]
    common = F.broadcast(common) if size <= limit else common

    def grouped(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(common, ["host", "layout"], "left").select("host", F.when(F.col("layout").isNotNull(), F.coalesce("own", F.lit(0))).alias("layout"), *columns)

    # One page per group, found by its hash: only the pages that are pivots are read on.
    first = grouped(known, "h", "bytes").groupBy("host", "layout").agg(F.min(F.struct("h", "bytes")).alias("first"))
    first = written(first.select("host", "layout", "first.h", "first.bytes"), "first")
    size = first.agg(F.coalesce(F.sum(F.octet_length("host") + 20), F.lit(0))).first()[0]
    pivots = there.join(F.broadcast(first) if size <= limit else first, ["host", "h", "bytes"]).groupBy("host", "layout").agg(F.min("t").alias("pivot"))
    pivots = written(pivots, "pivots")
    size = pivots.agg(F.coalesce(F.sum(F.octet_length("pivot") + F.octet_length("host") + 8), F.lit(0))).first()[0]
    joined = grouped(laid(base, {"k": kind, "host": "string", "h": "long", "t": "string"}), "k", "h", "t").join(F.broadcast(pivots) if size <= limit else pivots, ["host", "layout"], "left")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be nested that deep
        trees: dict[tuple[str, int], Node] = {}
        for part in slices(batch, "t", _SLICE):
            hosts, layouts, texts, column = part.column("host").to_pylist(), part.column("layout").to_pylist(), part.column("t").to_pylist(), part.column("pivot")
            rows: list[list | None] = []
            titles: list[str | None] = []
            for k, (host, layout, text) in enumerate(zip(hosts, layouts, texts, strict=True)):
                if text is None:
                    rows.append(None)
                    titles.append(None)
                    continue
                pivot = None
                if host is not None:
                    pivot = trees.get((host, layout))
                    if pivot is None:
                        pivot = trees[host, layout] = parse(column[k].as_py())
                tree = parse(text)
                titles.append(next((n.text for n in preorder(tree) if n.tag == "title"), None))
                rows.append(slots(tree, pivot))
            columns = [[None if r is None else [s[i] for s in r] for r in rows] for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("host"), part.column("layout"), part.column("h"), pa.array(titles, pa.string()), pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.list_(pa.bool_())), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.list_(pa.bool_()))],
                names=["k", "host", "layout", "h", "title", "nodes", "same", "texts", "framed"],
            )

    aligned = written(map_arrow(joined.select("k", "host", "layout", "h", "t", "pivot"), run, f"k {kind}, host string, layout long, h long, title string, {_SLOTS}"), "aligned")
    different = aligned.where(F.col("host").isNotNull() & F.col("nodes").isNotNull()).select("host", "layout", "h", "nodes", "same").dropDuplicates(["host", "layout", "h"])
    met = different.select("host", "layout", F.explode(F.arrays_zip("nodes", "same")).alias("s")).where("s.nodes >= 0")
    counts = met.groupBy("host", "layout", F.col("s.nodes").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s.same")).alias("same"))
    fixed = counts.where((F.col("n") >= min_pages) & (F.col("same") >= F.lit(share) * F.col("n")))
    templates = written(fixed.groupBy("host", "layout").agg(F.collect_list("node").alias("fixed")), "templates")
    bytes_ = templates.agg(F.coalesce(F.sum(F.size("fixed") * 4 + F.octet_length("host")), F.lit(0))).first()[0]
    with_template = aligned.join(F.broadcast(templates) if bytes_ <= limit else templates, ["host", "layout"], "left")
    # A slot belongs to the template if it has the template's text at the template's place.
    all_slots = F.arrays_zip("nodes", "same", "texts", "framed")
    constant = lambda s: s["same"] & F.coalesce(F.array_contains(F.col("fixed"), s["nodes"]), F.lit(False))
    content = F.array_join(F.transform(F.filter(all_slots, lambda s: ~s["framed"] & ~constant(s)), lambda s: s["texts"]), "\n")
    return with_template.select(
        F.col("k").alias(key),
        "host",
        "title",
        F.when(F.col("nodes").isNotNull(), content).alias("content"),
        F.when(F.col("nodes").isNotNull(), F.size("nodes")).otherwise(0).cast("long").alias("n_slots"),
        F.when(F.col("nodes").isNotNull(), F.size(F.filter(all_slots, constant))).otherwise(0).cast("long").alias("n_template"),
    )
