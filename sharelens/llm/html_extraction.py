"""Main text of web pages by a tree-structured graphical model.

Each DOM node, text pieces included, has a binary variable: does its subtree
hold main text? A node's potential comes from logistic weights of its tag,
class and id words and, for lists and boxes, link share, a phrasing element's (a, b, em ...) from its
words alone, and a text piece's from one weight; each parent-child pair has a potential, one for elements in the page's body, one for other elements, one for text pieces and one for elements that
are named as parts of a page, that all but forbids main text below a node without any and
lets a child follow its parent. One sum-product pass upward and one downward give
exact marginals; text pieces at 0.5 or more are the main text.

Weights and potentials are fitted on labelled pages: a bounded sample whose
text pieces are labelled main text where they are a line of the document that
the page shares most lines with, or begin as it does (headings). Documents of one text count
as one, and lines of more than COMMON of them, or of the share COMMON_SHARE if that is more, name none. Pages of over
LABELLED_CHARS characters aren't in the sample, names that one page alone has keep their prior, and equal nodes are counted
once, so that what the driver holds has a bound. The weights have prior means from the
usual names of page parts, so that parts no labelled page has are known too. n nodes that
look alike weigh as 1 + log2(n), so that a thousand pages of one template don't outweigh
what is known of others.

Headings in a `header` go with it, also within an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

ship(__name__)

#: At most so many pages are labelled, in the order of a hash of page_id.
LABELLED_PAGES, LABELLED_CHARS = 400, 50_000
COMMON, COMMON_SHARE, HEAD_CHARS, STEPS = 50, 2e-5, 20, 300
#: How firmly prior means stand: class and id words are learned, what an element's tag means is known.
NAME_PRECISION, PRECISION = 0.5, 100.0
#: Smoothed counts of the potentials of elements in the page's body, of those in other elements, of text pieces, and of elements
#: named as parts of a page: below a node without main text none and some, below one with it none and some.
EDGES = [[[50.0, 0.05], [2.0, 6.0]], [[50.0, 0.05], [0.6, 20.0]], [[50.0, 0.05], [0.6, 20.0]], [[50.0, 0.05], [18.0, 2.0]]]
# Elements by how a browser treats them, and names of page parts.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "option", "button"}
OPAQUE = {"script", "style", "textarea", "title"}
PHRASING = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
PAGE = {"html", "body"}
LISTING = {"dd", "div", "dl", "dt", "li", "menu", "ol", "section", "table", "tbody", "td", "th", "tr", "ul"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "li", "dd", "dt"}
AGAINST = ["nav", "aside", "header", "footer", "form", "menu", "sidebar", "ad", "ads", "advert", "banner", "cookie", "consent", "notice", "comment", "comments", "reply", "respond", "promo", "sponsor", "sponsored", "share", "social", "related", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "popup", "widget", "pagination", "toolbar", "login", "search"]
FAVOURED = ["article", "main", "content", "post", "entry", "story"]
_PARTS = {*AGAINST, *RAW}
_OPEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))", re.S)
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Node:
    __slots__ = ("tag", "parent", "names", "text", "cut", "chars", "linked")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str = "", cut: bool = False):
        self.tag, self.parent, self.names, self.text, self.cut, self.chars, self.linked = tag, parent, names, text, cut, 0, 0


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, the root first; a text piece has tag "#" and `cut` if a block boundary lies before it."""
    page, nodes, stack, at, cut = page or "", [Node("html", -1)], [0], 0, True
    blocks, opened = [], Counter()  # places in the stack that hold blocks; how many of each tag are open: so no tag searches the stack in vain

    def add_text(raw: str) -> None:
        nonlocal cut
        if raw:
            nodes.append(Node("#", stack[-1], text=html.unescape(raw), cut=cut))
            cut = False

    def close(depth: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < len(page):
        found = _OPEN.search(page, at)
        if not found:
            add_text(page[at:])
            break
        add_text(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, rest = found[2].lower(), _REST.match(page, at)
        end = rest.end() if rest else (page.find(">", at) + 1 or len(page))
        attributes, at = page[at:end], end
        cut = cut or tag in BLOCKS
        if found[1]:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                close(1)
        elif tag in CLOSES or tag in CLOSES_P:
            ends = CLOSES.get(tag, {"p"})
            for depth in reversed(blocks):
                if nodes[stack[depth]].tag in ends:
                    close(depth)
                    break
                if nodes[stack[depth]].tag != "p":
                    break
        names = tuple(w for m in _NAMES.finditer(attributes) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w)
        nodes.append(Node(tag, stack[-1], names))
        if tag == "br":
            nodes.append(Node("#", stack[-1], text=" ", cut=cut))
        if tag in VOID or attributes.endswith("/>") and tag not in BLOCKS:
            continue
        if tag in OPAQUE:
            end_tag = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
            at = end_tag.end() if end_tag else len(page)
            continue
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        if tag in BLOCKS:
            blocks.append(len(stack) - 1)
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        node, up = nodes[i], nodes[nodes[i].parent]
        if node.tag == "#":
            node.chars = len(node.text.strip())
        up.chars += node.chars
        up.linked += node.chars if node.tag == "a" else node.linked
    return nodes


def node_features(nodes: list[Node], i: int) -> list[tuple[str, float]]:
    node = nodes[i]
    if node.tag == "#":
        return [("text", 1.0)]
    if node.tag in PAGE:  # what a page's body is named for speaks of its parts; the root of a page without markup holds its text
        return [("bias", 1.0), ("tag:body", 1.0)]
    names = [("name:" + w, 1.0) for w in sorted(set(node.names))]
    if node.tag in PHRASING:
        return names
    links = []
    if node.tag in LISTING:  # how much more of it are links than of what it lies in; a paragraph may be one
        up = nodes[node.parent]
        links = [("links", round(max(0.0, node.linked / max(1, node.chars) - up.linked / max(1, up.chars)), 1))]
    return [("bias", 1.0), ("tag:" + node.tag, 1.0), *links, *names]


def edge_kind(nodes: list[Node], i: int) -> int:
    """Which of the potentials joins a node with its parent."""
    node = nodes[i]
    if node.tag == "#":
        return 2
    if node.tag not in PAGE and not _PARTS.isdisjoint((node.tag, *node.names)):
        return 3
    return int(nodes[node.parent].tag not in PAGE)


def prior_mean(feature: str) -> float:
    if feature == "tag:body":
        return 8.0  # a page nearly always holds some
    kind, _, word = feature.partition(":")
    if kind in ("tag", "name"):
        return -8.0 if word in AGAINST or word in RAW else 2.5 if word in FAVOURED else 0.0
    return -3.0 if feature == "links" else 0.0


def marginals(nodes: list[Node], weights: dict[str, float], edge: np.ndarray) -> list[float]:
    """P(main text) of each node by sum-product: messages to the root, then back. `edge[kind][parent][child]`, kind by edge_kind."""
    n = len(nodes)
    score = [sum(weights.get(f, prior_mean(f)) * x for f, x in node_features(nodes, i)) for i in range(n)]
    unary = [(1.0, float(np.exp(max(-30.0, min(30.0, s))))) for s in score]
    inside, to_parent = [list(u) for u in unary], [(1.0, 1.0)] * n
    pairs, kinds = [tuple(map(float, e.ravel())) for e in edge], [edge_kind(nodes, i) for i in range(n)]
    for i in range(n - 1, 0, -1):
        zero, one = inside[i]
        e00, e01, e10, e11 = pairs[kinds[i]]
        m0, m1 = e00 * zero + e01 * one, e10 * zero + e11 * one
        total = m0 + m1
        to_parent[i] = m0, m1 = m0 / total, m1 / total
        up = inside[nodes[i].parent]
        up[0] *= m0
        up[1] *= m1
        if (total := up[0] + up[1]) < 1e-200:
            total = total or 1e-300
        up[0] /= total
        up[1] /= total
    belief = [tuple(inside[0])] * n
    for i in range(1, n):
        b0, b1 = belief[nodes[i].parent]
        e00, e01, e10, e11 = pairs[kinds[i]]
        o0, o1 = b0 / max(to_parent[i][0], 1e-300), b1 / max(to_parent[i][1], 1e-300)
        zero, one = inside[i][0] * (o0 * e00 + o1 * e10), inside[i][1] * (o0 * e01 + o1 * e11)
        total = zero + one or 1e-300
        belief[i] = (zero / total, one / total)
    return [b[1] / (b[0] + b[1] or 1e-300) for b in belief]


def extract(page: str | None, weights: dict[str, float], edge: np.ndarray) -> str:
    """The main text: blocks in page order joined by one line break, white space within a block as one space."""
    nodes = parse(page)
    p, blocks, cut = marginals(nodes, weights, edge), [[]], True
    for node, share in zip(nodes, p):
        if node.tag != "#":
            cut = cut or node.tag in BLOCKS
            continue
        if node.cut:
            blocks.append([])
        if share >= 0.5 or not node.text.strip():
            blocks[-1].append(node.text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, page in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
            rows = [(i, " ".join(n.text.split())) for i, n in enumerate(parse(page)) if n.tag == "#" and n.text.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["page_id", "node", "piece"])


def train(pages: DataFrame, docs: DataFrame, bound: int = LABELLED_PAGES) -> tuple[dict[str, float], np.ndarray]:
    """(weights, edge potentials). Without labelled pages the prior means decide."""
    sample = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), "html").where(f"page_id IS NOT NULL AND length(html) <= {LABELLED_CHARS}").orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(bound).dropDuplicates(["page_id"]), "labelled-pages")
    pieces = stage(sample.mapInArrow(_pieces, "page_id long, node int, piece string"), "pieces")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    keys = pieces.select("page_id", "node", F.explode(F.array(F.xxhash64(F.lit("line"), "piece"), F.xxhash64(F.lit("head"), F.substring("piece", 1, HEAD_CHARS)))).alias("key"))
    wanted = F.broadcast(keys.select("key").distinct())  # a bounded sample's pieces
    docs = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("doc_id"), "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.xxhash64(F.lit("line"), tidy(F.col("line"))).alias("key"))
    heads = docs.select("doc_id", F.xxhash64(F.lit("head"), F.substring(tidy(F.substring("text", 1, 8 * HEAD_CHARS)), 1, HEAD_CHARS)).alias("key"))
    known = stage(lines.unionByName(heads).join(wanted, "key", "left_semi").distinct(), "known")
    rare = known.groupBy("key").count().where(F.col("count") <= max(COMMON, COMMON_SHARE * docs.count())).select("key")
    met = stage(keys.join(known.join(rare, "key"), "key"), "met")
    best = met.groupBy("page_id", "doc_id").agg(F.countDistinct("node").alias("n")).groupBy("page_id").agg(F.max(F.struct("n", "doc_id")).alias("best"))
    best = best.select("page_id", "best.doc_id")
    good = met.join(best, ["page_id", "doc_id"]).select("page_id", "node").distinct()
    labels = defaultdict(set)
    for r in good.collect():
        labels[r["page_id"]].add(r["node"])
    return fit([(parse(r["html"]), labels[r["page_id"]]) for r in sample.collect() if labels[r["page_id"]]])


def fit(pages: list[tuple[list[Node], set[int]]]) -> tuple[dict[str, float], np.ndarray]:
    """Weights by logistic loss with prior means, edge potentials from smoothed counts, over labelled nodes that look different."""
    counted, edges = Counter(), defaultdict(Counter)
    looks = lambda nodes, i: tuple(sorted(node_features(nodes, i)))
    on_pages = Counter(f for nodes, _ in pages for f in {f for i in range(1, len(nodes)) if nodes[i].chars for f, _ in looks(nodes, i)})
    for nodes, good in pages:
        y = [False] * len(nodes)
        for i in good:
            while i >= 0 and not y[i]:
                y[i], i = True, nodes[i].parent
        for i in range(1, len(nodes)):
            if nodes[i].chars:
                up, own = nodes[i].parent, looks(nodes, i)
                edges[edge_kind(nodes, i), nodes[up].tag, nodes[up].names, nodes[i].tag, own][y[up], y[i]] += 1
                known = tuple(x for x in own if on_pages[x[0]] > 1 or len(pages) == 1)
                other = sum(prior_mean(f) * v for f, v in own if on_pages[f] == 1 and len(pages) > 1)
                counted[known, round(other, 2), y[i]] += 1
    edge = np.array(EDGES)
    for (kind, *_), found in edges.items():
        for (above, below), n in found.items():
            edge[kind, int(above), int(below)] += n / found.total() * (1 + np.log2(found.total()))
    edge = edge / edge.sum(axis=2, keepdims=True)
    names = sorted({f for known, _, _ in counted for f, _ in known})
    if not names:
        return {}, edge
    at = {f: k for k, f in enumerate(names)}
    x, other, y, n = np.zeros((len(counted), len(names))), np.zeros(len(counted)), np.zeros(len(counted)), np.zeros(len(counted))
    for i, ((known, more, label), times) in enumerate(sorted(counted.items())):
        other[i], y[i] = more, label
        alike = times + counted.get((known, more, not label), 0)
        n[i] = times / alike * (1 + np.log2(alike))
        for f, v in known:
            x[i, at[f]] += v
    mean = np.array([prior_mean(f) for f in names])
    firm = np.array([NAME_PRECISION if f.startswith("name:") else PRECISION for f in names])
    w = mean.copy()
    step = np.linalg.inv((x * n[:, None]).T @ x / 4 + np.diag(firm))  # of a bound of the curvature: steps never overshoot
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w + other, -30, 30)))
        w = w - step @ (x.T @ (n * (p - y)) + firm * (w - mean))
    return dict(zip(names, map(float, w))), edge


def html_extraction(pages: DataFrame, docs: DataFrame, bound: int = LABELLED_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`.

    Null and empty pages give an empty text. Repeated pages give equal texts.
    Unclosed, misnested and unknown markup is read as browsers mostly do.
    """
    weights, edge = train(pages, docs, bound)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights, edge) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
