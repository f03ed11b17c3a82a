"""Main text of HTML pages by a tree-structured graphical model.

Every element of the page is a node that is content or not. A node potential
comes from its tag, its class and id words and its link share, an edge
potential from the labels of parent and child. Sum-product messages go up from
the leaves and down from the root and give each node its content marginal; the
text of content nodes is the main text.

The potentials are counted on labelled pages by one distributed aggregate: a
page whose markup names its main part (exactly one ``article`` or ``main``
element) labels its own nodes. The features never say whether a node lies in
such an element, so that the tree model has to carry it down, and pages without
one are read by the same model.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import text_of
from cohortwise.session import materialize

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "textarea", "svg", "canvas", "object", "title"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))
APART = frozenset("nav header footer aside form button select dialog menu script style template noscript iframe textarea svg canvas object title head".split())
APART_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice cookie cookies consent popup modal newsletter subscribe share social related comment comments reply replies disqus form login search widget".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Smoothing of the counted potentials, and the marginal from which a node is content.
PRIOR = 0.5
CONTENT = 0.5
# Counted features that every task holds; the rest is joined to the pages that have them. It changes the cost, never the result.
HELD = 20_000
# Potentials: of an element that is set apart, of a label that markup rules out, and the most that one node's features say.
APART_LOG = -1000.0
NEVER_LOG = -30.0
MOST_LOG = 6.0
# Edges of a page that names no main part: (to not content, to content) from either parent.
LOOSE = [[math.log(0.9), math.log(0.1)], [math.log(0.1), math.log(0.9)]]


class Node:
    __slots__ = ("tag", "words", "names", "parent", "children", "chars", "link", "role")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.words = tuple(w for name in names for w in re.findall(r"[a-z]+", name))
        self.children: list[int] = []
        self.chars = self.link = 0
        self.role = 0


class Dom(HTMLParser):
    """Nodes in page order and the runs of text as (node, text, block break before)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", (), -1)]
        self.open = [0]
        self.runs: list[tuple[int, str]] = []
        self.breaks: set[int] = set()  # runs before which a block begins

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_p()
        for t in CLOSED_BY.get(tag, ()):
            self._close(t, stop=("ul", "ol", "dl", "table", "select"))
        names = tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split())
        me = len(self.nodes)
        self.nodes.append(Node(tag, names, self.open[-1]))
        self.nodes[self.open[-1]].children.append(me)
        if tag not in INLINE and tag != "br":
            self.breaks.add(len(self.runs))
        if tag not in VOID:
            self.open.append(me)
        if tag == "br":
            self.handle_data(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close(tag)

    def _close_p(self):
        self._close("p", stop=("table", "td", "th", "button", "object"))

    def _close(self, tag, stop=()):
        for k in range(len(self.open) - 1, 0, -1):
            t = self.nodes[self.open[k]].tag
            if t == tag:
                if any(self.nodes[n].tag not in INLINE for n in self.open[k:]):
                    self.breaks.add(len(self.runs))
                # An inline element left open goes on after its block, as browsers do it; it has no bearing on the text.
                del self.open[k:]
                return
            if t in stop:
                return

    def handle_data(self, data):
        if data:
            self.runs.append((self.open[-1], data))


def parse(html: str) -> Dom:
    dom = Dom()
    dom.feed(html)
    rest = dom.rawdata
    dom.close()
    # A page cut off inside a reference still ends with it as text; one cut off inside a tag loses that tag.
    if rest and not dom.runs and "<" not in rest:
        dom.handle_data(unescape(rest))
    for at, data in dom.runs:
        dom.nodes[at].chars += len(data.strip())
    # Children come after their parents, so one pass backwards adds up whole subtrees, however deep. Text of a link counts once.
    for node in reversed(dom.nodes):
        if node.tag == "a":
            node.link = node.chars
        if node.parent >= 0:
            up = dom.nodes[node.parent]
            up.chars += node.chars
            up.link += node.link
    return dom


def features(node: Node) -> tuple[str, ...]:
    links = node.link / node.chars if node.chars else 0.0
    return (f"tag={node.tag}", f"links={'none' if not node.link else 'some' if links < 0.5 else 'most'}", *[f"word={w}" for w in dict.fromkeys(node.words)])


def apart(node: Node) -> bool:
    """Whether HTML's own terms, or a whole name of the usual ones, set the element apart; compound names are left to the potentials."""
    return node.tag in APART or node.tag not in WHOLE and any(w in APART_WORDS for w in node.names)


def edge_kind(node: Node) -> str:
    return "main" if node.tag in MAIN else "apart" if apart(node) else ""


def own_labels(dom: Dom) -> list[int] | None:
    """1 for content, 0 for not, by the page's own markup; None when it does not name one main part."""
    mains = [i for i, n in enumerate(dom.nodes) if n.tag in MAIN and not any(dom.nodes[p].tag in MAIN for p in _above(dom, i))]
    if len(mains) != 1:
        return None
    out = [0] * len(dom.nodes)
    for i in range(1, len(dom.nodes)):
        n = dom.nodes[i]
        out[i] = int(not apart(n) and (i == mains[0] or out[n.parent] == 1))
    return out


def _above(dom: Dom, i: int) -> Iterator[int]:
    while (i := dom.nodes[i].parent) >= 0:
        yield i


def page_counts(html: str) -> Counter:
    """Counts of a labelled page: (kind, feature, label of the parent, label)."""
    dom = parse(html)
    labels = own_labels(dom)
    counts: Counter = Counter()
    if labels is None:
        return counts
    for i, node in enumerate(dom.nodes[1:], 1):
        y = labels[i]
        counts["edge", edge_kind(node), labels[node.parent], y] += 1
        for f in features(node):
            counts["node", f, 0, y] += 1
    return counts


class TreeModel:
    """Potentials from counts; marginals by messages up and down the tree.

    ``rest``, if any, is a table (f, c0, c1) of the node features that ``rows``
    leaves out; ``size`` and ``total`` then count those too. It stays with the driver.
    """

    def __init__(self, rows: list[tuple[str, str, int, int, int]], size: int | None = None, total: list[float] | None = None, rest: DataFrame | None = None):
        node: dict[str, list[float]] = {}
        edge: dict[str, list[list[float]]] = {}
        tags = [0.0, 0.0]
        for kind, f, parent, y, n in rows:
            if kind == "node":
                node.setdefault(f, [0.0, 0.0])[y] += n
                if f.startswith("tag="):
                    tags[y] += n
            else:
                edge.setdefault(f, [[0.0, 0.0], [0.0, 0.0]])[parent][y] += n
        self.size, self.total, self.rest = max(1, len(node)) if size is None else max(1, size), tags if total is None else total, rest
        self.node = {f: self.potential(c) for f, c in node.items()}
        self.edge = {f: [[math.log((e[p][y] + PRIOR) / (sum(e[p]) + 2 * PRIOR)) for y in (0, 1)] for p in (0, 1)] for f, e in edge.items()}
        for e in self.edge.values():  # transitions that no labelled page shows are ruled out, whatever the number of pages
            for p in (0, 1):
                e[p] = [max(NEVER_LOG, v) if v > -7 else NEVER_LOG for v in e[p]]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    def potential(self, c) -> tuple[float, ...]:
        # A feature speaks by how much likelier it is in one class; the share of the classes is in the edges.
        return tuple(math.log((c[y] + PRIOR) / (self.total[y] + PRIOR * self.size)) for y in (0, 1))

    def marginals(self, dom: Dom, more: dict[str, tuple[float, ...]] | None = None) -> list[float]:
        known = ChainMap(self.node, more) if more else self.node
        n = len(dom.nodes)
        local, pair = [], []
        named = any(node.tag in MAIN for node in dom.nodes)
        for i, node in enumerate(dom.nodes):
            if not i:
                a = [0.0, APART_LOG]  # the page as a whole is not content
            elif apart(node):
                a = [0.0, APART_LOG]
            else:
                got = [known[f] for f in features(node) if f in known]
                odds = sum(g[1] - g[0] for g in got)
                a = [0.0, min(MOST_LOG, max(-MOST_LOG, odds))]
            kind = edge_kind(node)
            local.append(a)
            pair.append(self.edge.get(kind, LOOSE) if named or kind else LOOSE)
        up = [a[:] for a in local]  # children come after their parent: backwards is upwards
        sent: list[list[float]] = [[0.0, 0.0]] * n
        for i in range(n - 1, 0, -1):
            sent[i] = [_lse(pair[i][p][0] + up[i][0], pair[i][p][1] + up[i][1]) for p in (0, 1)]
            to = up[dom.nodes[i].parent]
            to[0] += sent[i][0]
            to[1] += sent[i][1]
        full = [up[0]] + [None] * (n - 1)
        for i in range(1, n):
            above = full[dom.nodes[i].parent]
            rest = [above[p] - sent[i][p] for p in (0, 1)]
            full[i] = [up[i][y] + _lse(rest[0] + pair[i][0][y], rest[1] + pair[i][1][y]) for y in (0, 1)]
        return [1 / (1 + math.exp(min(700.0, max(-700.0, f[0] - f[1])))) for f in full]


def _lse(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


def main_text(html: str, model: TreeModel, more: dict[str, tuple[float, ...]] | None = None) -> str:
    """Blocks of the content nodes in page order, one per line, white space made one blank."""
    dom = parse(html)
    marginal = model.marginals(dom, more)
    blocks, run = [], []
    for k, (at, data) in enumerate(dom.runs):
        if k in dom.breaks and run:
            blocks.append("".join(run))
            run = []
        node = dom.nodes[at]
        if marginal[at] >= CONTENT and node.tag not in RAW:
            run.append(data)
    blocks.append("".join(run))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def learn(pages: DataFrame, html: str = "html", held: int = HELD) -> TreeModel:
    """Potentials counted over all labelled pages; the ``held`` most frequent features come back, the rest stays a table."""
    def table(counts: Counter) -> pd.DataFrame:
        rows = [(*k, n) for k, n in counts.items()]
        return pd.DataFrame(rows, columns=["kind", "f", "parent", "y", "n"]).astype({"kind": str, "f": str, "parent": "int32", "y": "int32", "n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for h in b["h"]:
                counts.update(page_counts(h))
                if len(counts) > 10 * HELD:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    got = pages.select(text_of(html).alias("h")).mapInPandas(run, "kind string, f string, parent int, y int, n long")
    cells = [(p, y) for p in (0, 1) for y in (0, 1)]
    summed = got.groupBy("kind", "f").agg(*[F.sum(F.when((F.col("parent") == p) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}") for p, y in cells])
    summed = materialize(summed, "page_counts")
    node = summed.where("kind = 'node'").select("f", F.col("n00").alias("c0"), F.col("n01").alias("c1"), (F.col("n00") + F.col("n01")).alias("n"))
    tag = F.col("f").startswith("tag=")
    size, *total = node.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.when(tag, F.col(c))), F.lit(0)) for c in ("c0", "c1")]).first()
    common = node.orderBy(F.col("n").desc(), "f").limit(held).collect()
    rows = [("edge", r.f, p, y, r[f"n{p}{y}"]) for r in summed.where("kind = 'edge'").collect() for p, y in cells]
    rows += [("node", r.f, 0, y, r[f"c{y}"]) for r in common for y in (0, 1)]
    rest = node.where((F.col("n") < common[-1].n) | (F.col("n") == common[-1].n) & (F.col("f") > common[-1].f)).drop("n") if size > len(common) else None
    return TreeModel(rows, size, [float(v) for v in total], rest)


def _with_rest(src: DataFrame, model: TreeModel) -> DataFrame:
    """``src`` with __f, __c0, __c1: the features of each page that the model does not hold, and their counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(k, f) for k, h in zip(b["__key"], b["__h"]) for f in {f for n in parse(h).nodes[1:] for f in features(n)} if f not in model.node]
            yield pd.DataFrame(own, columns=["__key", "f"]).astype(str)

    keyed = src.withColumn("__key", F.sha2(F.col("__h").cast("binary"), 256))  # equal pages share their features
    own = keyed.select("__key", "__h").mapInPandas(run, "__key string, f string").distinct()
    found = own.join(model.rest, "f").groupBy("__key").agg(F.collect_list(F.struct("f", "c0", "c1")).alias("r"))
    return keyed.join(found.select("__key", *[F.col(f"r.{c}").alias(f"__{c}") for c in ("f", "c0", "c1")]), "__key", "left").drop("__key")


def extract(pages: DataFrame, html: str = "html", model: TreeModel | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html.

    A null or blank page, and one without content nodes, gives an empty text.
    Repeated rows stay repeated; columns of the two names are replaced.
    """
    model = model or learn(pages, html)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    src = pages.select(*keep, text_of(html).alias("__h"))
    if model.rest is not None:
        src = _with_rest(src, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            more = [{} if f is None else {w: model.potential(c) for w, *c in zip(f, c0, c1)} for f, c0, c1 in zip(b["__f"], b["__c0"], b["__c1"])] if "__f" in b else [None] * len(b)
            out["text"] = [main_text(h, model, m) if h else "" for h, m in zip(b["__h"], more)]
            out["n_chars"] = out["text"].str.len().astype("int64")
            yield out

    return src.mapInPandas(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
