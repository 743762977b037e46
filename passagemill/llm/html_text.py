"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element of block kind and every run of text between block boundaries is a node with
a hidden state, content or not. A node's potential is a weighted sum of its features (tag,
words of its class and id, share of link text, length, sentence marks); an edge's potential
depends on the states of parent and child and on whether the child is text. Messages pass
from the leaves to the root and back (sum-product), which is exact on a tree, and give each
node's marginal; text runs above one half are kept, in page order.

The potentials come from labelled pages, piece by piece: a node's is the log odds of a logistic
regression on its features, an edge's the log ratio of the joint frequency of both states to
the product of their own. Labelled pages are made from a bounded
sample of the table's own pages (``most_pages``): the texts of their article and of the
rest, which their markup tells apart, are set into layouts of many kinds (see ``layouts``),
so that the model learns common names of menus, notices, sidebars, adverts, forms and
comments and not one site's template. Inference covers every page, whole.

Defined results: a null or empty page has an empty text; unclosed and crossing tags, cut-off
pages and unknown elements are read as far as they go; a head ends where something comes that
cannot stand in it; ``svg``, ``select``, ``button``, ``noscript``, ``iframe``, ``template`` and the like end at their end tag or, if
they have none, at the next block; an inline element stays in its block's text whatever its class says; a quote
opens a value only after an equals sign; parsing takes time in proportion to the page, however deep it nests; character references are decoded,
also at the end; text within ``script``, ``style`` and the like never counts; rows that
repeat are extracted each on its own; extra columns are ignored. If no page gives an
example the model is trained on built-in sentences.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES, MOST_CHARS = 150, 20_000

# Elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist button textarea".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
ENDS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article main aside nav header footer form blockquote pre figure hr address fieldset".split())
SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG_GROUPS = {
    **{t: t for t in "article main section div p nav header footer aside form body table blockquote".split()},
    **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"), **dict.fromkeys("ul ol dl menu".split(), "list"),
    **dict.fromkeys("li dt dd".split(), "item"), **dict.fromkeys("tr td th tbody thead tfoot".split(), "cell"),
    **dict.fromkeys("pre figure figcaption address details summary".split(), "figure"), "dialog": "form", "html": "body", "#root": "body", "#text": "text",
}
#: Start tags at which a skipped element without an end tag is over.
BLOCKS = ENDS_P | frozenset(t for t in TAG_GROUPS if not t.startswith("#"))
#: The attribute that carries the labels of training pages; other pages are read without it.
LABEL = "data-passagemill-content"

# Words of class, id and role that name a part of a page.
HINTS = {
    "content": "article articlebody content post entry story body main text prose richtext markdown maincontent singlepost".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs sitemap topnav subnav dropdown skip skiplink".split(),
    "header": "header masthead topbar logo branding hero sitename".split(),
    "footer": "footer copyright legal colophon bottom imprint contentinfo".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail complementary more teaser latest".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense adslot dfp outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall signup disclaimer toast announcement".split(),
    "form": "search searchbox login signin register form contact".split(),
    "comment": "comment comments commentlist disqus respond reply replies discussion feedback reviews".split(),
    "social": "share sharing social follow byline meta tags tagcloud author bio".split(),
}
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words}
KINDS = list(HINTS)
GROUPS = [*dict.fromkeys(TAG_GROUPS.values()), "other"]
FEATURES = [*GROUPS, *(f"hint:{k}" for k in KINDS), "in content", "in boilerplate", "header in content", "links", "short", "middle", "long", "sentence", "sign", "bias"]
AT = {name: i for i, name in enumerate(FEATURES)}

# A quote opens a value only right after the equals sign; elsewhere in a tag it is a character like others.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z)))*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+))""")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("tag", "hints", "label", "parent", "children", "text", "links", "size", "link_size")

    def __init__(self, tag: str, parent: Node | None, hints: frozenset = frozenset(), label: int | None = None) -> None:
        self.tag, self.parent, self.hints, self.label = tag, parent, hints, label
        self.children: list[Node] = []
        self.text, self.links, self.size, self.link_size = "", 0, 0, 0
        if parent:
            parent.children.append(self)


def hints_of(raw: str, labels: bool = False) -> tuple[frozenset, int | None]:
    """Kinds named by class, id, role and label; and the training label, if ``labels`` are to be read."""
    kinds, label = set(), None
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in PARTS.findall(value):
                kind = HINT_OF.get(word.lower())
                if kind:
                    kinds.add(kind)
            kinds.update(HINT_OF[w] for w in re.split(r"[^a-z]+", value.lower()) if w in HINT_OF)
        elif labels and name == LABEL:
            label = int(value)
    return frozenset(kinds), label


def tokens(page: str) -> list[tuple]:
    """``start, end, closing, tag, attributes`` of the page's tags, in order; a raw element reaches to its end tag."""
    found, at, ends = [], 0, {}
    while True:
        token = TOKEN.search(page, at)
        if not token:
            return found
        at = token.end()
        tag = (token[2] or "").lower()
        if tag in RAW and not token[1]:
            end = ends.setdefault(tag, re.compile(rf"</{tag}\s*[^>]*>", re.I)).search(page, at)
            at = end.end() if end else len(page)
        found.append((token.start(), at, bool(token[1]), tag, token[3]))


def unclosed(marks: list[tuple]) -> set[int]:
    """Places of skipped elements without an end tag of their own; starts and ends of one kind are matched like brackets."""
    open_: dict[str, list[int]] = {}
    for start, _, closing, tag, _ in marks:
        if tag in SKIPPED and tag not in RAW and tag != "head":
            held = open_.setdefault(tag, [])
            if not closing:
                held.append(start)
            elif held:
                held.pop()
    return {start for held in open_.values() for start in held}


class Stack:
    """The open elements. Each question about them is answered from counts, not by a search."""

    def __init__(self, root: Node) -> None:
        self.items: list[tuple[str, Node]] = [("#root", root)]
        self.places: dict[str, list[int]] = {}  # the depths of the open elements of a tag
        self.blocks = [1]  # elements that are not inline, up to each depth
        self.walls: list[int] = []  # depths of tables and skipped elements, which a paragraph's end does not cross
        self.hidden: list[int] = []  # depths of skipped elements but the head
        self.doubtful: list[int] = []  # of these, the ones without an end tag
        self.marked: list[tuple[int, frozenset]] = []  # depths and kinds of inline elements that name a part of a page

    def push(self, tag: str, node: Node, doubtful: bool = False, marks: frozenset = frozenset()) -> None:
        depth = len(self.items)
        self.items.append((tag, node))
        self.places.setdefault(tag, []).append(depth)
        self.blocks.append(self.blocks[-1] + (tag not in INLINE))
        hides = tag in SKIPPED and tag != "head"
        for held, true in ((self.walls, hides or tag == "table"), (self.hidden, hides), (self.doubtful, doubtful)):
            if true:
                held.append(depth)
        if marks:
            self.marked.append((depth, marks))

    def depth(self, tag: str) -> int:
        """Of the innermost open element of this tag; 0 if there is none."""
        held = self.places.get(tag)
        return held[-1] if held else 0

    def cut(self, depth: int) -> None:
        for tag, _ in self.items[depth:]:
            self.places[tag].pop()
        del self.items[depth:], self.blocks[depth:]
        for held in (self.walls, self.hidden, self.doubtful):
            while held and held[-1] >= depth:
                held.pop()
        while self.marked and self.marked[-1][0] >= depth:
            self.marked.pop()


def parse(page: str, labels: bool = False) -> list[Node]:
    """Nodes in page order, parents before children; text runs are leaves with their white space collapsed.

    An inline element is part of its block's text whatever it is called; a run that lies in inline
    elements altogether takes the kinds of their names as its own.
    """
    marks = tokens(page)
    without_end = unclosed(marks)
    root = Node("#root", None)
    nodes, stack, pieces, at = [root], Stack(root), [], 0
    kinds: list[frozenset] = []  # of the inline names around each piece that is not blank
    link_chars = 0

    def close_run() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            leaf = Node("#text", stack.items[-1][1], frozenset().union(*kinds) if all(kinds) else frozenset())
            leaf.text, leaf.size, leaf.link_size = text, len(text), min(len(text), link_chars)
            nodes.append(leaf)
        pieces.clear()
        kinds.clear()
        link_chars = 0

    def pop_to(depth: int) -> None:
        if stack.blocks[-1] > stack.blocks[depth - 1]:
            close_run()
        stack.cut(depth)

    def leave_head() -> None:
        depth = stack.depth("head")
        if depth and not (stack.hidden and stack.hidden[-1] > depth):
            pop_to(depth)

    def say(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw)
            if text.strip():
                leave_head()
                kinds.append(stack.marked[-1][1] if stack.marked else frozenset())
            pieces.append(text)
            if stack.depth("a"):
                link_chars += len(text.strip())

    for start, end, closing, tag, attributes in marks:
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            depth = stack.depth(tag)
            if depth and not (tag in INLINE and stack.blocks[-1] > stack.blocks[depth]):
                pop_to(depth)
            continue
        if stack.doubtful and tag in BLOCKS:
            pop_to(stack.doubtful[0])
        if tag not in IN_HEAD:
            leave_head()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW or tag in VOID:
            if tag not in INLINE:
                close_run()
            continue
        if tag in ENDS_P:
            depth = stack.depth("p")
            if depth and not (stack.walls and stack.walls[-1] > depth):
                pop_to(depth)
        if tag in SAME_LEVEL:
            depth = stack.depth(tag)
            if depth and depth > max(map(stack.depth, SAME_LEVEL[tag])):
                pop_to(depth)
        hints, label = hints_of(attributes, labels) if attributes else (frozenset(), None)
        if tag in INLINE:
            stack.push(tag, stack.items[-1][1], marks=hints - {"content"})
        else:
            close_run()
            node = Node(tag, stack.items[-1][1], hints, label)
            nodes.append(node)
            stack.push(tag, node, doubtful=start in without_end)
    say(page[at:])
    close_run()
    hidden: set[int] = set()
    for node in nodes:
        if node.tag in SKIPPED or id(node.parent) in hidden:
            hidden.add(id(node))
    live = [node for node in nodes if id(node) not in hidden]
    for node in reversed(live):
        if node.parent:
            node.parent.size += node.size
            node.parent.link_size += node.link_size
    return [n for n in live if n.size or n.parent is None]


_TAG_AT = {tag: AT[group] for tag, group in TAG_GROUPS.items()}
_HINT_AT = {kind: AT[f"hint:{kind}"] for kind in KINDS}
_TOLD = [AT[name] for name in ("in content", "in boilerplate", "header in content", "links", "short", "middle", "long", "sentence", "sign", "bias")]


def facts(nodes: list[Node]) -> Iterator[list[tuple[int, float]]]:
    """For each node its features that are not zero: place and value."""
    content, boilerplate, header, links, short, middle, long, sentence, sign, bias = _TOLD
    inside: dict[int, tuple[bool, bool]] = {}
    for node in nodes:
        found = [(_TAG_AT.get(node.tag, AT["other"]), 1.0), (bias, 1.0)]
        found += [(_HINT_AT[kind], 1.0) for kind in node.hints]
        within = apart = False
        above = node.parent
        if above:
            before, apart = inside[id(above)]
            within = before or above.tag in ("article", "main") or "content" in above.hints
            apart = apart or above.tag in ("nav", "footer", "aside", "form") or bool(above.hints - {"content"}) or (above.tag == "header" and not before)
            apart = apart or (node.tag == "#text" and bool(node.hints))
        inside[id(node)] = within, apart
        if apart:
            found.append((boilerplate, 1.0))
        elif within:
            found.append((content, 1.0))
        if within and node.tag == "header":
            found.append((header, 1.0))
        if node.link_size:
            found.append((links, node.link_size / max(1, node.size)))
        if node.tag == "#text":
            found.append((short if node.size < 40 else middle if node.size < 160 else long, 1.0))
            if node.text[-1] in ".!?…。":
                found.append((sentence, 1.0))
            if "©" in node.text or "|" in node.text:
                found.append((sign, 1.0))
        yield found


def features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), len(FEATURES)))
    for row, found in zip(x, facts(nodes)):
        for place, value in found:
            row[place] = value
    return x


EDGE_KINDS = 3


def edge_kind(node: Node) -> int:
    """Of the edge to the parent: a text, a part that names itself something else than content, or a plain part."""
    if node.tag == "#text":
        return 0
    return 1 if node.hints - {"content"} or node.tag in ("nav", "header", "footer", "aside", "form") else 2


def log_sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


class TreeModel:
    """``weights`` of the features and ``edge[kind][parent state][child state]``, both as log potentials."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray) -> None:
        self.weights, self.edge = weights, edge

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node by one upward and one downward pass."""
        weights = self.weights.tolist()
        own = [sum(weights[place] * value for place, value in found) for found in facts(nodes)]
        place = {id(node): i for i, node in enumerate(nodes)}
        parent = [place[id(node.parent)] if node.parent else -1 for node in nodes]
        # Plain numbers: a page's nodes are visited one by one, where array operations on two values only cost time.
        edges = [self.edge[edge_kind(node)].ravel().tolist() for node in nodes]
        n = len(nodes)
        below0, below1, up0, up1 = [0.0] * n, list(own), [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            e, b0, b1, up = edges[i], below0[i], below1[i], parent[i]
            up0[i], up1[i] = log_sum(e[0] + b0, e[1] + b1), log_sum(e[2] + b0, e[3] + b1)
            below0[up] += up0[i]
            below1[up] += up1[i]
        full0, full1 = list(below0), list(below1)
        for i in range(1, n):
            e, up = edges[i], parent[i]
            rest0, rest1 = full0[up] - up0[i], full1[up] - up1[i]
            full0[i] += log_sum(e[0] + rest0, e[2] + rest1)
            full1[i] += log_sum(e[1] + rest0, e[3] + rest1)
        return 1 / (1 + np.exp(np.clip(np.subtract(full0, full1), -500, 500)))

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        p = self.marginals(nodes)
        return "\n".join(node.text for node, at in zip(nodes, p) if node.tag == "#text" and at >= 0.5)


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a page whose elements carry ``LABEL``, and their states: a text's nearest label, an element's larger part."""
    nodes = parse(page, labels=True)
    y, good = np.zeros(len(nodes), int), {}
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            up = node.parent
            while up is not None and up.label is None:
                up = up.parent
            y[i] = up.label if up else 0
            good[id(node)] = node.size * y[i]
        else:
            y[i] = int(2 * good.get(id(node), 0) >= max(1, node.size))
        if node.parent:
            good[id(node.parent)] = good.get(id(node.parent), 0) + good[id(node)] if id(node) in good else good.get(id(node.parent), 0)
    return nodes, y


def fit(pages: list[str], rounds: int = 12, ridge: float = 1.0, smooth: float = 2.0) -> TreeModel:
    """Node potentials by logistic regression on the features (Newton steps); edge potentials log P(p, c) / (P(p) P(c))."""
    xs, ys, pairs = [], [], np.full((EDGE_KINDS, 2, 2), smooth)
    for page in pages:
        nodes, y = labelled(page)
        place = {id(n): i for i, n in enumerate(nodes)}
        xs.append(features(nodes))
        ys.append(y)
        for n in nodes:
            if n.parent:
                pairs[edge_kind(n), y[place[id(n.parent)]], y[place[id(n)]]] += 1
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
    joint = pairs / pairs.sum((1, 2), keepdims=True)
    edge = np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))
    return TreeModel(w, edge)


ANY_TEXT = [f"{a} {b} near the {c} and stayed there until the evening." for a in ("A traveller", "The old guide", "Their neighbour") for b in ("walked", "waited", "rested") for c in ("river", "gate", "mill")]
SHORT = "Home,About us,Contact,Latest news,Read more,Sign in,Privacy,Terms of use,Archive,Top stories".split(",")


def layouts(articles: list[list[str]], rest: list[str], seed: int, copies: int = 2) -> list[str]:
    """Labelled pages: article blocks among boilerplate, in markup drawn from common layouts."""
    draw = random.Random(seed)
    pick = lambda kind: draw.choice(HINTS[kind])
    mark = lambda kind: f'{draw.choice(["class", "id"])}="{draw.choice(["", "site-", "page-", "c-"])}{pick(kind)}{draw.choice(["", "-box", "-wrap", "-1", " clearfix"])}"'
    esc = html.escape
    pages = []
    for blocks in articles * copies:
        other = lambda n=1: " ".join(draw.choice(rest) for _ in range(n))
        links = lambda: "<ul>" + "".join(f'<li><a href="#">{esc(draw.choice(SHORT + other().split()[:3]))}</a></li>' for _ in range(draw.randint(2, 7))) + "</ul>"
        par = lambda t: f"<p>{esc(t)}</p>"
        drops = {
            "menu": lambda: draw.choice([f"<nav>{links()}</nav>", f"<div {mark('menu')}>{links()}</div>", f"<ul {mark('menu')}><li><a href='#'>{esc(draw.choice(SHORT))}</a></li></ul>"]),
            "header": lambda: draw.choice([f"<header>{esc(other())}</header>", f"<header><div {mark('header')}><h1>{esc(draw.choice(SHORT))}</h1></div>{links()}</header>", f"<div {mark('header')}>{esc(other())}</div>"]),
            "footer": lambda: draw.choice([f"<footer>&copy; {esc(other())}</footer>", f"<footer>{par(other())}{links()}</footer>", f"<div {mark('footer')}>{par(other())}</div>"]),
            "side": lambda: draw.choice([f"<aside>{par(other(2))}</aside>", f"<aside {mark('side')}><h3>{esc(draw.choice(SHORT))}</h3>{links()}</aside>", f"<div {mark('side')}><h2>{esc(draw.choice(SHORT))}</h2>{par(other(2))}</div>"]),
            "advert": lambda: draw.choice([f"<div {mark('advert')}>{esc(other())}</div>", f"<section {mark('advert')}>{par(other(2))}</section>", f"<aside {mark('advert')}>{esc(other())}</aside>"]),
            "notice": lambda: draw.choice([f"<div {mark('notice')}>{par(other())}</div>", f"<section {mark('notice')}>{esc(other())}<a href='#'>OK</a></section>", f"<p {mark('notice')}>{esc(other())}</p>"]),
            "form": lambda: f"<form {draw.choice(['', mark('form')])}><label>{esc(draw.choice(SHORT))}</label>{par(other())}<input></form>",
            "comment": lambda: draw.choice(["section", "div", "ol"]).join([f"<", f" {mark('comment')}><h3>{esc(draw.choice(SHORT))}</h3>" + "".join(f"<div class='{draw.choice(['reply', 'item', 'comment-body', 'c'])}'>{par(other(2))}</div>" for _ in range(draw.randint(1, 4))) + "</", ">"]),
            "social": lambda: f"<div {mark('social')}>{links()}</div>",
        }
        bad = lambda kinds: "".join(drops[k]().replace(">", f' {LABEL}="0">', 1) for k in kinds if draw.random() < 0.6)
        inner = [draw.choice([f"<h1>{esc(blocks[0])}</h1>", f"<header><h1>{esc(blocks[0])}</h1></header>", f"<h2>{esc(blocks[0])}</h2>"])]
        for block in blocks[1:]:
            inner.append(draw.choice([par(block)] * 6 + [f"<div>{esc(block)}</div>", f"<blockquote>{par(block)}</blockquote>", f"<ul><li>{esc(block)}</li></ul>", f"<h2>{esc(' '.join(block.split()[:5]))}</h2>", f'<p>{esc(block)} <a href="#">{esc(block[:20])}</a></p>']))
            if draw.random() < 0.08:
                inner.append(bad([draw.choice(["advert", "side", "notice", "social"])]))
        one = f"{LABEL}='1'"
        root = draw.choice([f"<article {one}>{{}}</article>"] * 3 + [f"<div {one} {mark('content')}>{{}}</div>", f"<main {one}>{{}}</main>", f"<main><article {one}>{{}}</article></main>", f"<section {one} {mark('content')}>{{}}</section>", f"<div {one}>{{}}</div>"])
        core = root.format("".join(inner) + (bad(["comment", "social"]) if draw.random() < 0.3 else ""))
        wrap = draw.choice(["{}", "{}", "<div class='wrapper'>{}</div>", "<div id='page'><div class='row'>{}</div></div>"])
        before, after = bad(["notice", "header", "menu", "advert", "form"]), bad(["side", "advert", "comment", "menu", "form", "footer"])
        pages.append("<html><body>" + wrap.format(before + core + after) + "</body></html>")
    return pages


def training_texts(pages: list[str]) -> tuple[list[list[str]], list[str]]:
    """Blocks of the articles that pages mark as such, and the texts that stand outside of them."""
    articles, rest = [], []
    for page in pages:
        blocks = []
        for node in parse(page):
            if node.tag != "#text":
                continue
            up = node.parent
            while up is not None and up.tag not in ("article", "nav", "footer", "aside", "header"):
                up = up.parent
            if up is not None and up.tag == "article":
                blocks.append(node.text)
            else:
                rest.append(node.text)
        if blocks:
            articles.append(blocks)
    return articles or [ANY_TEXT[i : i + 5] for i in range(0, len(ANY_TEXT), 5)], rest or SHORT


def trained(pages: DataFrame, html_col: str = "html", most_pages: int = MOST_PAGES, seed: int = 7, most_chars: int = MOST_CHARS) -> TreeModel:
    """A model from layouts over a sample: of the pages of at most ``most_chars`` characters the ``most_pages`` with the smallest hashes.

    Both bounds hold for the sample alone, which comes to the driver; longer pages are extracted like all others.
    """
    fit_size = pages.where((F.length(html_col) > 0) & (F.length(html_col) <= most_chars)).select(F.col(html_col).alias("html"))
    # Hashes are sorted and not pages, so that no task sends more than `most_pages` numbers.
    least = [r["h"] for r in fit_size.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(most_pages).collect()]
    picked = fit_size.where(F.xxhash64("html").isin(least)).distinct() if least else fit_size.limit(0)
    sample = sorted(r["html"] for r in picked.collect())
    return fit(layouts(*training_texts(sample), seed))


def main_text(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.extract(page.as_py()) for page in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
