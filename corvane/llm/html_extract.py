"""Main-text extraction by minimum cut (operator 5).

A page becomes its blocks of text in order. A linear classifier on each block's length,
link density, form and surrounding elements gives the probability of content, and the
negative logarithms of it and of its complement become the capacities to the two
terminals. Neighbouring blocks and blocks close to each other in the element tree are
joined by smoothness edges. The minimum cut, found by maximum flow, separates content
from boilerplate: a short line inside an article stays with it, a long notice between
menus goes with them. A block whose terminal outweighs all its edges has that label in
any minimum cut, so such blocks are settled first; flow runs on the rest.

What the surrounding elements say is one feature, bounded on both sides: the elements and
names of navigation, adverts, comments and the like against, those of articles for. A name
is that of an element's role only if the element is no wrapper of the page: one that holds
the article says nothing, and where nearly all prose of a page lies in named boilerplate,
the outermost element with most of it is taken as a wrapper, until some prose is outside.
The classifier's weights are fixed, documented values below: the pages have no labels.

Scale: one pass, no shuffle; memory is that of a page. Null html is empty and gives an
empty text; truncated tags, comments and raw elements end with the page. Repeated rows
are extracted each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch

# Element names by role.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILERPLATE_ELEMENTS = {"nav": -4.0, "footer": -4.0, "aside": -4.0, "menu": -4.0, "dialog": -4.0, "search": -4.0, "form": -3.0, "fieldset": -3.0, "header": -3.0, "address": -2.0}
CONTENT_ELEMENTS = {"article", "main"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "reply", "replies", "discussion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "subscribe", "subscription", "newsletter", "signup", "login", "popup", "modal", "overlay",
    "copyright", "legal", "disclaimer", "pagination", "pager", "tags", "taglist", "search", "skip", "outbrain", "taboola", "complementary", "contentinfo",
}
#: Names of lists of other people's or other pages' texts: they may hold articles of their own.
OTHERS_WORDS = {"comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "related", "recommended"}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "body", "main", "text", "articlebody"}
#: A name with one of these says that something else is there, or is not.
NEGATIONS = {"with", "has", "have", "no", "not", "non", "without", "none", "off", "offset", "below", "above"}
#: Parts that say where or which, not what; the last other part of a name is what it is.
PLACES = {"left", "right", "top", "bottom", "inner", "outer", "wrap", "wrapper", "container", "box", "area", "list", "item", "block", "section", "slot", "bar", "main", "primary", "secondary", "mobile", "desktop", "sm", "md", "lg"}

# The classifier's weights, as log-odds of content.
BIAS, LINKS, LENGTH, AVERAGE_LENGTH = -0.5, -4.0, 0.8, 3.3
LENGTH_RANGE, SURROUNDINGS_RANGE = (-0.8, 2.0), (-5.0, 2.5)
ROLE, MODIFIER, HIDDEN, ARTICLE, CONTENT_NAME = -4.0, -3.5, -5.0, 2.5, 1.5
BLOCK_TAGS = {"h1": 3.0, "li": 1.2, "h2": 0.5, "h3": 0.5, "h4": 0.5, "h5": 0.5, "h6": 0.5, "figcaption": 0.5, "blockquote": 0.5, "pre": 0.5, "p": 0.5, "td": 0.5, "dd": 0.5}
SENTENCE, NOTICE = 0.7, -4.0
#: Smoothness: of page neighbours, by their distance in the tree, and of blocks under one parent; the share that is left across the edge of named boilerplate.
NEIGHBOURS, SIBLINGS, ACROSS, FAR = 4.0, 0.5, 0.4, 64
#: Prose outside of named boilerplate that a page has at least, as a share; under it, names are those of wrappers.
OUTSIDE = 0.1
#: For comments and the like, which may be longer than their article, this many characters are enough.
FEW = 100

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|</?\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMING = {"class", "id", "role", "itemprop"}
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What an open element is closed by, when its end tag is left out.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "menu", "table", "body", "html", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form", "blockquote"}


class Element:
    """An element, what it alone says of its texts, and the prose in it."""

    __slots__ = ("depth", "others", "own", "parent", "prose", "score", "tag", "within", "wraps")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.within = bool(parent) and (parent.within or parent.tag in CONTENT_ELEMENTS)
        self.own, self.others = own_score(tag, attributes, self.within) if parent else (0.0, False)
        self.prose, self.score, self.wraps = 0, 0.0, False


def names_score(names: str, within: bool) -> tuple[float, bool]:
    """What the names of an element say, and whether they are of comments and the like."""
    against, for_, others = 0.0, 0.0, False
    for name in names.split():
        parts = [w.lower() for w in PART.findall(name)]
        if NEGATIONS.intersection(parts):
            continue
        what = [w for w in parts if w not in PLACES] or parts
        if what and what[-1] == "header" and (within or CONTENT_WORDS.intersection(parts)):
            continue  # an article's own head
        if what and (what[-1] in BOILERPLATE_WORDS or OTHERS_WORDS.intersection(what)):
            against = min(against, ROLE)
        elif BOILERPLATE_WORDS.intersection(what):
            against = min(against, MODIFIER)
        elif CONTENT_WORDS.intersection(parts):
            for_ = CONTENT_NAME
        others |= bool(OTHERS_WORDS.intersection(what))
    return against or for_, others


def own_score(tag: str, attributes: str, within: bool) -> tuple[float, bool]:
    """What an element's tag and attributes say, and whether it holds comments, other pages' texts or the like."""
    score = 0.0 if tag == "header" and within else BOILERPLATE_ELEMENTS.get(tag, 0.0)
    others = tag in ("nav", "aside", "footer")
    if attributes:
        names = []
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in NAMING:
                names.append(value)
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "class" and "hidden" in value.lower().split()) or (key == "style" and "display:none" in value.lower().replace(" ", "")):
                score = min(score, HIDDEN)
        if tag not in ("body", "html", "h1"):
            said, named_others = names_score(" ".join(names), within)
            others |= named_others
            score = min(score, said) if said < 0 or score < 0 else said
    if tag in CONTENT_ELEMENTS and score >= 0:
        score = ARTICLE
    return score, others


def outermost(top: Element, children: dict[int, list[Element]]) -> list[Element]:
    """The elements below ``top`` that say boilerplate, with none around them that does."""
    found, todo = [], list(children.get(id(top), ()))
    while todo:
        e = todo.pop()
        if e.own < 0:
            found.append(e)
        else:
            todo += children.get(id(e), ())
    return found


def settle(elements: list[Element]) -> None:
    """The score of each element, with all around it; elements come after their parents.

    An element that says boilerplate overrules what is around it; one that says content adds."""
    children: dict[int, list[Element]] = {}
    for e in reversed(elements):
        if e.parent:
            children.setdefault(id(e.parent), []).append(e)
            e.parent.prose += e.prose
            main = e.wraps or (e.tag in CONTENT_ELEMENTS and e.own > 0)
            e.parent.wraps |= main and not e.others
    for e in elements:
        if e.own < 0 and e.wraps and not e.others:
            e.own = 0.0
    total, found = elements[0].prose, outermost(elements[0], children)
    named, widest = sum(e.prose for e in found), [(-e.prose, i, e) for i, e in enumerate(found)]
    heapq.heapify(widest)
    while widest:
        _, _, e = widest[0]
        if e.prose * 2 < total or total - named >= min(OUTSIDE * total, FEW if e.others else total):
            break
        heapq.heappop(widest)
        e.own = 0.0
        inner = outermost(e, children)
        named += sum(x.prose for x in inner) - e.prose
        for x in inner:
            heapq.heappush(widest, (-x.prose, id(x), x))
    low, high = SURROUNDINGS_RANGE
    for e in elements:
        above = e.parent.score if e.parent else 0.0
        if e.own < 0:
            e.score = min(above, max(low, e.own))
        else:
            e.score = min(high, above + e.own) if above >= 0 else above


def blocks(html: str) -> list[tuple[str, Element, float]]:
    """(text, innermost element, share of the text in links) of each block, in page order."""
    root = top = Element("html", None, "")
    elements = [root]
    out: list[tuple[str, Element, float]] = []
    parts: list[str] = []
    linked = size = at = 0
    in_link = in_head = False

    def close() -> None:
        nonlocal parts, linked, size
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, top, linked / max(1, size)))
                top.prose += size - linked
        parts, linked, size = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, size
        if text and not in_head:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            n = len(text.strip())
            size += n
            linked += n * in_link

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if tag in RAW and not ends:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not ends
        elif tag in BLOCK:
            close()
            in_link = False
            if tag == "head":
                in_head = not ends
            elif tag == "body":
                in_head = False
            if ends:
                node = top
                while node is not root and node.tag != tag:
                    node = node.parent
                if node is not root:
                    top = node.parent
            elif tag not in VOID and tag not in ("html", "head"):
                in_head = False
                closes = CLOSES.get(tag, {"p"})
                node, found = top, None
                while node is not root and node.tag not in HOLDS:
                    if node.tag in closes:
                        found = node
                    node = node.parent
                top = Element(tag, found.parent if found else top, m[3] or m[6] or "")
                elements.append(top)
    add(html[at:])
    close()
    settle(elements)
    return out


def content_score(text: str, node: Element, links: float) -> float:
    """The fixed linear classifier: log-odds of content."""
    score = node.score + BIAS + LINKS * links
    score += min(LENGTH_RANGE[1], max(LENGTH_RANGE[0], LENGTH * (math.log(len(text)) - AVERAGE_LENGTH)))
    score += BLOCK_TAGS.get(node.tag, 0.0)
    if text[-1] in ".!?…:\"”»":
        score += SENTENCE
    if text[0] == "©" or text[:9].lower() == "copyright":
        score += NOTICE
    return score


def tree_distance(a: Element, b: Element) -> int:
    """Steps from one to the other, FAR at most: beyond that blocks hardly hold together."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(nodes: list[Element]) -> list[dict[int, float]]:
    """Edges between neighbours, and between each block and the one before under the same parent."""
    edges: list[dict[int, float]] = [{} for _ in nodes]
    last: dict[int, int] = {}
    for i, node in enumerate(nodes):
        near = {}
        if i:
            near[i - 1] = NEIGHBOURS / (1 + tree_distance(node, nodes[i - 1]))
        parent = id(node.parent)
        if parent in last:
            j = last[parent]
            near[j] = near.get(j, 0) + SIBLINGS
        last[parent] = i
        for j, w in near.items():
            edges[i][j] = edges[j][i] = w * (ACROSS if (node.score < 0) != (nodes[j].score < 0) else 1)
    return edges


def minimum_cut(to_content: list[float], to_boilerplate: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut (ties: as few as possible)."""
    n = len(to_content)
    net = [a - b for a, b in zip(to_content, to_boilerplate, strict=True)]
    label: list[bool | None] = [None] * n
    weight = [sum(e.values()) for e in edges]
    todo = [i for i in range(n) if abs(net[i]) > weight[i]]
    while todo:  # a terminal that outweighs all edges decides; its neighbours then gain or lose
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = net[i] > 0
        for j, w in edges[i].items():
            if label[j] is None:
                net[j] += w if label[i] else -w
                weight[j] -= w
                if abs(net[j]) > weight[j]:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in content_side(rest, net, [{j: w for j, w in edges[i].items() if label[j] is None} for i in range(n)]):
            label[i] = True
    return [bool(x) for x in label]


def content_side(rest: list[int], net: list[float], capacity: list[dict[int, float]]) -> set[int]:
    """Dinic's maximum flow from the nodes with content left over to those with boilerplate; what the source still reaches."""
    source = {i: net[i] for i in rest if net[i] > 0}
    sink = {i: -net[i] for i in rest if net[i] < 0}
    tiny = 1e-12
    while True:
        level = {i: 0 for i, c in source.items() if c > tiny}
        queue, ends = deque(level), False
        while queue:
            i = queue.popleft()
            ends |= sink.get(i, 0) > tiny
            for j, c in capacity[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return set(level)
        after = {i: list(capacity[i]) for i in level}
        for s in [i for i, c in source.items() if c > tiny]:
            path = [s]
            while path and source[s] > tiny:
                i = path[-1]
                if sink.get(i, 0) > tiny:
                    flow = min(source[s], sink[i], *(capacity[a][b] for a, b in zip(path, path[1:], strict=False)))
                    source[s] -= flow
                    sink[i] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        capacity[a][b] -= flow
                        capacity[b][a] += flow
                    keep = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if capacity[a][b] <= tiny), len(path) - 1)
                    path = path[: keep + 1]
                    continue
                nxt = None
                while after[i]:  # an edge stays until it leads nowhere
                    j = after[i][-1]
                    if capacity[i][j] > tiny and level.get(j) == level[i] + 1:
                        nxt = j
                        break
                    after[i].pop()
                if nxt is not None:
                    path.append(nxt)
                else:
                    path.pop()
                    if path:
                        after[path[-1]].pop()


def labels(found: list[tuple[str, Element, float]]) -> tuple[list[bool], list[bool]]:
    """Which blocks are content: by the cut, and by the classifier alone."""
    scores = [content_score(*b) for b in found]
    # -log(1 - p) and -log(p) of the logistic function.
    to_content, to_boilerplate = [math.log1p(math.exp(x)) for x in scores], [math.log1p(math.exp(-x)) for x in scores]
    return minimum_cut(to_content, to_boilerplate, smoothness([node for _, node, _ in found])), [x > 0 for x in scores]


def extract(html: str) -> str:
    """The main text: content blocks in page order, one line each."""
    found = blocks(html)
    return "\n".join(text for (text, _, _), keep in zip(found, labels(found)[0], strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            got = [extract(x.as_py()) for x in b.column(2)]
            yield batch(page_id=b.column(0), url=b.column(1), text=pa.array(got, pa.string()), n_chars=pa.array(map(len, got), pa.int64()))

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
