"""Main text of HTML pages by composite text density.

Every page becomes a lenient tree (void elements, implied ends, raw-text elements). For a
node with C characters, LC link characters, T tags and LT link tags the composite density
is ``C/T * log(C*T / (LC*LT)) / log(log(C*LC/nLC + C*LCb/Cb + e))``, where nLC are the
characters outside links and b is the body. The density sum of a node adds the densities
of its children; text of its own stands as one more child and adds its number of words. The
subtree of the largest sum is the core of the article. The body path leads from it to its
enclosing ``article`` or ``main``, else to body; half the least density on it is the threshold.
Up that path the article grows to every node with two or more children as dense as the
threshold, single-child wrappers included; an ``article`` or ``main`` at its end is taken
whole, and of body's children all from the first to the last dense one.

Scripts, styles, navigation and controls never hold article text. Other elements are suspects:
header, footer, aside, form, what is hidden, and what names itself advert, comment, notice,
sidebar and so on. A suspect goes only where the page keeps its text without it: none goes
that holds an ``article`` or ``main`` with text, and as long as the suspects inside these (of
the page, without them) leave less than ``REST`` of the text outside links, the largest of
them counts as a plain element.

Null and empty pages, and pages without text, give an empty text. Character references
are decoded, white space inside a block becomes one space, blocks are joined in page order
by one space. Nothing else is dropped; repeated rows keep one row each. Time is linear in
the page, also for tags and quotes that never end.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

#: Element lists (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "html", "head", "body"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
#: Elements without article text.
NEVER = frozenset("script style noscript template nav iframe object embed svg canvas button select textarea input label menu dialog title link meta head".split())
#: Elements that may be no article text, words by which elements name themselves so, words that undo them, and roles.
SUSPECT = frozenset("header footer aside form".split())
NAMED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments respond disqus reply replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended footer masthead toolbar pagination pager widget".split())
UNDONE = frozenset("has with no without not is enabled disabled open closed".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Share of the text outside links that must stay when the suspects go.
REST = 0.1
#: Share of the least density on the body path from which a child counts as dense.
DENSE = 0.5
#: A tag with its name and attributes, with quotes heeded, and without where a quote never ends.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SCOPES = ("td", "th", "li", "button", "table")


class Node:
    __slots__ = ("tag", "never", "suspect", "kids", "chars", "linked", "tags", "link_tags", "density", "total", "parent", "open_p")

    def __init__(self, tag: str, parent, never: bool = False, suspect: bool = False):
        self.tag, self.never, self.suspect, self.parent = tag, never, suspect, parent
        self.kids: list = []
        self.open_p = None  # the open paragraph that a block inside this node ends

    def parts(self):
        """Children that take part."""
        return [k for k in self.kids if isinstance(k, Node) and not k.never]


def _named(name: str) -> bool:
    pieces = re.split(r"[-_]", name)
    return not NAMED.isdisjoint(pieces) and UNDONE.isdisjoint(pieces)


def _suspect(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in SUSPECT and not (tag == "header" and inside_article):
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and any(map(_named, value.split())):
            return True
        if key == "hidden" or (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(page: str) -> Node:
    """The page as a tree; text is str among a node's kids."""
    root = Node("#root", None)
    stack, opened, at, tags = [root], {}, 0, TAG
    last = page.rfind(">")

    def pop_to(k: int):
        while len(stack) > k:
            opened[stack.pop().tag] -= 1

    def text(s: str):
        if s:
            stack[-1].kids.append(entities.unescape(s) if "&" in s else s)

    n, begun = len(page), 0  # text from begun on is not yet in the tree
    while True:
        at = page.find("<", at)
        if at < 0 or (at > last and not page.startswith("<!--", at)):
            text(page[begun:])
            return root
        m = None
        if page.startswith("<!--", at):
            m = COMMENT.match(page, at)
        elif page[at + 1 : at + 2] in ("!", "?"):
            text(page[begun:at])
            at = begun = page.find(">", at) + 1
            continue
        else:
            m = tags.match(page, at)
            if m is None and tags is TAG and (page[at + 1 : at + 2].isascii() and page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/"):
                m = LOOSE_TAG.match(page, at)
                if m is not None:  # a quote that never ends: from here on quotes mean nothing
                    tags = LOOSE_TAG
        if m is None:
            at += 1
            continue
        text(page[begun:at])
        at = begun = m.end()
        if m.re is COMMENT:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:  # an end tag
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            elif tag == "br":
                stack[-1].kids.append(Node("br", stack[-1]))
            continue
        if tag in CLOSES_P and stack[-1].open_p is not None:
            pop_to(stack[-1].open_p)
        if tag in ENDS and any(opened.get(x) for x in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in STOPS[tag]:
                    break
                if stack[k].tag in ENDS[tag]:
                    pop_to(k)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in ("html", "body") and opened.get(tag):
            continue
        node = Node(tag, stack[-1], tag in NEVER, _suspect(tag, attributes, bool(opened.get("article"))))
        stack[-1].kids.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>|</{tag}\\Z", re.I).search(page, at)
            at = begun = end.end() if end else n
            continue
        node.open_p = len(stack) if tag == "p" else None if tag in SCOPES else stack[-1].open_p
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1


def ordered(root: Node) -> list[Node]:
    """All nodes that take part, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.parts()))
    return out


def count(nodes: list[Node]) -> None:
    """Characters and tags, in and outside links, of nodes given parents first."""
    for node in reversed(nodes):
        node.chars = node.linked = node.tags = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len("".join(k.split()))
            elif not k.never:
                node.chars += k.chars
                node.linked += k.linked
                node.tags += k.tags + 1
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.linked = node.chars


def drop_suspects(root: Node) -> list[Node]:
    """The nodes that stay, counted, parents first; suspects that go are marked never."""
    nodes = ordered(root)
    count(nodes)
    for node in nodes:
        if node.tag in ("article", "main") and node.chars:
            while node is not None:  # what holds it is no suspect; a suspect inside it may still go
                node.suspect, node = False, node.parent
    tops = outermost(root, lambda x: x.tag in ("article", "main") and x.chars)
    held = set(tops)
    gone = [x for x in outermost(root, lambda x: x.suspect or x in held) if x not in held] if tops else []
    for top in tops or [root]:
        gone += settle(top)
    for node in gone:
        node.never = True
    if gone:
        nodes = ordered(root)
        count(nodes)
    return nodes


def outermost(root: Node, wanted) -> list[Node]:
    """The nodes below root for which wanted holds and that no other such node holds."""
    out, todo = [], root.parts()
    while todo:
        node = todo.pop()
        if wanted(node):
            out.append(node)
        else:
            todo.extend(node.parts())
    return out


def settle(top: Node) -> list[Node]:
    """The suspects below top that go: the largest count as plain elements until enough text stays."""
    plain = lambda x: x.chars - x.linked
    outer = outermost(top, lambda x: x.suspect)
    rest = plain(top) - sum(map(plain, outer))
    heap = [(-plain(x), i, x) for i, x in enumerate(outer)]
    heapq.heapify(heap)
    made = len(heap)
    while heap and heap[0][0] and rest < REST * plain(top):
        _, _, node = heapq.heappop(heap)
        inner = outermost(node, lambda x: x.suspect)  # judged in its place
        rest += plain(node) - sum(map(plain, inner))
        for x in inner:
            heapq.heappush(heap, (-plain(x), made, x))
            made += 1
    return [x for _, _, x in heap]


def measure(nodes: list[Node]) -> Node:
    """Densities and density sums of counted nodes; body, or the root without one."""
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.linked / max(1, body.chars)
    for node in reversed(nodes):
        c, t = node.chars, max(1, node.tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c * max(1, node.linked) / max(1, c - node.linked) + share * c + math.e)
            node.density = c / t * math.log(max(math.e, c * t / (max(1, node.linked) * max(1, node.link_tags)))) / math.log(max(base, math.e))
        node.total = sum(k.density for k in node.parts()) + sum(len(k.split()) for k in node.kids if isinstance(k, str))
    return body


def article(page: str) -> str:
    """The main text of a page."""
    nodes = drop_suspects(parse(page))
    body = measure(nodes)
    best = max((x for x in nodes if x.chars), key=lambda x: x.total, default=None)
    if best is None:
        return ""
    while best.tag not in BLOCK and best.parent is not None:
        best = best.parent  # text never starts inside a line
    path = [best]
    while path[-1].tag not in ("article", "main") and path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    if path[-1].tag in ("article", "main"):
        return flat([path[-1]])
    least = DENSE * min(x.density for x in path)
    chosen = [best]
    for inner, outer in zip(path, path[1:], strict=False):
        dense = [i for i, k in enumerate(outer.kids) if isinstance(k, Node) and not k.never and (k is inner or (k.density >= least and k.chars and 3 * k.linked < k.chars))]
        if len(dense) > 1:
            chosen = [outer] if outer is not body and outer.parent is not None else outer.kids[dense[0] : dense[-1] + 1]
    return flat(chosen)


def flat(chosen: list) -> str:
    """Texts of the nodes; edges of blocks are white space."""
    out: list[str] = []
    todo: list = list(reversed(chosen))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.never:
            if k.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages."""
    common.ready(spark)

    def rows(batches):
        for batch in batches:
            texts = [article(x) for x in common.texts_of(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(common.trimmed(rows), "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
