"""Main-text extraction by wrapper induction (operator 3).

Pages become DOM trees. Pages of one host are aligned by simple tree matching: equal labels at the root, then the best
ordered matching of the children, recursively. Merging all pages of a host this way gives a template whose nodes say whether
they stand in several distinct pages and whether their text is constant (template) or varies (slot). Constant nodes go. Of the slots, the
template finds the content region: from the root down to the box that holds most of the varying text of all pages. Boxes beside
that way are menus where their text is links, even when the words vary, and adverts or footers where they are a short text
without a heading or a paragraph; both go from every page. Everything else stays in page order. Names of elements and classes
decide only what these measures leave open, such as reader comments, and never about a box on the way to the region. A page
without a second one to compare has names alone, and loses headers without a title and blocks of nothing but links. An article
tag is a hint that the slots confirm: where articles hold half of the varying text of a page, nothing inside them is dropped
for being repeated.

Pages of a host are grouped by their layout, each with a template of its own, from which no node is dropped. Runs of like
siblings count as one node, which keeps templates small. Every task merges its own pages of a host and layout first, so a host
with a third of all pages sends one partial template a layout and task; rules meet their pages in a join that Spark may split.

Defined cases: a null or empty html gives an empty text; a null url belongs to the empty host; broken markup is closed at the
end of the page; elements nested deeper than MAX_DEPTH become siblings; copies of pages are extracted alike; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import html as html_lib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.llm.common import arrow_schema, map_rows, materialise

# fixed sets of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 "
                   "h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead "
                   "tr ul caption".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary"}
# start tags that end an open element of these kinds, and where the search for it stops
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)),
        "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",)),
        "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
        "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))}
SCOPES = frozenset("table td th button article section div body html main aside nav header footer form blockquote ul ol".split())

# elements that make the layout of a page
BOXES = frozenset("body div section article main header ul ol table".split())
# elements that may lead to the content region, and those that give a box text of its own
WAY = BOXES | {"form", "tbody", "tr", "td", "center"} - {"ul", "ol", "header"}
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure article main table dl".split())
# elements that show no text, then elements and class names that are no main text
HIDDEN = frozenset("head script style noscript template iframe select option textarea input svg canvas object audio video noframes "
                   "xmp".split())
DROP_TAGS = HIDDEN | frozenset("nav aside footer form button dialog menu".split())
DROP_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts "
                       "advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                       "notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing "
                       "social related recommended recommendations comment comments commentlist disqus reply replies respond "
                       "discussion search login pagination pager widget toolbar skip toc".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TEMPLATE_PAGES = 3          # distinct pages that must agree before a text counts as constant; both of a host with two
LINK_SHARE = 0.8            # share of link text that makes a block a menu
WAY_SHARE = 0.7             # share of the varying text of all pages with which a box leads to the content region
SIDE_SHARE = 0.1            # of the text of that box: most that a box beside it may have to count as an advert or a footer
MAX_DEPTH = 200


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.items = tag, attrs, []        # items: text or nodes, in page order

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(self.attrs)}

    def children(self) -> list["Node"]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(html: str | None) -> Node:
    root = Node("html")
    stack = [root]
    html = html or ""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].items.append(html[at:])
            break
        if m.start() > at:
            stack[-1].items.append(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "article", "section", "body") and tag in ("p", "b", "i", "span", "a", "em", "li"):
                    break
            continue
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in ENDS:
            kinds, stops = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in kinds:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag == "body":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":
                    del stack[i:]
                    break
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "br"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            node.items.append(html[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def label(node: Node) -> str:
    """Tag with its first class, or the id of a box: what must be equal for nodes to match."""
    if not node.attrs:
        return node.tag
    a = node.attributes()
    name = (a.get("class") or node.tag in BOXES and a.get("id") or "").split()
    return f"{node.tag}.{re.sub(r'[0-9]+', '0', name[0])}" if name else node.tag


def is_boilerplate(node: Node) -> bool:
    if node.tag in DROP_TAGS:
        return True
    if not node.attrs or node.tag in ("html", "body", "main", "p", "h1"):
        return False
    a = node.attributes()
    return a.get("role", "").lower() in DROP_ROLES or named(f"{a.get('class', '')} {a.get('id', '')}")


def named(names: str) -> bool:
    """Whether a word of the names of an element is one of those that tell boilerplate."""
    return bool(DROP_WORDS & set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())))


def is_article(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    return a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"


def articles(node: Node, outer: bool = True) -> list[Node]:
    """The outermost articles outside menus, comments and the like; an article inside `main` is preferred to it."""
    if is_boilerplate(node) or node.tag == "header" and not outer:
        return []
    below = [a for c in node.children() for a in articles(c)]
    if is_article(node):
        return below if node.tag == "main" and below else [node]
    return below


def blocks(nodes: list[Node], skip=frozenset(), keep=frozenset()) -> str:
    """Text of the nodes: one line for each block, white space in it turned into one space; names do not count for those to keep."""
    out, line = [], []

    def flush():
        text = " ".join(html_lib.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    def walk(node, root):
        if id(node) in skip or not root and id(node) not in keep and is_boilerplate(node) or node.tag == "head":
            line.append(" ")
            return
        block = node.tag in BLOCKS
        if block:
            flush()
        elif node.tag == "br":
            line.append(" ")
        for item in node.items:
            if isinstance(item, str):
                line.append(item)
            else:
                walk(item, False)
        if block:
            flush()

    for node in nodes:
        flush()
        walk(node, True)
    flush()
    return "\n".join(out)


# ---- templates: [label, least keys of distinct pages, text hash or None when it varies, varying characters, children]

def skeleton(node: Node) -> tuple[list, list[Node]]:
    """Template of one page and its page nodes in the same preorder; runs of like siblings are one node."""
    order: list[list[Node]] = []
    key = zlib.crc32(blocks([node]).encode("utf-8", "replace"))         # copies count as one page

    def build(nodes: list[Node]) -> list:
        order.append(nodes)
        text = " ".join(" ".join(x for n in nodes for x in n.items if isinstance(x, str)).split())
        runs: list[list[Node]] = []
        for n in nodes:
            for c in n.children():
                if c.tag in ("br", "script", "style"):
                    continue
                if runs and runs[-1][0].tag == c.tag and label(runs[-1][0]) == label(c):
                    runs[-1].append(c)
                else:
                    runs.append([c])
        return [label(nodes[0]), [key], zlib.crc32(text.encode("utf-8", "replace")), len(text), [build(r) for r in runs]]

    return build([node]), order


def layout(root: Node) -> int:
    """Signature of the boxes of a page outside menus and the like: those down to the first fork and two levels below it.

    How many like boxes there are does not count, nor do plain lists and tables.
    """
    def boxes(node):
        return [c for c in node.children() if c.tag in BOXES and (c.attrs or c.tag not in ("ul", "ol", "table")) and not is_boilerplate(c)]

    names, node, below = [], root, boxes(root)
    while len(below) == 1:
        node = below[0]
        names.append(label(node))
        below = boxes(node)
    fork = {label(c) for c in below} | {f"{label(c)} {label(d)}" for c in below for d in boxes(c)}
    return zlib.crc32("\n".join([*names, "", *sorted(fork)]).encode("utf-8", "replace"))


def tree_match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most node pairs of an order-preserving mapping between two trees."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _table(a[4], b[4], memo)[-1][-1]
    return memo[key]


def _table(xs: list, ys: list, memo: dict) -> list[list[int]]:
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_match(x, y, memo))
    return m


def pairs(xs: list, ys: list, memo: dict) -> list[tuple[int, int]]:
    """Indexes of matched children, in order."""
    if len(xs) == len(ys) and all(x[0] == y[0] for x, y in zip(xs, ys)) and len({x[0] for x in xs}) == len(xs):
        return [(i, i) for i in range(len(xs))]
    m, out = _table(xs, ys, memo), []
    i, j = len(xs), len(ys)
    while i and j:
        if m[i][j] == m[i - 1][j]:
            i -= 1
        elif m[i][j] == m[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """Both templates as one; a text that differs varies from then on."""
    memo = {} if memo is None else memo
    same = a[2] is not None and a[2] == b[2]
    children, at, bt = [], 0, 0
    for i, j in [*pairs(a[4], b[4], memo), (len(a[4]), len(b[4]))]:
        children += a[4][at:i] + b[4][bt:j]
        if i < len(a[4]):
            children.append(merge(a[4][i], b[4][j], memo))
        at, bt = i + 1, j + 1
    return [a[0], sorted({*a[1], *b[1]})[:TEMPLATE_PAGES], a[2] if same else None, a[3] + b[3], children]


def learn(template: list | None, page: list) -> list:
    return page if template is None else merge(template, page)


def text_mass(node: Node, skip=frozenset(), keep=frozenset()) -> int:
    """Characters of a subtree without what is skipped and without menus and the like."""
    if id(node) in skip or id(node) not in keep and is_boilerplate(node):
        return 0
    return sum(len(" ".join(x.split())) if isinstance(x, str) else text_mass(x, skip, keep) for x in node.items)


def region(template: list) -> tuple[set[int], set[int]]:
    """Ids of the template nodes beside the way to the content region that are no content, and of those on the way.

    Measured over all pages of the template: the varying text of a node, how much of it is links, and whether it has a
    heading, a paragraph or the like of its own. Between boxes that could lead on, one without a boilerplate name is preferred
    while such boxes hold a tenth of the text.
    """
    need = min(TEMPLATE_PAGES, len(template[1]))
    if need < 2:
        return set(), set()
    found: dict[int, tuple[int, int, bool]] = {}

    def measure(t, linked):
        tag = t[0].partition(".")[0]
        if tag in HIDDEN:
            found[id(t)] = 0, 0, False
            return found[id(t)]
        linked = linked or tag == "a"
        own = t[3] if t[2] is None or len(t[1]) < need else 0
        below = [measure(c, linked) for c in t[4]]
        mass = own + sum(m for m, _, _ in below)
        links = own * linked + sum(n for _, n, _ in below)
        found[id(t)] = mass, links, any(x for _, _, x in below) or tag in TEXT_TAGS and mass > links
        return found[id(t)]

    def suspect(t):
        tag, _, names = t[0].partition(".")
        return tag in DROP_TAGS or tag not in ("html", "body", "main") and named(names)

    def leads(options, total):
        best = max(options, key=lambda t: found[id(t)][0], default=None)
        return best if best is not None and found[id(best)][0] >= WAY_SHARE * total > 0 else None

    measure(template, False)
    side: set[int] = set()
    way: set[int] = set()
    at = template
    while at is not None:
        way.add(id(at))
        if at[0].partition(".")[0] in ("article", "main") and not any(c[0].partition(".")[0] == "article" for c in at[4]):
            break
        plain = sum(found[id(c)][0] for c in at[4] if not suspect(c))
        total = sum(found[id(c)][0] for c in at[4])
        options = [c for c in at[4] if c[0].partition(".")[0] in WAY | {"nav", "aside", "footer"}]
        on = leads([c for c in options if not suspect(c)], plain) if 10 * plain >= total else leads(options, total)
        for c in at[4] if on is not None else ():
            mass, links, text = found[id(c)]
            tag = c[0].partition(".")[0]
            if c is on or tag not in BLOCKS or tag in TEXT_TAGS or not mass or 2 * mass >= found[id(on)][0]:
                continue
            if links >= LINK_SHARE * mass or not text and tag not in ("ul", "ol") and mass < SIDE_SHARE * found[id(on)][0]:
                side.add(id(c))
        at = on
    return side, way


def template_nodes(root: Node, template: list, measured: tuple[set[int], set[int]]) -> tuple[set[int], set[int]]:
    """Ids of the page nodes that the template takes away, and of those on the way to its content region.

    Away go the outermost nodes whose whole text is constant over the host, none when nothing varies, and the nodes beside the
    region. A constant inline element stays where text stands around it, since it is part of a sentence.
    """
    page, order = skeleton(root)
    need = min(TEMPLATE_PAGES, len(template[1]))
    if template[0] != page[0] or need < 2:
        return set(), set()
    side, way = measured
    skip: set[int] = set()
    keep: set[int] = set()
    memo: dict = {}
    numbers = iter(range(len(order)))

    def number(t):
        mine = next(numbers)
        return (mine, [number(c) for c in t[4]])

    def align(t, p, places):
        found = [(j, align(t[4][i], p[4][j], places[1][j])) for i, j in pairs(t[4], p[4], memo)]
        if t[2] is not None and len(t[1]) >= need and len(found) == len(p[4]) and all(fixed for _, fixed in found):
            return True
        for j, fixed in found:
            if fixed and (not p[3] or p[4][j][0].split(".")[0] in BLOCKS):
                skip.update(id(n) for n in order[places[1][j][0]])
        if id(t) in side:
            skip.update(id(n) for n in order[places[0]])
        if id(t) in way:
            keep.update(id(n) for n in order[places[0]])
        return False

    return (set(), set()) if align(template, page, number(page)) else (skip, keep)


def page_frame(root: Node) -> set[int]:
    """Ids of what a page without a template can tell as its frame: headers without a title, blocks of nothing but links."""
    skip: set[int] = set()
    total = text_mass(root)

    def links(node):
        if is_boilerplate(node):
            return 0, 0
        if node.tag == "a":
            return 1, text_mass(node)
        found = [links(c) for c in node.children()]
        return sum(n for n, _ in found), sum(m for _, m in found)

    def titled(node):
        return node.tag == "h1" or any(titled(c) for c in node.children())

    def walk(node):
        for c in node.children():
            if is_boilerplate(c):
                continue
            mass = text_mass(c)
            n, linked = links(c) if c.tag in BLOCKS and c.tag != "body" else (0, 0)
            if mass * 2 < total and (n > 1 and linked >= LINK_SHARE * mass or c.tag == "header" and not titled(c)):
                skip.add(id(c))
            else:
                walk(c)

    walk(root)
    return skip


def extract(html: str | None, template: list | None, measured: tuple[set[int], set[int]] | None = None) -> str:
    """Main text of a page by the template of its host and what `region` measures on it.

    Articles whose varying text is at least half of that of the page stay whole; other article tags count for nothing.
    """
    root = parse(html)
    skip, keep = template_nodes(root, template, measured or region(template)) if template else (set(), set())
    skip = skip or page_frame(root)
    found = articles(root)
    if found and 2 * sum(text_mass(a, skip, keep) for a in found) >= text_mass(root, skip, keep):
        skip.difference_update(id(n) for a in found for n in subtree(a))
    return blocks([root], skip, keep)


def subtree(node: Node) -> list[Node]:
    return [node, *(n for c in node.children() for n in subtree(c))]


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def learn_templates(pages: DataFrame) -> DataFrame:
    """host, layout, template (JSON): each task merges its own pages of a host and layout, then partial templates are merged."""
    schema, arrow = arrow_schema("host string, layout bigint, template string")

    def rows(found):
        keys = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int64()),
                                           pa.array([json.dumps(found[k]) for k in keys], pa.string())], schema=arrow)

    def partial(batches):
        found: dict[tuple, list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1)):
                root = parse(html.as_py())
                key = host.as_py(), layout(root)
                found[key] = learn(found.get(key), skeleton(root)[0])
                if len(found) > 2000:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    def total(table: pa.Table) -> pa.Table:
        texts = sorted(table.column("template").to_pylist())        # the same order whichever task came first
        whole = None
        for text in texts:
            whole = learn(whole, json.loads(text))
        return pa.table({"host": [table.column("host")[0].as_py()], "layout": [table.column("layout")[0].as_py()],
                         "template": [json.dumps(whole)]}, schema=arrow)

    return pages.select(_host().alias("host"), "html").mapInArrow(partial, schema) \
        .groupBy("host", "layout").applyInArrow(total, schema)


@F.arrow_udf(T.LongType())
def _layout(html: pa.Array) -> pa.Array:
    return pa.array([layout(parse(x.as_py())) for x in html], pa.int64())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    templates = materialise(learn_templates(pages))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", _host().alias("host"), _layout("html").alias("layout")) \
        .join(templates, ["host", "layout"], "left")

    def make():
        known: dict[str | None, tuple] = {None: (None, None)}

        def run(cols):
            out = []
            for html, text in zip(cols[2], cols[3]):
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                        known[None] = None, None
                    template = json.loads(text)
                    known[text] = template, region(template)
                out.append(extract(html, *known[text]))
            return [cols[0], cols[1], out]
        return run

    return map_rows(rows, ["page_id", "url", "html", "template"], f"page_id {kind}, url string, text string", make)
