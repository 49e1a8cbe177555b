"""Main text of HTML pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?")
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe noembed noframes xmp template textarea title select".split())
#: Elements that never hold an article's text. A form may be round the whole page.
DROP = set("nav header footer aside script style noscript template iframe object embed svg canvas button select option input textarea label fieldset dialog menu head title audio video map noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body br caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Starting one of these closes an open p.
ENDS_P = BLOCK - {"br", "caption", "html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"}
#: An element of the key's kind is closed by the start of one of these, up to the nearest of its containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"})}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that mark what is not article.
NOISE = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr comment comments disqus respond replies reply sidebar menu nav navbar navigation breadcrumb breadcrumbs footer related recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall pagination pager masthead topbar guestbook teaser teasers outbrain taboola".split())
#: Words of what readers write; an element whose whole name is one is never taken.
READERS = set("comment comments disqus respond replies reply guestbook responses".split())
#: Words that mark it unless a whole name is a word of CONTENT.
DOUBTFUL = set("promo promotion share sharing social discussion feedback reviews responses trending".split())
#: Beginnings and ends of such words.
NOISE_START = ("comment", "cookie", "advert", "sponsor", "navbar", "navig", "sidebar", "breadcrumb", "newsletter", "footer", "disqus")
DOUBTFUL_START = ("discuss",)
NOISE_END = ("nav", "comments", "sidebar", "menu", "footer", "advert")
#: Words that mark it unless a word of CONTENT stands beside them.
WEAK = set("header notice notices alert widget aside toolbar tools meta hidden disclaimer".split())
CONTENT = set("article content main post entry body story text page".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEEP = {"html", "body", "article", "main", *HEADINGS}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
#: Lists, tables and quotations are parts of what holds them.
PARTS = {"blockquote", "dl", "figure", "ol", "table", "tbody", "tr", "ul"}
CONTAINERS = {"div", "section", "article", "main", "body", "td", "html", "center", "blockquote", "figure", "details", "dl", "ul", "ol", "table", "tbody", "tr"}


#: Text outside what names drop that is at least this share of the text inside keeps it dropped.
ENOUGH = 0.1


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "doubt", "points", "chars", "link_chars", "commas")

    def __init__(self, tag: str, parent: Node | None, drop: bool, doubt: int | None = None) -> None:
        self.tag, self.parent, self.drop, self.doubt, self.items = tag, parent, drop, doubt, []
        self.points, self.chars, self.link_chars, self.commas = 0.0, 0, 0, 0


SURE, EXACT, PART, WEAKLY = 3, 2, 1, 0


def _noise(tag: str, attrs: str) -> int | None:
    """How surely an element isn't article: SURE by its tag, attributes or a whole name of READERS, EXACT by another whole name, PART by
    a part of one, WEAKLY by a name that proves little, by a name beside a word of CONTENT or as a form; None if nothing says so."""
    if tag in DROP:
        return SURE
    form = WEAKLY if tag == "form" else None
    if not attrs or tag in KEEP:
        return form
    low = attrs.lower()
    if not any(w in low for w in ("class", "id", "role", "hidden", "style")):
        return form
    words: set[str] = set()
    names: set[str] = set()
    for name, *values in ATTR.findall(low):
        value = unescape("".join(values))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if name in ("class", "id"):
            words.update(re.split(r"[^a-z]+", value))
            names.update(value.split())
    if words & NOISE or any(w.startswith(NOISE_START) or w.endswith(NOISE_END) for w in words):
        if names & CONTENT:
            return WEAKLY
        return SURE if names & READERS else EXACT if names & NOISE else PART
    if not names & CONTENT and (words & DOUBTFUL or any(w.startswith(DOUBTFUL_START) for w in words)):
        return WEAKLY
    return WEAKLY if words & WEAK and not words & CONTENT else form


def _judge(root: Node) -> None:
    """Drops what names and forms mark, but not where the page would lose its only text.

    While the text outside is less than ENOUGH of what a marked element holds, the element least surely marked of those with the
    most text is kept, and what is marked inside it is judged in turn. A page with an article or a main element outside
    them loses all. Each element is walked over twice at most.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.items if isinstance(c, Node) and not c.drop]
    inside: dict[int, int] = {}
    for x in reversed(order):
        own = 0 if x.tag in HEADINGS else sum(len(c.strip()) for c in x.items if isinstance(c, str))
        inside[id(x)] = 0 if x.tag == "a" else own + sum(inside[id(c)] for c in x.items if isinstance(c, Node) and not c.drop)
    waiting: list[Node] = []
    kept, article, todo = 0, False, [root]

    def spread() -> None:
        nonlocal kept, article
        while todo:
            x = todo.pop()
            article |= x.tag in ("article", "main")
            if x.tag not in HEADINGS:
                kept += sum(len(c.strip()) for c in x.items if isinstance(c, str))
            for c in x.items:
                if isinstance(c, Node) and not c.drop and c.tag != "a":
                    (todo if c.doubt is None else waiting).append(c)

    spread()
    while waiting and not article:
        most = max(inside[id(x)] for x in waiting)
        x = min((x for x in waiting if 2 * inside[id(x)] >= most), key=lambda x: (x.doubt, -inside[id(x)]))
        if kept >= ENOUGH * inside[id(x)]:
            break
        waiting.remove(x)
        x.doubt = None
        todo = [x]
        spread()
        article = False
    for x in order:
        if x.doubt is not None:
            x.drop = True


def tree(html: str) -> Node:
    """A tolerant tree of the page: unclosed and stray tags, raw-text elements, comments. An h1 in an article's header stands in its place."""
    root = Node("html", None, False)
    at, pos, n = root, 0, len(html)
    depth: Counter[str] = Counter()  # open elements of each kind
    titles: list[tuple[Node, Node]] = []

    def close_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            depth[at.tag] -= 1
            at = at.parent
        if at.parent:
            depth[at.tag] -= 1
            at = at.parent

    def nearest(tags: set, stops: set) -> Node | None:
        found, x = None, at
        while x.parent and x.tag not in stops:
            if x.tag in tags:
                found = x
            x = x.parent
        return found

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            lt = n
        if lt > pos:
            at.items.append(html[pos:lt])
            pos = lt
            continue
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), pos):
            end = html.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        m = TAG.match(html, pos) or LOOSE.match(html, pos)
        if not m:
            end = html.find(">", pos) if html.startswith("</", pos) else -1
            if end < 0:
                at.items.append("<")
                pos += 1
            else:
                pos = end + 1
            continue
        pos, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            if depth[tag]:
                x = at
                while x.tag != tag:
                    x = x.parent
                close_to(x)
            elif tag == "p":
                at.items.append(Node("br", at, False))
            continue
        if tag == "html" or tag == "body" and depth[tag]:
            continue
        if tag in ENDS_P and depth["p"] and (p := nearest({"p"}, {"table", "td", "th", "button", "caption", "object"})):
            close_to(p)
        if tag in HEADINGS and at.tag in HEADINGS:
            close_to(at)
        if tag in CLOSES and any(depth[t] for t in CLOSES[tag][0]) and (x := nearest(*CLOSES[tag])):
            close_to(x)
        if tag == "body" and depth["head"] and (x := nearest({"head"}, set())):
            close_to(x)
        sure = _noise(tag, attrs)
        node = Node(tag, at, at.drop or sure == SURE, None if sure == SURE else sure)
        if tag == "h1" and at.drop and depth["header"] and depth["article"] and (head := _article_header(at)):
            node.drop = False
            titles.append((head, node))
        at.items.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
            pos = html.find(">", end.start()) + 1 if end else n
            pos = pos or n
            continue
        at = node
        depth[tag] += 1
    for head, title in titles:
        at = head.parent.items
        at.insert(next(i for i, x in enumerate(at) if x is head), title)
        title.parent.items.remove(title)
        title.parent = head.parent
    _judge(root)
    return root


def _article_header(node: Node) -> Node | None:
    """The header above node that stands in an article, dropped for being a header only."""
    head = None
    while node.parent:
        if node.tag == "header":
            head = node
        elif node.tag == "article":
            return head if head and not node.drop and not head.parent.drop else None
        elif node.tag in DROP:
            return None
        node = node.parent
    return None


def _walk(node: Node) -> list[Node]:
    """The kept nodes under node, parents first."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in reversed(x.items) if isinstance(c, Node) and not c.drop]
    return out


def _measure(nodes: list[Node]) -> None:
    """Decoded text lengths, commas and linked text of each node's whole subtree."""
    for x in reversed(nodes):
        for c in x.items:
            if isinstance(c, str):
                text = unescape(c) if "&" in c else c
                size = len(" ".join(text.split()))
                x.chars += size
                x.commas += sum(map(text.count, ",，、،;"))
            elif not c.drop:
                x.chars += c.chars
                x.commas += c.commas
                x.link_chars += c.chars if c.tag == "a" else c.link_chars


def best_nodes(root: Node) -> list[Node | str]:
    """The container with the most points with the siblings that belong to it, in page order.

    If it stands in a main element, that is taken whole but for its parts of links; if in an article, the outermost article is
    taken with the articles beside it that have points and few links. Of containers with equal points the first in page order is taken.
    """
    nodes = _walk(root)
    _measure(nodes)
    density = lambda x: x.link_chars / x.chars if x.chars else 1.0
    for x in nodes:
        own = x.tag in CONTAINERS and any(isinstance(c, str) and c.strip() for c in x.items)
        if (x.tag in PARAGRAPHS or own) and x.chars and x.parent:
            points = (1 + x.commas + min(x.chars / 100, 3)) * (1 - density(x))
            share, up, level = points, x.parent if x.tag in PARAGRAPHS else x, 0
            while up is not None and level < 5:
                up.points += share / (1, 2, 6, 9, 12)[level]
                up, level = up.parent, level + 1
    bonus = {"article": 10, "main": 8, "div": 2, "section": 2, "ul": -3, "ol": -3, "table": -2, "body": -5, "html": -8}
    score = {id(x): (x.points + bonus.get(x.tag, 0)) * (1 - density(x)) for x in nodes}
    ranked = [x for x in nodes if x.tag in CONTAINERS and x.chars]
    if not ranked:
        return [root]
    best = max(ranked, key=lambda x: score[id(x)])  # the first of equals: the outer one
    while best.tag in PARTS and best.parent:
        best = best.parent
    around, x = {}, best
    while x is not None:  # the outermost article or main that holds the best container
        around[x.tag] = x
        x = x.parent
    if "main" in around:
        return _main_items(around["main"], density)
    best = around.get("article", best)
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * score[id(best)])
    behind: set[int] = set()  # the blocks that follow the best container inside a container of the page
    if best.tag != "article" and best.parent.tag not in ("body", "html"):
        after = False
        for s in best.parent.items:
            after |= s is best
            if after and isinstance(s, Node):
                behind.add(id(s))

    def belongs(s: Node) -> bool:
        if s is best:
            return True
        if s.tag in ("h1", "h2"):
            return density(s) < 0.3
        if best.tag == "article":
            return s.tag == "article" and density(s) < 0.3 and s.points > 0
        if s.tag in CONTAINERS and score[id(s)] >= least:
            return True
        if id(s) in behind and s.chars and density(s) < 0.3:
            return True
        return s.tag == "p" and density(s) < 0.25 and (s.chars > 80 or s.commas > 0)

    return [s for s in best.parent.items if isinstance(s, Node) and not s.drop and belongs(s)]


def _main_items(main: Node, density: Callable[[Node], float]) -> list[Node | str]:
    """A main element's content without the blocks that are mostly links, and the headings beside it."""
    heads = lambda items: [s for s in items if isinstance(s, Node) and not s.drop and s.tag in ("h1", "h2") and density(s) < 0.3]
    inner = [s for s in main.items if isinstance(s, str) or not s.drop and (s.tag not in CONTAINERS or density(s) < 0.5)]
    beside = main.parent.items
    at = next(i for i, s in enumerate(beside) if s is main)
    return [*heads(beside[:at]), *inner, *heads(beside[at + 1 :])]


def text_of(nodes: list[Node | str]) -> str:
    """Text of the nodes in page order, blocks and white space joined by single spaces."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(unescape(x) if "&" in x else x)
        elif not x.drop:
            if x.tag in BLOCK:
                out.append("\n")
                todo.append("\n")
            todo += reversed(x.items)
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    """The page's main text; empty for an empty page."""
    return text_of(best_nodes(tree(html))) if html else ""


def extract(html: Column) -> Column:
    """main_text of each page, whole; empty for null and empty pages and for those without text outside what is dropped.

    Each row is worked on alone: repeated pages get equal texts, other columns are not touched, an empty table gives none.
    Elements may be nested to any depth, since the tree is walked without recursion; ties go to the first container.
    """

    @F.arrow_udf("string")
    def apply(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return apply(html)
