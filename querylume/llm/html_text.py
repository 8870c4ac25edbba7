"""Main text of web pages by composite text density.

The whole page is parsed into a tree as browsers do, with the implied ends of unclosed blocks. Every node's composite
density is its characters per tag, adjusted by the share of link characters and link tags against the body's. Of every
node the densities of its children are summed; the node with the largest sum is the core. The body-path threshold is
the least density on the path from the core up to the body. The main content is the core and every block of the body
beside that path whose density reaches the threshold, unless the page marks an article or main element with at least
half as much text. A thinner block stays if it isn't mostly links and lies between blocks that stay, is a heading before
one, or has a parent on the path, below the body, that adds little else than text.

Scripts, styles and the like never count as text. Menus, headers, footers, sidebars, adverts, forms and reader comments
are left out before densities are taken, but a mark alone cuts no article:

* A name (class or id) of such words and neutral ones, or with a word for comments, cuts a block without an h1 or main
  element. Names that articles use as well (DOUBTFUL_WORDS) only cut a block that is mostly links, and names with other
  words beside only one that also has no more than half of the page's text outside of links.
* Forms, hidden blocks and noscript are cut unless they hold more than half of that text.
* Navigation, headers, footers and sidebars, by tag or role, are cut unless they hold a main or article element and more
  than half of that text.
* Where nothing would be left, the largest block stays.

Scale: one map over the pages; a page is parsed once, in time linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption template".split())
ENDS_P = BLOCK - frozenset("body html legend caption tbody td tfoot th thead tr option optgroup template".split())
#: An element that begins ends an open one of these, unless a scope of the right side lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])), "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])), "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
DROPPED = frozenset("script style button select textarea iframe object embed svg canvas template head title input audio video map annotation annotation-xml noframes noembed applet".split())
#: Elements and roles that may wrap a whole article, and those that stand beside one.
WRAPS, SIDES = frozenset("form noscript dialog search".split()), frozenset("nav footer aside menu".split())
WRAP_ROLES = frozenset("complementary search form alert alertdialog dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo menu menubar toolbar tablist advertisement".split())
#: Words of class names and ids that mark what isn't main text.
DROPPED_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners
nav navbar navigation menu menus topnav subnav sidenav breadcrumb breadcrumbs pagination pager toolbar header masthead footer sidebar sidebars aside rail
widget widgets related recommended recommendations social share sharing sharebar follow cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login
comment comments commentlist disqus replies reply respond discussion form search skip legal copyright disclaimer""".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template html head".split())
#: Words that articles use as well: a block with such a name goes only if it is mostly links.
DOUBTFUL_WORDS = frozenset("related social sponsor sponsors sponsored promotion header notice notices alert alerts overlay subscription respond reply replies discussion form search skip legal copyright disclaimer recommended recommendations".split())
#: What may stand beside such words in a name.
NEUTRAL_WORDS = frozenset("""site global left right top bottom box bar list links area user users slot wrapper wrap section container block inner outer unit zone
holder panel module region item items group row primary secondary main page reader readers visitor visitors""".split())
#: A word of these in a name marks reader comments, whatever stands beside it.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: What a mark says: a doubtful name, a name, a name with other words beside, a block that may wrap an article, one beside it.
DOUBTFUL, NAMED, LOOSE, WRAP, SIDE = range(1, 6)
_TAG = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)", re.S | re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("tag", "kids", "parent", "drop", "named", "own", "chars", "tags", "link_chars", "link_tags", "density", "total", "blocks")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop, self.kids, self.named = tag, parent, drop, [], 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.blocks = tag in BLOCK


def _marked(tag: str, attrs: str, in_article: bool) -> int:
    """What a block's tag, role, hidden state, class and id say, the strongest of all, or 0."""
    found = {SIDE} if tag in SIDES or tag == "header" and not in_article else {WRAP} if tag in WRAPS else set()
    plain = tag in ("body", "html", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6")
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            found.add(WRAP)
        elif name == "role":
            role = value.strip().lower()
            found.add(SIDE if role in SIDE_ROLES else WRAP if role in WRAP_ROLES else 0)
        elif name in ("class", "id") and not plain:
            for one in value.split():
                words = {w.lower() for w in _NAME_PARTS.findall(one)}
                if marks := words & DROPPED_WORDS:
                    if words & COMMENT_WORDS:
                        found.add(NAMED)
                    elif words <= DROPPED_WORDS | NEUTRAL_WORDS:
                        found.add(DOUBTFUL if marks <= DOUBTFUL_WORDS else NAMED)
                    elif not marks <= DOUBTFUL_WORDS:
                        found.add(LOOSE)
    return next((x for x in (NAMED, SIDE, WRAP, LOOSE, DOUBTFUL) if x in found), 0)


def _held(nodes: list[Node]) -> dict[Node, tuple[int, int, bool, bool]]:
    """Of each node: characters, those in links, whether an h1 or main element is in it, and whether a main or article."""
    out: dict[Node, tuple[int, int, bool, bool]] = {}
    for x in reversed(nodes):  # children first
        chars, linked, head, body = x.own, 0, x.tag in ("h1", "main"), x.tag in ("main", "article")
        for k in x.kids:
            if not isinstance(k, str) and not k.drop:
                c, n, h, m = out[k]
                chars, linked, head, body = chars + c, linked + n, head or h, body or m
        out[x] = chars, chars if x.tag == "a" else linked, head, body
    return out


def _cut_marked(root: Node) -> None:
    """Cuts what is marked, first by names alone, then by what is left of the page's text."""
    cut: list[tuple[int, Node]] = []
    nodes, sizes = _ordered(root), {}
    for x in nodes:
        x.own = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
    if not any(x.named for x in nodes):
        return
    for by_name in (True, False):
        if by_name or cut:
            sizes = _held(nodes)
        plain = sizes[root][0] - sizes[root][1]
        todo = [root]
        while todo:
            x = todo.pop()
            chars, linked, head, body = sizes[x]
            most = 2 * (chars - linked) > plain
            if by_name:
                gone = not head and (x.named == NAMED or x.named == DOUBTFUL and 2 * linked > chars)
            else:
                gone = x.named == LOOSE and not head and not most or x.named == WRAP and not most or x.named == SIDE and not (body and most)
            if gone:
                cut.append((chars, x))
                x.drop = True
            else:
                todo.extend(k for k in x.kids if not isinstance(k, str) and not k.drop)
        nodes = _ordered(root) if cut else nodes
    if not any(x.own for x in nodes):
        best = max((c for c in cut if c[0]), key=lambda c: c[0], default=None)  # no text but in marked blocks
        if best:
            best[1].drop = False


def parse(page: str) -> Node:
    """The tree under an 'html' root. Children are nodes and decoded strings."""
    root = cur = Node("html", None, False)
    at, n = 0, len(page)
    in_article = 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if cur.tag == "head" and not page[at:lt].isspace():
                cur = cur.parent
            cur.kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            cur.kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _TAG:
            close, tag, attrs = m.groups()
        else:
            close, (tag, attrs) = None, m.groups()
        if close:
            close = close.lower()
            node = cur
            while node is not root and node.tag != close:
                if node.tag in ("table", "article", "main", "section", "aside", "nav", "footer", "header", "div", "td", "form") and close not in BLOCK:
                    node = root  # an inline end tag doesn't reach beyond its block
                    break
                node = node.parent
            if node is not root:
                while cur is not node:
                    in_article -= cur.tag in ("article", "main")
                    cur = cur.parent
                in_article -= cur.tag in ("article", "main")
                cur = cur.parent
            elif close in ("p", "br"):
                cur.kids.append(Node("br", cur, False))
        elif tag:
            tag = tag.lower()
            if cur.tag == "head" and tag not in IN_HEAD:
                cur = cur.parent
            elif tag == "body" and cur.tag == "noscript" and cur.parent.tag == "head":
                cur = cur.parent.parent
            if tag in ("html", "body", "head") and any(x.tag == tag for x in (cur, root) if x.tag != "html" or tag == "html"):
                continue
            ends, scope = (frozenset(["p"]), BLOCK - frozenset(["p"])) if tag in ENDS_P else (frozenset(), frozenset())
            for ends, scope in ((ends, scope), IMPLIED.get(tag, (frozenset(), frozenset()))):
                if not ends:
                    continue
                node, last = cur, None
                while node is not root and node.tag not in scope:
                    if node.tag in ends:
                        last = node
                    node = node.parent
                if last is not None:
                    while cur is not last:
                        cur = cur.parent
                    cur = cur.parent
            node = Node(tag, cur, tag in DROPPED)
            node.named = _marked(tag, attrs, in_article > 0)
            cur.kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                cur = node
                in_article += tag in ("article", "main")
    _cut_marked(root)
    return root


def _ordered(root: Node) -> list[Node]:
    """Nodes that aren't dropped, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            out.append(node)
            todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return out


def _measure(nodes: list[Node]) -> float:
    """Sets densities and their sums; returns the share of link characters in the page."""
    for node in nodes:
        node.chars = node.own
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    root = nodes[0]
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.total += node.density
            up.blocks = up.blocks or node.blocks
    return share


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    c, t, lc, lt = max(1, chars), max(1, tags), max(1, link_chars), max(1, link_tags)
    base = max(1.05, math.log(c * link_chars / max(1, chars - link_chars) + share * c + math.e))
    return (chars / t) * max(0.0, math.log(max(1.0001, (c / lc) * (t / lt)), base)) if chars else 0.0


def _parts(node: Node, held: set[Node]) -> list[list[Node | str]]:
    """Each block among the children, and each run of text and inline elements between blocks."""
    out: list[list[Node | str]] = []
    run = False
    for k in node.kids:
        if not isinstance(k, str) and k.drop:
            continue
        inline = isinstance(k, str) or not (k.blocks or k in held)
        if inline and run:
            out[-1].append(k)
        else:
            out.append([k])
        run = inline
    return out


def _sizes(part: list[Node | str]) -> tuple[int, int, int, int]:
    if len(part) == 1 and not isinstance(part[0], str):
        return part[0].chars, part[0].tags, part[0].link_chars, part[0].link_tags
    inner = [k for k in part if not isinstance(k, str)]
    chars = sum(len("".join(k.split())) for k in part if isinstance(k, str)) + sum(k.chars for k in inner)
    return chars, sum(k.tags + 1 for k in inner), sum(k.link_chars for k in inner), sum(k.link_tags for k in inner)


def _thin(path: list[Node], share: float) -> int:
    """Takes out of the body the blocks beside the core's path that are thinner than the threshold, and returns how
    many characters stay. ``path`` leads from the core to the body."""
    core, top, held, least = path[0], path[-1], set(path), min(x.density for x in path)
    strict, loose = False, set()
    for inner, node in zip(path, path[1:]):
        more, linked = node.chars - inner.chars, node.link_chars - inner.link_chars
        strict = strict or node is top or 3 * linked > more
        if not strict:
            loose.add(node)
    stay, todo = core.chars, [top]
    while todo:
        node = todo.pop()
        if node is core:
            continue
        parts = _parts(node, held)
        sizes = [_sizes(x) for x in parts]
        on_path = [x[0] in held for x in parts]
        good = [on or n[0] > 0 and (x[0].density if len(x) == 1 and not isinstance(x[0], str) else _density(*n, share)) >= least for on, x, n in zip(on_path, parts, sizes)]
        dense = [i for i, x in enumerate(good) if x]
        for i, (x, n) in enumerate(zip(parts, sizes)):
            if not good[i] and 3 * n[2] <= n[0]:  # short text without links belongs to what lies around it
                follows = not isinstance(x[0], str) and x[0].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and bool(dense) and i < dense[-1]
                good[i] = node in loose or follows or bool(dense) and dense[0] < i < dense[-1]
        node.kids = [k for i, x in enumerate(parts) if good[i] for k in x]
        for i, x in enumerate(parts):
            if good[i] and on_path[i]:
                todo.append(x[0])
            elif good[i]:
                stay += sizes[i][0]
    return stay


def main_node(root: Node) -> Node | None:
    """The subtree with the main text, or none if there is no text."""
    nodes = _ordered(root)
    share = _measure(nodes)
    body = next((x for x in nodes if x.tag == "body"), root)
    if not root.chars:
        return None
    inside = [x for x in nodes if x.tag in BLOCK or x is root]
    core = max(inside, key=lambda x: x.total)
    path, node = [], core
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    marked = [x for x in nodes if x.tag in ("article", "main")]
    if marked:
        # authors who mark the main text mark all of it
        own = next((x for x in (marked if core is body or core is root else path) if x.tag in ("article", "main")), None)
        if own is None:
            own = max(marked, key=lambda x: x.chars)
        same = [x for x in marked if x.parent is own.parent]
        best = own if len(same) == 1 or max(x.chars for x in same) == own.chars and own.chars * 2 > sum(x.chars for x in same) else own.parent
        if core is body or core is root or own.chars * 2 >= _thin(path, share):
            return best
    else:
        _thin(path, share)
    return path[-1]


def text_of(node: Node) -> str:
    """Blocks joined by a line feed; white space inside a block is one space."""
    blocks: list[str] = []
    cur: list[str] = []

    def flush() -> None:
        if cur:
            if text := _SPACE.sub(" ", "".join(cur)).strip():
                blocks.append(text)
            cur.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            cur.append(x)
        elif not x.drop:
            if x.tag in BLOCK or x.tag == "br":
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    best = main_node(parse(page))
    return text_of(best) if best is not None else ""


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["text"] = [extract(h) for h in pdf.pop("html")]
        yield pdf


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id_col, url_col, text, n_chars (code points).

    Null or empty html, and a page without main text, give an empty text. Text outside any markup is main text. Rows
    that repeat are extracted each. Other columns are ignored. An empty table gives an empty result."""
    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))  # as text: pandas has no null integers
    out = rows.mapInPandas(_extract, f"id string, url {url}, text string")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``: page_id, url, text, n_chars."""
    return extract_pages(table(spark, sf_dir, "pages"))
