"""Main text of web pages by composite text density.

A page is read into a tree. For every node its characters per tag are adjusted for links: with C characters, T tags, L of
the characters in links and K link tags below it, the density is

    C / T * log(C / max(L, 1) * T / max(K, 1)) / log(log(C * L / max(C - L, 1) + Lb / Cb * C + e) + e - 1)

with the body's Lb and Cb, counts of at least 1 for T, and 0 where it would be negative; e - 1 keeps the last logarithm at 1 or more,
where a page without links would make it 0. A node's sum adds the densities of its children, where its own text counts as
one more child by the same formula: one tag, and all of it linked if it is in a link. The
node with the largest sum is the seed, and the smallest density on the path from it to the body is the threshold: every
subtree that reaches it and has the largest sum of its branch is taken, widened to the article element around it.
Navigation, page headers, footers, asides, controls, scripts, styles and hidden elements are cut from the tree beforehand and so
have no part in any density. A form, or an element of which a class, the id or the role names boilerplate as a whole (sidebar,
site-footer, post-comments, but not has-sidebar or content-sidebar-wrap), is cut as well, from the inside out, unless it holds an article
or main element, or what is left of it is 1 / MINOR or more of the page's text outside links and no article lies beside it. Reader comments
of any size go where the page has 1 / MINOR_BESIDE or more of that text outside all such names. The densities decide on the rest and on all other names.

Texts come out in page order, a block each, joined by two line feeds; white space inside a block becomes one space and
character references are decoded. Null or empty html, and pages without text, give an empty string; null ids and urls pass
through; repeated rows are extracted each; malformed markup never fails. Elements may nest without limit, and the work for a tag
doesn't depend on how deep it lies; very long pages are read whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
#: A start tag ends these open elements, up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# What is no part of an article, by element and by word of a class, id or role.
CUT = frozenset("nav aside footer script style noscript template iframe object embed svg canvas button select textarea input label dialog menu title head xmp noembed noframes".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertising sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer foot masthead comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations widget widgets login search pager pagination toolbar contentinfo complementary alert disclaimer paywall "
    "topbar topnav sidenav subnav submenu dropdown skip copyright colophon notification notifications leaderboard skyscraper".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Only outside article and main elements, where sections may be called so.
ROLES_ON_TOP = frozenset(("header", "banner", "legal", "announcement"))
#: In a name, what makes it a state of the page or a frame around more; what may follow the word for boilerplate; names of content.
STATES = frozenset("has have having with without no not is are and or show hide open closed enabled disabled after before above below".split())
PLACES = frozenset("left right top bottom primary secondary main inner outer list links link item items area box block bar section container small large mobile desktop slot unit zone placement placeholder".split())
#: As PLACES, in names without a word of content.
WRAPS = frozenset("wrap wrapper outer".split())
CONTENT = frozenset("article articles content post posts entry hentry story main page body text".split())
#: What is cut by its name holds less than 1 / MINOR of the page's text outside links.
MINOR = 3
#: Reader comments may hold any share, if this part of the text is outside all such names.
MINOR_BESIDE = 10
ARTICLE = frozenset(("article", "main"))

#: What an end tag of a paragraph doesn't reach beyond; what keeps a paragraph open around a new block.
P_ENDS, P_KEEPS = ("article", "div", "section", "td"), ("td", "th", "article", "div", "section", "body", "button")
TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: Every attribute: its name, then its value in double quotes, in single quotes or bare.
ATTRIBUTE = re.compile(r"""(=?[^\s/=>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "named", "readers", "article", "chars", "tags", "linked", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: bool = False, readers: bool = False):
        self.tag, self.parent, self.cut, self.named, self.readers = tag, parent, cut, named, readers
        self.article: Node | None = self if tag in ARTICLE else parent.article if parent else None
        self.parts: list[Node | str] = []


class Open:
    """The open elements, from the root inwards, and the depths of each kind of them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """The element at that depth, and all within it."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def deepest(self, *tags: str) -> int:
        """0 where none is open."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def end(self, tag: str) -> None:
        depth = self.deepest(tag)
        inline = tag not in BLOCK and tag not in CELL
        stop = self.deepest(*P_ENDS) if tag == "p" else self.blocks[-1] if inline and self.blocks else 0
        if depth > stop and tag != "body":
            self.close(depth)

    def before(self, tag: str) -> None:
        """What a start tag of that kind ends."""
        if tag in BLOCK and self.deepest("p") > self.deepest(*P_KEEPS):
            self.close(self.deepest("p"))
        if tag in ENDS:
            ended, stops = ENDS[tag]
            stop = self.deepest(*stops)
            outer = [d[i] for d in map(self.where.get, ended) if d and (i := bisect_right(d, stop)) < len(d)]
            if outer:
                self.close(min(outer))


def names_boilerplate(names: str, hints: frozenset[str]) -> bool:
    """Whether one of the names, as a whole, is one for boilerplate and none is one for content."""
    found = False
    for name in names.split():
        words = [x.lower() for x in TOKEN.findall(name)]
        if len(words) == 1 and words[0] in CONTENT:
            return False
        ends = PLACES if CONTENT.intersection(words) else PLACES | WRAPS
        while len(words) > 1 and (words[-1] in ends or words[-1].isdigit() or len(words[-1]) == 1):
            words.pop()
        found = found or bool(words and words[-1] in hints and STATES.isdisjoint(words))
    return found


def judge(tag: str, attributes: str, parent: Node) -> tuple[bool, bool, bool]:
    """Whether an element is cut whatever it holds, whether its name is one for boilerplate, and whether for reader comments."""
    if tag in CUT:
        return True, True, False
    on_top = parent.article is None
    if tag == "header" and on_top:
        return True, True, False
    hints = HINTS | ROLES_ON_TOP if on_top else HINTS
    named, readers = tag == "form", False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if tag not in ARTICLE:
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return True, True, False
            if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, True, False
        if name in ("class", "id", "role"):
            named = named or names_boilerplate(value, hints)
            readers = readers or names_boilerplate(value, READERS)
    return False, named, readers


def cut_named(body: Node) -> None:
    """Cuts what is named as boilerplate, by the rule above."""
    order, stack = [], [(body, False, False, 0)]
    while stack:  # in a link, under a name for boilerplate, article and main elements around; in an article, none counts as beside
        x, in_link, under, around = stack.pop()
        in_link, under = in_link or x.tag == "a", under or x.named
        order.append((x, in_link, under, around))
        within = around if x.named else math.inf if x.tag == "article" else around + (x.tag == "main")
        stack.extend((p, in_link, under, within) for p in x.parts if not isinstance(p, str) and not p.cut)
    own: dict[int, int] = {}
    chars: dict[int, int] = {}
    holds: dict[int, bool] = {}  # an article or main element that is not itself named as boilerplate, as readers' comments are
    for x, in_link, _, _ in reversed(order):
        kids = [p for p in x.parts if not isinstance(p, str) and not p.cut]
        own[id(x)] = 0 if in_link else sum(_weight(p) for p in x.parts if isinstance(p, str))
        chars[id(x)] = own[id(x)] + sum(chars[id(p)] for p in kids)
        holds[id(x)] = x.tag in ARTICLE and not x.named or any(holds[id(p)] for p in kids)
    total = chars[id(body)]
    beside = sum(own[id(x)] for x, _, under, _ in order if not under)
    articles = sum(x.tag in ARTICLE and not x.named and chars[id(x)] > 0 for x, _, _, _ in order)
    left: dict[int, int] = {}
    for x, _, _, around in reversed(order):
        left[id(x)] = own[id(x)] + sum(left[id(p)] for p in x.parts if not isinstance(p, str) and not p.cut)
        if x.named and x is not body and not holds[id(x)]:
            x.cut = not left[id(x)] or left[id(x)] * MINOR < total or articles > around or x.readers and beside * MINOR_BESIDE >= total


def parse(page: str) -> Node:
    """The tree of a page; what is cut whatever it holds keeps its place but not its content."""
    root = Node("html", None, False)
    opened = Open(root)
    i, n = 0, len(page)

    def put(text: str, at: Node) -> None:
        if text and not at.cut:
            at.parts.append(entities.unescape(text) if "&" in text else text)

    while i < n:
        m = TAG.search(page, i)
        put(page[i : m.start() if m else n], opened.stack[-1])
        if m is None:
            break
        if m[2] is None:  # a comment or declaration
            mark = "-->" if page.startswith("<!--", m.start()) else ">"
            end = page.find(mark, m.end())
            i = n if end < 0 else end + len(mark)
            continue
        rest = REST.match(page, m.end())
        end = rest.end() - 1 if rest else page.find(">", m.end())
        i = n if end < 0 else end + 1
        attributes = page[m.end() : n if end < 0 else end]
        tag = m[2].lower()
        if m[1]:
            opened.end(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and len(opened.stack) == 1:
                body = Node("body", root, False)
                root.parts.append(body)
                opened.push(body)
            continue
        opened.before(tag)
        at = opened.stack[-1]
        node = Node(tag, at, *(judge(tag, attributes, at) if not at.cut else (True, True, False)))
        if not at.cut:
            at.parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = RAW_ENDS[tag].search(page, i)
            if close is None:
                break
            if not node.cut:
                put(page[i : close.start()], node)
            end = page.find(">", close.start())
            i = n if end < 0 else end + 1
            continue
        opened.push(node)
    return root


def density(chars: int, tags: int, linked: int, links: int, share: float) -> float:
    """Composite text density, with the share of the body's text that is linked."""
    if not chars:
        return 0.0
    base = math.log(chars * linked / max(chars - linked, 1) + share * chars + math.e)
    ratio = chars / max(linked, 1) * max(tags, 1) / max(links, 1)
    return chars / max(tags, 1) * math.log(max(ratio, 1)) / math.log(base + math.e - 1)


def _weight(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def _measure(body: Node) -> list[Node]:
    """All nodes, parents first, with their counts, densities and sums."""
    order: list[tuple[Node, bool]] = []
    stack = [(body, False)]
    while stack:
        x, in_link = stack.pop()
        in_link = in_link or x.tag == "a"
        order.append((x, in_link))
        stack.extend((p, in_link) for p in x.parts if not isinstance(p, str) and not p.cut)
    own: dict[int, int] = {}
    for x, _ in reversed(order):
        own[id(x)] = sum(_weight(p) for p in x.parts if isinstance(p, str))
        kids = [p for p in x.parts if not isinstance(p, str) and not p.cut]
        x.chars, x.tags = own[id(x)] + sum(k.chars for k in kids), len(kids) + sum(k.tags for k in kids)
        x.linked = x.chars if x.tag == "a" else sum(k.linked for k in kids)
        x.links = (x.tag == "a") + sum(k.links for k in kids)
    share = body.linked / max(body.chars, 1)
    for x, in_link in reversed(order):
        x.density = density(x.chars, x.tags, x.linked, x.links, share)
        text = own[id(x)]
        x.total = density(text, 1, text if in_link else 0, 1, share) + sum(p.density for p in x.parts if not isinstance(p, str) and not p.cut)
    return [x for x, _ in order]


def _chosen(body: Node) -> set[int]:
    """The nodes whose subtrees are the main text."""
    order = _measure(body)
    seed = max(order, key=lambda x: x.total)
    if not seed.chars:
        return set()
    threshold, up = seed.density, seed
    while up is not body and up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
    best: dict[int, Node] = {}
    for x in reversed(order):
        of = [best[id(p)] for p in x.parts if not isinstance(p, str) and not p.cut]
        best[id(x)] = max([x, *of], key=lambda y: y.total)
    taken = set()
    for x in order:
        if x is not body and x.density >= threshold and x.chars or x is seed:
            pick = best[id(x)]
            taken.add(id(pick.article or pick))
    return taken


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    body = next((p for p in root.parts if not isinstance(p, str) and p.tag == "body"), root)
    cut_named(body)
    taken = _chosen(body)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(body, False)]
    while stack:
        x, inside = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if inside:
                line.append(x)
        elif x.cut:
            if x.tag in BLOCK:
                flush()
        else:
            inside = inside or id(x) in taken
            if x.tag in BLOCK:
                flush()
                stack.append((None, False))
            elif x.tag == "br" or x.tag in CELL:
                line.append(" ")
            stack.extend((p, inside) for p in reversed(x.parts))
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in html], dtype=object)

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
