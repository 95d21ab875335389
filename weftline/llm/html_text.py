"""Main text of web pages by tree scoring.

A page becomes a tree of blocks.  Each block of text passes points for its
length and commas to its ancestors, fewer from level to level; a container's
points are discounted by its share of link text; the best container and those of
its siblings that look like it are kept, without the parts that tag, role or
class name as furniture.  A form, or a block that only its class or id names so,
is kept after all if it holds the main element or most of the points of the
page.  Time is in proportion to the page, however deep or broken it is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, with_columns

# Elements of HTML by what they do to text, and words that sites name parts of a page with.
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_GONE = set("head script style noscript template iframe svg canvas math object audio video nav aside footer form button select textarea dialog menu datalist search title noembed noframes".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend"}
_SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_FURNITURE = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense banner banners billboard breadcrumb breadcrumbs byline comment comments"
    " commentlist consent cookie cookies disqus footer footnav gdpr header leaderboard login masthead menu menus modal nav navbar navigation navigationbar newsletter"
    " notice notices notification notifications overlay pager pagination paywall popup promo promos promotion promoted recommend recommended recommendations related"
    " replies reply respond rss search share sharing shares sidebar sidebars signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription"
    " subscriptions tagcloud taboola teaser toolbar topbar trackback widget widgets alert alerts outbrain".split()
)
# Furniture whose text may well be longer than the article; and words after which the last one names what lies beside.
_OWN_TEXT = set(
    "alert alerts comment comments commentlist consent cookie cookies disqus gdpr modal newsletter notification notifications outbrain popup"
    " recommend recommended recommendations related replies reply respond taboola trackback".split()
)
_BESIDE = {"has", "with", "no", "without"}
# Elements that hold text rather than parts of a page: a name must say nothing but furniture to make them so.
_PASSAGES = set("p blockquote pre li dt dd td th caption figcaption address".split())
_CELLS = ("td", "th", "table")
#: What Node.gone says: kept, gone, gone by its name only, and gone by the name of a part with much text.
_KEPT, _CUT, _NAMED, _NAMED_TEXT = range(4)
_CONTENT = set("article content main post entry story text body page wrapper container".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/>\"']+)", re.S)
_PIECE = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("children", "depth", "direct", "gone", "links", "name", "parent", "passed", "points", "size")

    def __init__(self, name: str, parent: Node | None, gone: int = _KEPT):
        self.name, self.parent, self.gone = name, parent, gone
        self.depth: int = 0 if parent is None else parent.depth + 1
        self.children: list = []
        self.points, self.direct, self.passed, self.size, self.links = 0.0, 0.0, 0.0, 0, 0


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, alone in _ATTRIBUTE.findall(rest):
        out.setdefault((name or alone).lower(), html.unescape(a or b or c))
    return out


def _furniture(name: str, rest: str) -> int:
    """Whether an element is kept, gone or only named as furniture."""
    if name in _GONE and name != "form":
        return _CUT
    here = _NAMED if name == "form" else _KEPT
    if name in ("html", "body") or not rest or rest.isspace():
        return here
    given = _attributes(rest)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in _ROLES:
        return _CUT
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return _CUT
    for word in f"{given.get('class', '')} {given.get('id', '')}".split():
        pieces = _PIECE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())
        if not pieces or pieces[0] in ("has", "with", "no", "without", "is"):
            continue
        first, last = pieces[0] in _FURNITURE, pieces[-1] in _FURNITURE and name != "main" and _BESIDE.isdisjoint(pieces[:-1])
        if pieces[0] in _CONTENT and pieces[-1] == "header":
            last = False
        if name in _PASSAGES:
            first = last = all(w in _FURNITURE for w in pieces)
        if first or last:
            if name in _HEADINGS or name == "article" and pieces[0] in _CONTENT:
                continue
            if name not in _BLOCKS:
                return _CUT
            here = max(here, _NAMED_TEXT if (pieces[0] if pieces[0] in _FURNITURE else pieces[-1]) in _OWN_TEXT else _NAMED)
    return here


class _Open:
    """The elements that are open, outermost first, and where in that row those of each name are."""

    def __init__(self, root: Node):
        self.row, self.places = [root], {}

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.row))
        self.row.append(node)

    def shut(self, place: int) -> None:
        """Ends the element there and all in it; 0, the page itself, ends nothing."""
        while place and len(self.row) > place:
            self.places[self.row.pop().name].pop()

    def outermost(self, names: set[str], inside: int) -> int:
        found = []
        for n in names:
            places = self.places.get(n, [])
            k = bisect_right(places, inside)
            found += places[k : k + 1]
        return min(found, default=0)


def _ends(page: str) -> dict[int, int]:
    """Where the element of each start tag ends, for those that have an end tag, by the place behind the start tag."""
    out, begun = {}, {}
    for tag in _TAG.finditer(page):
        places = begun.setdefault(tag[2].lower(), [])
        if not tag[1]:
            places.append(tag.end())
        elif places:
            out[places.pop()] = tag.end()
    return out


def parse(page: str) -> Node:
    """The tree of block elements; text is (string, is it in a link), inline tags leave no trace."""
    root = Node("#page", None)
    still, link, at, ends = _Open(root), 0, 0, None

    def text(piece: str) -> None:
        if piece:
            still.row[-1].children.append((html.unescape(piece) if "&" in piece else piece, link > 0))

    while True:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            return root
        text(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None or not found["end"]:
            if found.group().startswith("<![CDATA["):
                text(html.escape(found.group()[9:].removesuffix("]]>"), False))
            continue
        name = name.lower()
        if found["close"]:
            place = still.last(name)
            if name == "a":
                link = 0
            elif place and not (name in ("p", "li", "div", "section", "article") and still.last(*_CELLS) > place):
                still.shut(place)
                link = 0
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            if name == "hr":
                still.row[-1].children.append(Node("hr", still.row[-1]))
            elif name == "br":
                text(" ")
            continue
        if name == "a":
            link = 1
            continue
        gone = _furniture(name, found["rest"])
        if name not in _BLOCKS and not gone:
            continue
        if name in _CLOSES_P and still.last("p") > still.last(*_CELLS):
            still.shut(still.last("p"))
        if name in _SELF_CLOSING:
            shut, stop = _SELF_CLOSING[name]
            still.shut(still.outermost(shut, still.last(*stop)))
        if found["rest"].endswith("/") and name not in _BLOCKS or name in ("html", "body") and still.last(name):
            continue
        child = Node(name, still.row[-1], gone)
        still.row[-1].children.append(child)
        if name in _BLOCKS or name in _GONE:
            still.push(child)
        else:
            # a hidden inline element: what it holds goes, up to its end tag
            ends = _ends(page) if ends is None else ends
            at = ends.get(at, at)


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _own(node: Node) -> tuple[str, int, float]:
    """The text of a node itself, how much of it is in links, and its points."""
    own = [c for c in node.children if not isinstance(c, Node)]
    whole = " ".join("".join(t for t, _ in own).split())
    linked = sum(len(t.strip()) for t, linked in own if linked)
    if not whole or node.name in _HEADINGS:
        return whole, linked, 0.0
    commas = whole.count(",") + whole.count("،") + whole.count("、") + whole.count("，")
    return whole, linked, (1 + commas + min(len(whole) / 100, 10)) * (1 - min(1.0, linked / len(whole)))


def _reconsider(root: Node) -> None:
    """Keeps what is furniture by its name only, but holds the main element, or most of the points of a page without an article elsewhere."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.gone != _CUT]
    if not any(n.gone for n in order):
        return
    worth: dict[Node, float] = {}
    holds: dict[Node, set[str]] = {}
    for node in reversed(order):
        mine = worth[node] = worth.get(node, 0.0) + _own(node)[2]
        inside = holds.setdefault(node, set())
        if node.gone == _NAMED_TEXT and not inside:
            node.gone = _CUT
        elif node.parent is not None:
            worth[node.parent] = worth.get(node.parent, 0.0) + mine
            above = holds.setdefault(node.parent, set())
            above |= inside
            if node.name in ("article", "main") and not node.gone and mine:
                above.add(node.name)
    shut: set[Node] = set()
    for node in order:
        if node.gone or node.parent in shut:
            shut.add(node)
    # articles with points that count without what is only named, and for each node those around it: how many, and the most points
    articles = sum(1 for n in order if n.name in ("article", "main") and n not in shut and worth[n] > 0)
    around: dict[Node, tuple[int, float]] = {}
    for node in order:
        count, most = around.get(node.parent, (0, 0.0))
        here = node.name in ("article", "main") and node not in shut and worth[node] > 0
        around[node] = (count + here, max(most, worth[node]) if here else most)
    shut.clear()
    for node in order:
        if node.parent not in shut and node.gone in (_NAMED, _NAMED_TEXT):
            count, most = around[node]
            if "main" in holds[node] or (worth[node] > 0.5 * worth[root] and count == articles and most <= worth[node]):
                node.gone = _KEPT
        if node.gone or node.parent in shut:
            shut.add(node)


def _score(root: Node) -> list[Node]:
    """Sizes, links and points of every kept node; the containers.

    A block's points go to its container whole, to the next one by half, and on
    from there by a third from level to level.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.gone]
    for node in order:
        whole, linked, points = _own(node)
        node.size, node.links = len(whole), min(len(whole), linked)
        if points:
            inner = node.name in _PASSAGES or node.name == "tr"
            (node.parent if inner and node.parent is not None else node).direct += points
    for node in reversed(order):
        node.points = node.direct + node.passed
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.passed += node.direct / 2 + node.passed / 3
    return [n for n in order if n.size and n.name not in ("p", "tr", "tbody", "thead", "tfoot", "li", "td", "th", "dt", "dd", *_HEADINGS)]


def _worth(node: Node) -> float:
    return node.points * (1 - min(1.0, node.links / max(1, node.size)))


def _is_links(node: Node) -> bool:
    return node.size > 0 and node.links > 0.6 * node.size


def _is_menu(node: Node, before: str) -> bool:
    """Whether a list or table is nothing but links, and neither a heading nor a colon leads up to it."""
    return node.name in ("ul", "ol", "dl", "table") and node.size > 0 and node.links > 0.95 * node.size and not before.endswith(":")


def _chosen(root: Node) -> list[Node]:
    """The best container and the siblings that are kept with it, in page order."""
    containers = _score(root)
    if not containers:
        return []
    best = max(containers, key=lambda n: (_worth(n), -n.depth))
    for node in reversed(list(_up(best))):
        if node.name in ("article", "main") and not node.gone and _worth(node) > 0:
            best = node
            if node.name == "article" or not any(isinstance(c, Node) and c.name == "article" for c in node.children):
                break
    if best.parent is None or best.name in ("body", "html"):
        return [best]
    floor = max(3.0, 0.2 * _worth(best))
    out = []
    for child in best.parent.children:
        if child is best:
            out.append(child)
        elif isinstance(child, Node) and not child.gone and child.size and not _is_links(child):
            if best.name in ("article", "main"):
                keep = child.name == best.name and _worth(child) >= floor
            elif child.name == "p":
                keep = child.links < 0.25 * child.size
            else:
                keep = child.name in _HEADINGS or _worth(child) >= floor
            if keep:
                out.append(child)
    return out


def _blocks(node: Node, out: list[str]) -> None:
    """The texts of blocks under a node, in page order."""
    stack: list[tuple[Node, int, bool]] = [(node, 0, False)]
    run: list[str] = []

    def close() -> None:
        nonlocal led
        whole = " ".join("".join(run).split())
        run.clear()
        if whole:
            out.append(whole)
            led = ":" if here.name in _HEADINGS and here.name != "h1" else whole

    led, here = "", node
    while stack:
        here, at, only = stack.pop()
        while at < len(here.children):
            child = here.children[at]
            at += 1
            if not isinstance(child, Node):
                if not only or here.name in _HEADINGS:
                    run.append(child[0])
                continue
            if child.name not in _BLOCKS:
                continue
            close()
            if child.gone or _is_menu(child, led):
                continue
            stack.append((here, at, only))
            here, at, only = child, 0, only or child.name == "header"
        close()


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, parted by an empty line; empty if there is none."""
    if not page:
        return ""
    out: list[str] = []
    root = parse(page)
    _reconsider(root)
    for node in _chosen(root):
        _blocks(node, out)
    return "\n\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html, ...).

    The whole html counts, however long or broken: what is cut off in a tag is
    dropped, elements left open end with their parents.  Null or empty html, or
    a page without main text, gives an empty text.  Character references are
    decoded, white space in a block is one space, blocks are parted by two line
    feeds; n_chars counts code points.  Repeated rows and null ids or urls stay
    rows; no rows in: none out.  Other columns are ignored.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return map_batches(with_columns(pages, ["page_id", "url", "html"]), one, "page_id long, url string, text string, n_chars long")
