"""A forgiving HTML reader: elements, their text, and block boundaries in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements whose content is never text of the page.
HIDDEN = frozenset("head title script style noscript template iframe object svg math canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset address details summary dialog hr".split()
)
#: Elements that can stand in head; any other start tag ends it, as text does. Of html and head only the first count.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: What a start tag closes: elements of these names, up to a boundary element.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES |= {t: ({"p"}, BLOCK - {"p"}) for t in BLOCK - set(CLOSES) - {"html", "body"}}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
_ATTR = re.compile(r"""(?<![^\s"'=<>/])([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PART = re.compile(r"[a-z0-9]+")


#: Attributes whose words tell what an element is for.
TELLING = frozenset("class id role itemprop aria-label".split())


def _tokens(attributes: str) -> frozenset:
    found = (("".join(v)).lower() for k, *v in _ATTR.findall(attributes) if k.lower() in TELLING)
    return frozenset(t for v in found for t in _PART.findall(v))


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset = frozenset()
    children: list[int] = field(default_factory=list)
    end: int = 0


@dataclass
class Page:
    """Block elements (inline ones are folded into them) and events: (node, text) or (node, None) for a boundary.

    ``linked``: (node, characters) of each text inside a link.
    """

    nodes: list[Node]
    events: list[tuple[int, str | None]]
    linked: list[tuple[int, int]]


class _Open:
    """The open elements: (name, the block element it is or stands in), and where those of a name and blocks stand, so that no search walks them."""

    def __init__(self):
        self.all: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, name: str, own: int) -> None:
        self.places.setdefault(name, []).append(len(self.all))
        if name in BLOCK:
            self.blocks.append(len(self.all))
        self.all.append((name, own))

    def pop(self) -> tuple[str, int]:
        name, own = self.all.pop()
        self.places[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        return name, own

    def last(self, names: set[str] | tuple[str, ...]) -> int:
        """Where the innermost element of these names stands, 0 if none is open."""
        return max((own[-1] for n in names if (own := self.places.get(n))), default=0)

    def closed_by(self, name: str) -> int:
        """Where the element stands that a start tag of this name ends, 0 if it ends none."""
        goes, stops = CLOSES[name]
        if goes == {"p"}:  # the stops are all other blocks
            return self.blocks[-1] if self.all[self.blocks[-1]][0] == "p" else 0
        at = self.last(goes)
        return at if at > self.last(stops) else 0


def parse(source: str) -> Page:
    """The page of a source, in time linear in its length."""
    nodes = [Node("html", -1, 0)]
    events: list[tuple[int, str | None]] = []
    open_ = _Open()
    hidden = links = 0  # open hidden elements and links
    linked: list[tuple[int, int]] = []
    at, size = 0, len(source)
    marked = source.rfind(">") + 1  # no tag ends behind it

    def pop(k: int) -> None:
        nonlocal hidden, links
        while len(open_.all) > k:
            name, own = open_.pop()
            hidden -= name in HIDDEN
            links -= name == "a"
            if name in BLOCK and not hidden:
                nodes[own].end = len(nodes)
                events.append((open_.all[-1][1], None))

    def end_head() -> None:
        while open_.all[-1][0] == "head":
            pop(len(open_.all) - 1)

    def text(a: int, b: int) -> None:
        if hidden and open_.all[-1][0] == "head" and source[a:b].strip():
            end_head()
        if a < b and not hidden:
            events.append((open_.all[-1][1], html.unescape(source[a:b])))
            if links:
                linked.append((open_.all[-1][1], b - a))

    search = _TOKEN.search
    while m := search(source, at, marked):
        text(at, m.start())
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            if source.startswith("<!--", m.start()) and not source.endswith("-->", m.start(), at):
                at = size  # a comment without an end
            continue
        closing = m.group(1) or m.group(4)
        if closing:
            if k := open_.last((name,)):
                pop(k)
            continue
        if hidden and name not in IN_HEAD:
            end_head()
        if name == "br":
            if not hidden:
                events.append((open_.all[-1][1], " "))
            continue
        if name == "html":
            continue
        given = m.group(3) if m.group(2) else m.group(6)
        if name in CLOSES and (k := open_.closed_by(name)):
            pop(k)
        if name in VOID:
            if name == "hr":
                events.append((open_.all[-1][1], None))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at, marked)
            at = end.end() if end else size
            continue
        if given.rstrip().endswith("/") and name not in BLOCK:
            continue
        own = open_.all[-1][1]
        if name in BLOCK and not hidden:
            own = len(nodes)
            up = open_.all[-1][1]
            nodes.append(Node(name, up, nodes[up].depth + 1, _tokens(given) if given.strip() else frozenset()))
            nodes[up].children.append(own)
            events.append((own, None))
        open_.push(name, own)
        hidden += name in HIDDEN
        links += name == "a"
    rest = source.find("<!--", at)
    text(at, size if rest < 0 else rest)
    pop(1)
    nodes[0].end = len(nodes)
    return Page(nodes, events, linked)
