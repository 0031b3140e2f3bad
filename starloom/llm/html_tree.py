"""A small tolerant HTML reader: the tree of block elements and the text runs in them."""

from __future__ import annotations

import html
import re

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe xmp noembed noframes".split())
#: canvas, noscript and object hold content to show in their place.
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Their own elements make no blocks; the start of an HTML block ends an unclosed one.
FOREIGN = frozenset("math svg".split())
BREAKOUT = frozenset("address article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table td th tr ul".split())
#: The end of a raw element. Searched in the page itself: lower-casing can change its length.
RAW_END = {t: re.compile(rf"</{t}(?![a-z0-9-])[^>]*(?:>|\Z)", re.IGNORECASE | re.ASCII) for t in RAW}
#: Elements whose start ends an open one of the named kinds, if no element of the second kind lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block element: its parent's place, its names, and its text runs between child blocks."""

    __slots__ = ("link", "mark", "names", "parent", "runs", "tag", "text")

    def __init__(self, parent: int, tag: str, names: str, mark: str | None):
        self.parent, self.tag, self.names, self.mark = parent, tag, names, mark
        self.runs: list[int] = []
        self.text = self.link = 0


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, blocks): nodes in page order, parents first; blocks are (node, text) with white space made single."""
    nodes = [Node(-1, "#root", "", None)]
    stack = [("#root", 0)]  # every open element and the block it belongs to
    open_at: dict[str, list[int]] = {}  # by tag, the places of its open elements in the stack
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    linked = [0]

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if anchors and piece.strip():
                linked[0] += len(piece)

    def close() -> None:
        if parts:
            run = " ".join(html.unescape("".join(parts)).split())
            if run:
                node = nodes[stack[-1][1]]
                node.runs.append(len(blocks))
                node.text += len(run)
                node.link += min(len(run), linked[0])
                blocks.append((stack[-1][1], run))
            parts.clear()
        linked[0] = 0

    def cut(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop()[0]].pop()

    at, anchors, foreign = 0, 0, False
    unclosed: set[str] = set()
    for m in iter(lambda: TOKEN.search(source, at), None):
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a" and anchors:
                anchors -= 1
            if tag in FOREIGN:
                foreign = False
            if tag in INLINE or tag in FOREIGN:
                continue
            if open_at.get(tag):
                foreign = False
                close()
                cut(open_at[tag][-1])
                anchors = 0
            continue
        if tag in RAW:
            if m[3].rstrip().endswith("/") and tag not in ("script", "style", "title", "textarea"):
                continue
            end = None if tag in unclosed else RAW_END[tag].search(source, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(source)
            else:
                unclosed.add(tag)
            continue
        if tag in FOREIGN:
            foreign = not m[3].rstrip().endswith("/")
            continue
        if tag in INLINE:
            if tag == "a" and not m[3].rstrip().endswith("/"):
                anchors += 1
            elif tag in ("br", "wbr", "img"):
                text(" " if tag != "wbr" else "")
            continue
        if foreign and tag not in BREAKOUT:
            continue
        foreign = False
        close()
        anchors = 0
        if tag in VOID:
            continue
        kinds, walls = ENDS.get(tag, ({"p"}, {"td", "th", "li", "div", "section", "article"}))
        nearest = max((open_at[t][-1] for t in kinds if open_at.get(t)), default=0)
        if nearest and nearest > max((open_at[t][-1] for t in walls if open_at.get(t)), default=0):
            cut(nearest)
        values = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        names = " ".join(values.get(k, "") for k in ("id", "class", "role", "itemprop", "aria-label")) if values else ""
        if values and ("hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I)):
            names += " hidden-element"
        nodes.append(Node(stack[-1][1], tag, names, values.get("data-main")))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(nodes) - 1))
        if m[3].rstrip().endswith("/") and not values:
            cut(len(stack) - 1)
    text(source[at:])
    close()
    return nodes, blocks
