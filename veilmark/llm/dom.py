"""A small, forgiving HTML tree: enough of the tag rules to know which text stands in which element.

Reading takes time in proportion to the page, however broken it is: quotes that lead nowhere are remembered, and an
element knows the nearest block and list item around it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements by their role in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What a start tag closes if it is open: `p` by every block, an item by the next item.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
#: An item is not closed across these.
SCOPE = frozenset("ul ol dl table tbody thead tfoot select html body article main div section".split())
_ITEMS = frozenset(t for tags in CLOSES.values() for t in tags)

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


class Node:
    """An element; `children` holds nodes and text strings in page order, `block` and `item` are the nearest such elements, itself included."""

    __slots__ = ("block", "children", "item", "parent", "raw_attributes", "tag")

    def __init__(self, tag: str, raw_attributes: str = "", parent: Node | None = None) -> None:
        self.tag, self.raw_attributes, self.parent, self.children = tag, raw_attributes, parent, []
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.item = self if parent is None or tag in _ITEMS or tag in SCOPE else parent.item

    def attributes(self) -> dict[str, str]:
        if not self.raw_attributes:
            return {}
        text, found, at = self.raw_attributes, {}, 0
        no_quote = {q for q in "\"'" if text.count(q) == 1}  # an odd quote closes nothing
        if no_quote:
            text = text.translate({ord(q): " " for q in no_quote})
        while m := _ATTRIBUTE.search(text, at):
            found[m[1].lower()] = unescape(m[2] or m[3] or m[4] or "")
            at = m.end()
        return found


class _Tags:
    """Finds the end of a tag: the first `>` outside quotes, or the first at all where quotes lead to none."""

    def __init__(self, html: str) -> None:
        self.html, self.dead = html, set()
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` has its `>`; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        place, opened = at, []
        while m := _STOP.search(self.html, place):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead or self.last[m[0]] <= m.start():
                break
            opened.append(m.start())
            place = self.html.find(m[0], m.end()) + 1
        self.dead.update(opened)
        return self.html.find(">", at)


def parse(html: str | None) -> Node:
    """The tree of a page. Unclosed, unopened and crossed tags are put right as far as text needs it."""
    root = at = Node("#root")
    html, pos = html or "", 0
    tags, opened = _Tags(html), Counter()

    def leave(node: Node, to: Node) -> Node:
        """Closes every element from `node` up to `to`; the one around it is where the page goes on."""
        while True:
            opened[node.tag] -= 1
            if node is to:
                return node.parent
            node = node.parent

    while pos < len(html):
        start = html.find("<", pos)
        if start != pos:
            stop = len(html) if start < 0 else start
            at.children.append(unescape(html[pos:stop]))
            pos = stop
            continue
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 4)
            pos = len(html) if end < 0 else end + 3
            continue
        m = _NAME.match(html, pos)
        end = tags.end(m.end()) if m else html.find(">", pos) if html.startswith(("<!", "<?"), pos) and pos < tags.last[">"] else -1
        if end < 0:
            at.children.append("<")
            pos += 1
            continue
        pos, raw = end + 1, html[m.end() : end] if m else ""
        if m is None:
            continue
        tag = m[1].lower()
        if html.startswith("</", m.start()):
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(at, node)
            continue
        if tag in BLOCK and at.block.tag == "p":
            at = leave(at, at.block)
        if tag in CLOSES and at.item.tag in CLOSES[tag]:
            at = leave(at, at.item)
        node = Node(tag, raw, at)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            pos = html.find(">", close.start()) + 1 or len(html) if close else len(html)
        elif tag not in VOID and not raw.endswith("/"):
            opened[tag] += 1
            at = node
    return root
