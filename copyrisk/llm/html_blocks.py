"""Leaf blocks of an HTML page, with the elements around them, from one pass over its markup."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Elements whose content is no text.
_RAW = re.compile(r"(script|style|noscript|template|svg|iframe)\b", re.I)
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: HTML's element kinds
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Any of these end tags closes the innermost open one.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an opening tag closes, if it is open within the nearest of the elements after the colon.
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ())}


class Node:
    """An element's place on a page: its tag and names below those around it.  Equal places are one node."""

    __slots__ = ("parent", "tag", "names", "depth", "below", "known")

    def __init__(self, parent: Node | None, tag: str, names: str):
        self.parent, self.tag, self.names = parent or self, tag, names
        self.depth = parent.depth + 1 if parent else 0
        self.below: dict[tuple[str, str], Node] = {}
        self.known = None  # kept here by whoever derives features

    def child(self, tag: str, names: str) -> Node:
        if (tag, names) not in self.below:
            self.below[tag, names] = Node(self, tag, names)
        return self.below[tag, names]


@dataclass
class Block:
    """A run of text between block-level tags, in the innermost element ``node``."""

    node: Node
    text: str
    linked: int  # characters of it in links

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """(tag, names) from the root inwards."""
        out, node = [], self.node
        while node.depth:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(out[::-1])


def _attributes_end(html: str, at: int, last: dict[str, int], dead: set[int]) -> int:
    """Where the ``>`` outside quotes is that ends a tag's attributes; -1 if a quote is left open.

    ``last``: the last place of each quote; ``dead``: places outside quotes from which no end is
    found, so that none is searched from twice."""
    seen = []
    while at not in dead:
        seen.append(at)
        m = _STOP.search(html, at)
        if m and m[0] == ">":
            return m.start()
        if not m or m.start() >= last[m[0]]:
            break
        at = html.find(m[0], m.end()) + 1
    dead.update(seen)
    return -1


def _markup(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, slash, tag, attributes`` of each piece of markup, in time linear in the page.

    Comments and declarations have no tag, nor has a script or the like with its content, but that has a slash."""
    last, dead = {q: html.rfind(q) for q in "\"'"}, set()
    ends = html.rfind(">")
    i = html.find("<")
    while i >= 0:
        found = None
        if html.startswith("<!--", i):
            e = html.find("-->", i + 4)
            found = (i, len(html) if e < 0 else e + 3, "", "", "")
        elif i < ends:
            if raw := _RAW.match(html, i + 1):
                e = re.compile(rf"</{raw[1]}\s*>", re.I).search(html, html.find(">", raw.end()) + 1)
                found = (i, e.end() if e else len(html), "/", "", "")
            elif tag := _TAG.match(html, i + 1):
                e = _attributes_end(html, tag.end(), last, dead)
                e = html.find(">", tag.end()) if e < 0 else e
                found = (i, e + 1, tag[1], tag[2].lower(), html[tag.end() : e])
            elif html[i + 1] in "/!?":
                found = (i, html.find(">", i + 2) + 1, "", "", "")
        if found:
            yield found
        i = html.find("<", found[1] if found else i + 1)


def _names(attributes: str) -> str:
    return " ".join(_WORDS.findall(" ".join(m[1].strip("\"'") for m in _NAMES.finditer(attributes)))).lower() if attributes else ""


def blocks(html: str) -> list[Block]:
    """The page's blocks that hold text, in page order, references decoded, white space folded.

    Scripts, styles and comments have no text.  Unclosed elements end where HTML says (a
    paragraph at the next block, a list item at the next item) or with their parent.
    """
    root = Node(None, "", "")
    out: list[Block] = []
    stack: list[Node] = []
    open_at: dict[str, list[int]] = {}  # of each tag, its places in the stack
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(stack[-1] if stack else root, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def nearest(tags: Iterable[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def cut(place: int) -> None:
        while len(stack) > place:
            open_at[stack.pop().tag].pop()

    for start, end, slash, tag, attributes in _markup(html):
        if start > at:
            parts.append(html[at:start])
            linked += (start - at) * (links > 0)
        at = end
        if not tag:
            if slash:  # a script or the like separates words, a comment doesn't
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if slash else 1))
            elif tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            continue
        flush()
        if slash:
            links = 0
            if (place := nearest(HEADINGS if tag in HEADINGS else (tag,))) >= 0:
                cut(place)
            continue
        if tag in CLOSES:
            wanted, within = CLOSES[tag]
            if (place := nearest(wanted.split())) > nearest(within):
                cut(place)
        elif stack and stack[-1].tag == "p":
            cut(len(stack) - 1)
        if tag not in VOID:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((stack[-1] if stack else root).child(tag, _names(attributes)))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out
