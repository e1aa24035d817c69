"""HTML pages as a sequence of text blocks, each with the element that it stands in.

What scripts, styles, titles, text areas and frames hold is no block, to the page's end where they are not closed,
as the HTML standard has it. The fallback content of media and of noscript, templates, the choices of a form's lists
and formulas' annotations are left out where the element is closed; where it is not, its start tag alone is ignored,
so that no text after it is lost. All other text, that of formulas and drawings too, is in a block.
"""

from __future__ import annotations

import html
import re
from collections import Counter

# Element names by the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
FALLBACK = set("noscript template object canvas audio video select datalist annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split())
#: Elements whose start ends an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?>[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SAME = {name: re.compile(rf"<(/?){name}\b[^>]*>", re.I) for name in FALLBACK}


class Node:
    """An open element: its tag's words, and its parent. cache is for what a reader sums along the path."""

    __slots__ = ("words", "parent", "cache")

    def __init__(self, words: tuple[str, ...], parent: Node | None):
        self.words, self.parent, self.cache = words, parent, None


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The words of all elements around the block, outermost first."""
        out, node = [], self.node
        while node:
            out.append(node.words)
            node = node.parent
        return tuple(w for words in reversed(out) for w in words)


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    open_names: Counter = Counter()
    text: list[str] = []
    state = {"a": 0, "linked": 0}
    unclosed: set[str] = set()

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, stack[-1][1] if stack else None, state["linked"]))
            text.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if state["a"]:
                state["linked"] += len(piece)

    def pop() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    at, end, last = 0, len(page), page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at, max(last, at))
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                add(html.escape(tag[9:].removesuffix("]]>")))
            elif tag.startswith("<!--") and not tag.endswith("-->"):
                at = end
            continue
        name = _NAME.match(tag)[1].lower()
        closing = tag[1] == "/"
        if name in RAW:
            if not closing and not tag.endswith("/>"):
                stop = _ENDS[name].search(page, at)
                at = stop.end() if stop else end
            continue
        if name in FALLBACK:
            if not closing and not tag.endswith("/>") and name not in unclosed:
                stop = _SAME[name].search(page, at)
                if not stop:  # one search to the page's end is enough
                    unclosed.add(name)
                elif stop[1]:
                    at = stop.end()
            continue
        if name in INLINE:
            if name == "a":
                state["a"] = 0 if closing else 1
            elif name == "br":
                add(" ")
            continue
        flush()
        state["a"] = 0
        if closing:
            if open_names[name]:
                while pop() != name:
                    pass
            continue
        if name in VOID:
            continue
        if stack and name in CLOSES and stack[-1][0] in CLOSES[name]:
            pop()
        while stack and stack[-1][0] == "p":
            pop()
        own = [name]
        for a in _ATTR.finditer(tag):
            own += [w for w in _SPLIT.split((a[2] or a[3] or a[4] or "").lower()) if w]
        if not tag.endswith("/>"):
            stack.append((name, Node(tuple(own), stack[-1][1] if stack else None)))
            open_names[name] += 1
    flush()
    return out
