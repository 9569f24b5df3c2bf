"""HTML pages as flat trees: tags, parents and text segments of many pages in arrays."""

from __future__ import annotations

import html
import re
from array import array

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed by the HTML standard: elements without content, whose content is no markup, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that close an open element of these kinds, up to the nearest of the holders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TEXT = "#text"


class Forest:
    """Nodes of many pages in page order; a text segment is a node of its own."""

    def __init__(self) -> None:
        self.tags: dict[str, int] = {TEXT: 0}
        self.attrs: dict[str, int] = {"": 0}
        self.tag, self.attr, self.parent, self.end, self.depth = (array("q") for _ in range(5))
        self.block = array("q")
        self.texts: list[str | None] = []
        self.first: list[int] = []
        self._block = 0

    def _node(self, tag: str, attr: str, parent: int, text: str | None) -> int:
        self.tag.append(self.tags.setdefault(tag, len(self.tags)))
        self.attr.append(self.attrs.setdefault(attr, len(self.attrs)))
        self.parent.append(parent)
        self.end.append(0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.block.append(self._block)
        self.texts.append(text)
        return len(self.texts) - 1

    def add(self, page: str) -> None:
        """Parse one page below a root of its own."""
        self.first.append(len(self.texts))
        self._block += 1
        stack = [self._node("#root", "", -1, None)]
        names = ["#root"]
        # places of open elements in the stack, by name and of those that are no inline ones: nothing looks through the stack
        where: dict[str, list[int]] = {}
        blocks = [0]
        at, ends = 0, self.end

        def close(to: int) -> None:
            while len(stack) > to:
                ends[stack.pop()] = len(self.texts)
                gone = names.pop()
                if names:
                    where[gone].pop()
                if gone not in INLINE:
                    blocks.pop()
                    self._block += 1

        def nearest(kinds: set[str]) -> int:
            return max((where[k][-1] for k in kinds if where.get(k)), default=0)

        def say(text: str) -> None:
            if text and not text.isspace():
                text = html.unescape(text) if "&" in text else text
                self._node(TEXT, "", stack[-1], text)
                ends[len(self.texts) - 1] = len(self.texts)
            elif text:
                self._node(TEXT, "", stack[-1], " ")
                ends[len(self.texts) - 1] = len(self.texts)

        find, last = TOKEN.search, page.rfind(">")
        while at <= last and (m := find(page, at)) is not None:
            if m.start() > at:
                say(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    say(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
                continue
            name = name.lower()
            if m[1] or m[4]:
                if where.get(name):
                    close(where[name][-1])
                continue
            if name in CLOSES:
                kinds, holders = CLOSES[name]
                if (place := nearest(kinds)) > nearest(holders):
                    close(place)
            inline = name in INLINE
            if not inline:
                # a block ends an open paragraph
                if names[blocks[-1]] == "p":
                    close(blocks[-1])
                self._block += 1
            rest = m[3] if m[2] else m[6]
            attr = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(rest)) if rest and "=" in rest else ""
            node = self._node(name, attr, stack[-1], " " if name == "br" else None)
            if name in VOID or rest.endswith("/") and not inline and name in ("svg", "path", "circle", "rect", "use"):
                ends[node] = len(self.texts)
                if not inline:
                    self._block += 1
            elif name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = found.end() if found else len(page)
                ends[node] = len(self.texts)
            else:
                where.setdefault(name, []).append(len(stack))
                if not inline:
                    blocks.append(len(stack))
                stack.append(node)
                names.append(name)
        if at < len(page):
            say(page[at:])
        close(0)
        self._block += 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("tag", "attr", "parent", "end", "depth", "block")}


def parts(attr: str) -> list[str]:
    """Words of class names, ids and roles."""
    return [x.lower() for x in PART.findall(attr)]


def joined(texts: list[str | None], blocks: list[int]) -> str:
    """Texts in page order: white space becomes one space inside a block, blocks are lines."""
    out, run, at = [], [], None
    for text, block in zip(texts, blocks):
        if block != at:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run, at = [], block
        run.append(text)
    if line := " ".join("".join(run).split()):
        out.append(line)
    return "\n".join(out)
