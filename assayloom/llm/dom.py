"""A small DOM: block elements as nodes, and text pieces that belong to a node and a block."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML: elements by what their text and end tags mean.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe title".split())  # read up to their own end tag, whatever is inside
HIDDEN = set("noscript template svg canvas object math head".split())  # no text, but have elements
_IN_HEAD = set("base link meta script style noscript template title head html".split())
_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in RAW | HIDDEN}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark picture q "
    "rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
# A start tag of the key closes an open element among the values (up to the given fence).
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A tag ends at its >; a < outside quotes before that makes it text.
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_MARKING = re.compile(
    r"(?<![\w-])(class|id|role|hidden|style|data-main|aria-[\w-]+)\s*"
    r"(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I,
)


@dataclass
class Page:
    """Nodes in page order (0 is the root): parent, tag, marks (class, id, role ...), label.

    ``texts`` are (node, block, text, is link); a new block begins at every block element's
    start and end.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    marks: list[str] = field(default_factory=lambda: [""])
    label: list[int] = field(default_factory=lambda: [0])
    texts: list[tuple[int, int, str, bool]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Whatever the markup, a page; unclosed and stray tags are mended as browsers do.

    A raw element without end tag takes the rest of the page; a hidden one is read as any other
    element then, but the head ends at the body or at the first element or text of a body. The time
    is in proportion to the page, however deep it is and whatever is left open.
    """
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack
    hidden: list[int] = []  # places in the stack
    last: dict[str, int] = {}  # where the last end tag of a name begins, -1 if there is none
    block = links = at = 0

    def close(upto: int) -> None:
        nonlocal links
        for tag, _ in stack[upto:]:
            links -= tag == "a"
            places[tag].pop()
        del stack[upto:]
        while hidden and hidden[-1] >= upto:
            hidden.pop()

    def push(name: str, node: int) -> None:
        nonlocal links
        links += name == "a"
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def innermost(names: set[str]) -> int:
        """The last place in the stack of one of these names; 0 if none is open."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def ends_after(name: str, start: int) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in _END[name].finditer(html)), default=-1)
        return last[name] >= start

    def in_head() -> bool:
        return bool(hidden) and stack[hidden[-1]][0] == "head"

    def text_upto(end: int) -> None:
        if end > at:
            text = unescape(html[at:end]) if "&" in html[at:end] else html[at:end]
            if in_head() and not text.isspace():
                close(hidden[-1])
            if not hidden:
                page.texts.append((stack[-1][1], block, text, links > 0))

    while m := _MARKUP.search(html, at):
        name = (m[2] or "").lower()
        text_upto(m.start())
        at = m.end()
        if not name:
            if m[0].startswith("<![CDATA[") and not hidden:
                page.texts.append((stack[-1][1], block, m[0][9:].removesuffix("]]>"), links > 0))
            continue
        if not m[1] and in_head() and name not in _IN_HEAD:
            close(hidden[-1])
        inline = name in INLINE
        if name == "br":
            if not hidden:
                page.texts.append((stack[-1][1], block, "\n", False))
            continue
        if m[1]:
            inner = hidden[-1] if hidden else 1
            opened = innermost({name})
            block += not inline and not hidden
            if opened >= inner:
                close(opened)
            continue
        if name in RAW:
            block += not hidden
            at = _END[name].search(html, at).end() if ends_after(name, at) else len(html)
            continue
        if name in HIDDEN and (name == "head" or ends_after(name, at)):
            block += not hidden
            if not (m[0].endswith("/>") and name in ("svg", "math")):
                hidden.append(len(stack))
                push(name, stack[-1][1])
            continue
        if hidden:
            if name not in VOID:
                push(name, stack[-1][1])
            continue
        if not inline:
            block += 1
            among, fence = _CLOSES.get(name, ({"p"}, set()))
            while (inner := innermost(among)) > innermost(fence):
                close(inner)
                if name != "tr":
                    break
        marks, label = "", page.label[stack[-1][1]]
        for k, *values in _MARKING.findall(m[3]) if len(m[3]) > 3 else ():
            value = next(filter(None, values), "")
            if k.lower() == "data-main":
                label = int(value == "1")
            elif k.lower() == "style":
                marks += " style-hidden" if re.search(r"display\s*:\s*none", value, re.I) else ""
            elif k.lower() in ("hidden", "aria-hidden"):
                marks += "" if value == "false" else " style-hidden"
            elif not k.lower().startswith("aria"):
                marks += " " + value
        node = stack[-1][1]
        if not inline or (marks and name != "a"):
            page.parent.append(node)
            page.tag.append(name)
            page.marks.append(marks.lower())
            page.label.append(label)
            node = len(page.parent) - 1
        if name not in VOID:
            push(name, node)
    text_upto(len(html))
    return page
