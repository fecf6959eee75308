"""A tolerant reader of HTML: block elements as a tree, and their text runs in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of HTML: elements without content, elements read as raw text, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never text of a page.
HIDDEN = frozenset(
    "head script style title template noscript iframe noembed noframes object svg canvas audio video button select option optgroup textarea datalist".split()
)
#: What a start tag closes, up to the elements at which that stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Block elements that end an open paragraph (cells and the page itself do not occur inside one).
ENDS_PARAGRAPH = BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot"}
_PARAGRAPH_STOP = {"td", "th", "li", "div", "article", "section", "blockquote", "button", "object"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r"\bdata-label\s*=\s*[\"']?(\w+)", re.I)


@dataclass
class Page:
    """Block elements (0 is the root) and text runs."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    label: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])  # characters of own text inside links
    runs: list[tuple[int, str]] = field(default_factory=list)  # element, text


def read(html: str | None) -> Page:
    """Never fails: stray end tags are skipped, open elements end with their parent."""
    page, html = Page(), html or ""
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and the block element each lies in
    hidden = links = at = 0
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                page.runs.append((stack[-1][1], text))

    def close(to: int) -> None:
        nonlocal hidden, links
        if any(name in BLOCK for name, _ in stack[to:]):
            flush()
        for name, _ in stack[to:]:
            hidden -= name in HIDDEN
            links -= name == "a"
        del stack[to:]

    def add(text: str) -> None:
        if text and not hidden:
            buffer.append(unescape(text))  # a reference never reaches over a tag
            if links:
                page.linked[stack[-1][1]] += len(text)

    def find(names, stop) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return 0
        return 0

    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if (i := find({name}, ())) > 0:
                close(i)
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            if name == "textarea" or name in HIDDEN:
                at = end.end() if end else len(html)
                continue
        if name in CLOSES and (i := find(*CLOSES[name])) > 0:
            close(i)
        if name in ENDS_PARAGRAPH and (i := find({"p"}, _PARAGRAPH_STOP)) > 0:
            close(i)
        inside = stack[-1][1]
        if name in BLOCK and not hidden:
            flush()
            page.tag.append(name)
            page.parent.append(inside)
            page.depth.append(page.depth[inside] + 1)
            page.names.append(" ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower() if m[3] else "")
            page.label.append(x[1] if m[3] and (x := _LABEL.search(m[3])) else None)
            page.linked.append(0)
            inside = len(page.tag) - 1
        stack.append((name, inside))
        hidden += name in HIDDEN
        links += name == "a"
    add(html[at:])
    flush()
    return page
