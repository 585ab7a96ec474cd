"""HTML to leaf blocks: runs of text between block-level tags, with their ancestors.

The time taken is in proportion to the page, whatever its markup: every open
element keeps what its blocks need of its ancestors, open tags are found by their
names, and after one tag without an end quotes count no longer.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|(<)", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|(<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "noembed", "noframes", "xmp", "math", "object", "canvas", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input button".split())
#: A start tag ends these when they are open, up to the element after the colon.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody tfoot", ("table",))}
_CLOSES = {k: (frozenset(v[0].split()), frozenset(v[1])) for k, v in _CLOSES.items()}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str  # the nearest block-level element
    path: frozenset[str]  # its ancestors' tags, itself included
    names: frozenset[str]  # words of class, id and role along the path
    linked: int  # characters within links
    depth: int
    parent: int  # a number of the element that holds tag


@dataclass(slots=True)
class _Open:
    """An open element, with what a block in it inherits."""

    tag: str
    serial: int
    path: frozenset[str]
    names: frozenset[str]
    depth: int
    block: int  # where on the stack the nearest block-level element is
    holder: int  # the number of the block-level element around that one


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            out += [x.lower() for x in _NAME.findall(html.unescape(m[2] or m[3] or m[4] or ""))]
        elif key == "hidden" or key == "aria-hidden" and (m[2] or m[3] or m[4]) == "true":
            out.append("hidden")
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", m[2] or m[3] or ""):
            out.append("hidden")
    return tuple(out)


def blocks(page: str, known: Callable[[str], bool] | None = None) -> list[Block]:
    """The leaf blocks of a page, in its order.  Broken markup ends elements as browsers do, as far as blocks are concerned.

    known: which tags and names are kept in path and names; all if not given.
    """
    out: list[Block] = []
    root = _Open("body", 0, frozenset(), frozenset(), 0, 0, 0)
    stack = [root]  # the first one stays
    places: dict[str, list[int]] = {}  # by tag, where open ones stand
    text: list[str] = []
    linked = serial = 0
    at, end, last = 0, len(page), page.rfind(">")
    token = _TOKEN

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = stack[-1]
                out.append(Block(joined, stack[top.block].tag, top.path, top.names, min(linked, len(joined)), top.depth, top.holder))
        linked = 0

    def pop(to: int) -> None:
        if stack[-1].block >= to:
            flush()
        while len(stack) > to:
            tag = stack.pop().tag
            if tag:
                places[tag].pop()

    def nearest(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def more(own: frozenset[str], new: Iterable[str]) -> frozenset[str]:
        new = [x for x in new if x not in own and (known is None or known(x))]
        return own.union(new) if new else own

    while at < end:
        m = token.match(page, at) if at <= last or page[at] != "<" else None
        if m is None and token is _TOKEN and at <= last:  # a quote without its end
            token = _PLAIN
            m = token.match(page, at)
        if m is None:  # a tag without its end
            m = _REST.match(page, at)
        at = m.end()
        if m.re is _REST or m[4] or m[5]:
            text.append(m[0])
            if places.get("a"):
                linked += len(m[0])
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places.get("p"):
                flush()
            if places.get(tag) and (tag not in _INLINE or places[tag][-1] > stack[-1].block):
                pop(places[tag][-1])
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW_END and not m[3].rstrip().endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag not in _INLINE:
            around = stack[-1].block
            if stack[around].tag == "p" or stack[around].tag in _HEADINGS and tag in _HEADINGS:  # a block ends a paragraph, a heading ends a heading
                pop(around)
            if tag in _CLOSES:
                ends, limit = _CLOSES[tag]
                while (i := nearest(ends)) > nearest(limit):
                    pop(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            flush()
        elif tag == "a" and places.get("a"):
            stack[places["a"].pop()].tag = ""  # ends, wherever it stands
        if tag not in _VOID and not (m[3].endswith("/") and tag not in _INLINE and tag not in ("p", "div", "section", "article")):
            serial += 1
            top, names = stack[-1], _names(m[3]) if m[3] else ()
            places.setdefault(tag, []).append(len(stack))
            if tag in _INLINE:
                stack.append(_Open(tag, serial, top.path, more(top.names, names), top.depth, top.block, top.holder))
            else:
                stack.append(_Open(tag, serial, more(top.path, (tag,)), more(top.names, names), top.depth + 1, len(stack), stack[top.block].serial))
    flush()
    return out


_REST = re.compile(r"<?[^<]*")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
