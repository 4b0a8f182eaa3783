"""Lines, visible text and tag paths of HTML as it is found, in plain Python for use inside Arrow tasks."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)")
_FLAT_TAG = re.compile(r"</?[a-zA-Z][^>\n]*>|<[!?][^>\n]*>")
_ELEMENT = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title|<|\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*["']?([^"'>\s]+)""", re.I)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that stand in a run of text and form no block of it.
INLINE = frozenset("a abbr b bdi cite code em font i kbd mark q s strong sub sup u var".split())
#: An open element of this name ends where the next of the same name begins. Cells don't: pages with layout tables put stray cells into a cell.
SELF_CLOSING = frozenset("p li dt dd option".split())


def _newlines(m: re.Match) -> str:
    return "\n" * m[0].count("\n")


def without_hidden(source: str) -> str:
    """``source`` without comments, script, style and title elements; line ends stay."""
    return _HIDDEN.sub(_newlines, source)


def visible_lines(source: str) -> list[str]:
    """Visible text of each line: without tags, comments, script, style and title, references decoded.
    An element or comment that never ends runs to the end of the page."""
    text = _FLAT_TAG.sub("", without_hidden(source))
    if "<" in text:
        text = _TAG.sub(_newlines, text)
    lines = text.split("\n")
    if "&" in text:
        lines = [html.unescape(x) if "&" in x else x for x in lines]
    return lines


def letters(text: str) -> str:
    """The letters of a text, lower case, in order."""
    s = _NOT_LETTERS.sub("", text.lower())
    return s if s.isalpha() or not s else "".join(c for c in s if c.isalpha())


def site(url: str | None) -> str:
    """Host of a URL in lower case without port and leading ``www.``; empty for none."""
    m = _HOST.match(url or "")
    host = m[1].lower() if m else ""
    return host[4:] if host.startswith("www.") else host


def title_of(source: str) -> str:
    """Text of the title element, white space made one blank; empty without one."""
    m = _TITLE.search(source)
    return " ".join(html.unescape(m[1]).split()) if m else ""


class Leaf(NamedTuple):
    """A run of visible text on one line."""

    line: int
    text: str
    block: int  # the nearest element that is not inline
    linked: bool


class Node(NamedTuple):
    """An open element as it stood: its tag with class, id or role (digits masked), and its parent's number."""

    tag: str
    sign: str
    parent: int


def tree(source: str) -> tuple[list[Node], list[Leaf]]:
    """Elements and runs of text of a page. End tags without a start are ignored; what never ends, ends with the page,
    but a block with text on the line it starts on, and on no other, ends before the next block tag of a later line."""
    text = without_hidden(source)
    nodes: list[Node] = [Node("", "", -1)]
    leaves: list[Leaf] = []
    stack = [0]
    blocks = [0]  # for each open element, the nearest that is not inline
    begun = [0]  # line each element starts on
    short: dict[int, bool] = {}  # blocks with text: whether on their first line only
    links = 0
    line = at = 0

    def runs(a: int, b: int) -> None:
        nonlocal line
        part = text[a:b]
        block = blocks[-1]
        if "\n" not in part:
            if part and not part.isspace():
                leaves.append(Leaf(line, part, block, links > 0))
                short[block] = short.get(block, True) and begun[block] == line
            return
        pieces = part.split("\n")
        for k, x in enumerate(pieces):
            if x and not x.isspace():
                leaves.append(Leaf(line + k, x, block, links > 0))
                short[block] = short.get(block, True) and begun[block] == line + k
        line += len(pieces) - 1

    for m in _ELEMENT.finditer(text):
        a = m.start()
        if a > at:
            runs(at, a)
        at = m.end()
        name = m[2]
        if name is None:
            line += m[0].count("\n")
            continue
        name = name.lower()
        if name not in INLINE and short.get(blocks[-1]) and begun[blocks[-1]] < line and blocks[-1]:
            k = stack.index(blocks[-1])
            for x in stack[k:]:
                links -= nodes[x].tag == "a"
            del stack[k:], blocks[k:]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    for x in stack[k:]:
                        links -= nodes[x].tag == "a"
                    del stack[k:], blocks[k:]
                    break
        elif name not in VOID:
            if name in SELF_CLOSING and nodes[stack[-1]].tag == name:
                stack.pop()
                blocks.pop()
            sign = name
            if name != "a" and "=" in m[3]:
                for _, value in _NAMED.findall(m[3]):
                    sign += "." + re.sub(r"\d+", "#", value.lower())
            nodes.append(Node(name, sign, stack[-1]))
            begun.append(line)
            stack.append(len(nodes) - 1)
            blocks.append(blocks[-1] if name in INLINE else len(nodes) - 1)
            links += name == "a"
        if "\n" in m[0]:
            line += m[0].count("\n")
    runs(at, len(text))
    return nodes, leaves
