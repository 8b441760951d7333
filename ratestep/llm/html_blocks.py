"""HTML pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math textarea title iframe object canvas noframes xmp plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the left kind ends an open element of the right kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "head"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


class Node:
    """An open block element; its ancestors are shared with all that lie in them, so a path costs one node."""

    __slots__ = ("depth", "names", "parent", "tag", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent, self.vector = tag, names, parent, None
        self.depth = 1 if parent is None else parent.depth + 1


#: Nodes seen lately, so that pages of one layout share them; it is emptied when it has grown large.
_SEEN: dict[tuple, Node] = {}


def _node(tag: str, names: tuple[str, ...], parent: Node | None) -> Node:
    key = (parent, tag, names)
    if (node := _SEEN.get(key)) is None:
        if len(_SEEN) >= 20_000:
            _SEEN.clear()
        node = _SEEN[key] = Node(tag, names, parent)
    return node


@dataclass
class Block:
    """Text with single spaces, and the innermost open block element."""

    node: Node | None
    text: str
    linked: float

    @property
    def depth(self) -> int:
        return self.node.depth if self.node else 0

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """A (tag, names) pair for every open block element, outermost first."""
        out, at = [], self.node
        while at is not None:
            out.append((at.tag, at.names))
            at = at.parent
        return tuple(reversed(out))


def _names(rest: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in _NAMED.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        kind = "role:" if m[1].lower() == "role" else ""
        out += [kind + x.lower() for x in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order. Comments, scripts, styles and the like have no blocks; a tag that is never closed ends with the page."""
    out: list[Block] = []
    stack: list[Node] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, depth_a = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(1.0, linked / max(1, sum(map(len, parts))))))
            parts.clear()
        linked = 0

    def close(names: tuple[str, ...], fence: frozenset[str]) -> None:
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                open_.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in fence:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            linked += depth_a and (lt - at)
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ends, rest = m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if not ends and name in RAW:
            flush() if name in BLOCK else None
            done = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if name in ("svg", "math", "object", "canvas") and rest.rstrip().endswith("/"):
                continue
            at = n if not done else (page.find(">", done.start()) + 1 or n)
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            depth_a = 0 if ends else 1
        elif name in BLOCK:
            flush()
            if ends:
                close((name,), frozenset())
            else:
                if name in _ENDS_P:
                    close(("p",), BLOCK - {"p"})
                if name in CLOSES:
                    close(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
                if name not in VOID:
                    stack.append(_node(name, _names(rest), stack[-1] if stack else None))
                    open_[name] += 1
    flush()
    return out
