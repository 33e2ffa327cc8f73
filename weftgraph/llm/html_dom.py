"""A lenient parser that turns raw HTML into a tree of block elements with their own text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped to their end tag; markup inside is text.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Skipped to the end tag that belongs to them; without one only the tag itself is.
SKIPPED = frozenset("template svg annotation annotation-xml".split())
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
) | MATH
#: Block elements whose start ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements that a start tag ends, and the elements in which they are looked for.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.DOTALL)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_OTHER = re.compile(r"<[!?/][^>]*(?:>|\Z)")
_LONGEST = 1 << 17  # characters of a tag whose quotes are looked at; a longer one ends at its first >
_PATIENCE = 1 << 24  # characters that may be looked at in vain for tags with quotes; then tags end at their first >
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name that are closed end, by the place of their start tags."""
    ends, open_ = {}, []
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", page, re.IGNORECASE):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


@dataclass
class Block:
    """A block element. segments: (place in the page, text); the text of inline elements is their block's."""

    tag: str
    parent: int
    attrs: str = ""
    hidden: bool = False
    segments: list[tuple[int, str]] = field(default_factory=list)
    link_chars: int = 0
    children: int = 0
    label: int | None = None


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


_CELLS = ("table", "td", "th")
_OUT_OF_CELLS = frozenset("table tr tbody thead tfoot body html td th".split())


def parse(page: str, apart: Callable[[str], bool] = lambda _: False) -> list[Block]:
    """The page's blocks, parents before children, the root first. Never fails. Inline elements whose
    attributes set them `apart` are blocks of their own.

    Time is about linear in the page's length: the places of open elements are kept by name, so that an
    end tag without a start costs nothing, and what is walked over is closed."""
    blocks = [Block("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their block
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    not_inline: list[int] = [0]
    pending: list[str] = []
    ends: dict[str, dict[int, int]] = {}  # of skipped elements
    links = order = at = vain = 0

    def open_(name: str, block: int, inline: bool) -> None:
        places[name].append(len(stack))
        if not inline:
            not_inline.append(len(stack))
        stack.append((name, block))

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def flush() -> None:
        nonlocal order
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                own = blocks[stack[-1][1]]
                own.segments.append((order, text))
                order += 1

    def close(upto: int) -> None:
        nonlocal links
        if not_inline[-1] >= upto:
            flush()
        while not_inline[-1] >= upto:
            not_inline.pop()
        for name, _ in stack[upto:]:
            links -= name == "a"
            places[name].pop()
        del stack[upto:]

    def ended_by(name: str) -> int | None:
        """The place of the element that an end tag closes. An inline end tag closes nothing outside its
        block, and no cell is closed from inside."""
        at = last(name)
        if not at:
            return None
        inside = not_inline[-1] <= at if name in INLINE else name in _OUT_OF_CELLS or last(*_CELLS) <= at
        return at if inside else None

    while at < len(page):
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text:
            pending.append(text)
            if links:
                blocks[stack[-1][1]].link_chars += len(text.strip())
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            at = _COMMENT.match(page, lt).end()
            continue
        m = _TAG.match(page, lt, lt + _LONGEST) if vain < _PATIENCE else None
        if not m:
            m = _LOOSE.match(page, lt)
            vain += min(len(page) - lt, _LONGEST) if m else 0
        m = m or _OTHER.match(page, lt)
        if not m:
            pending.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _LOOSE and not m[0].endswith(">"):
            break  # the page ends inside a tag
        if m.re is _OTHER:
            continue
        name, end = m[2].lower(), bool(m[1])
        if end:
            if name == "br":
                pending.append(" ")
            elif (k := ended_by(name)) is not None:
                close(k)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in SKIPPED:
            if name not in ends:
                ends[name] = _ends(page, name)
            at = ends[name].get(lt, at)
            continue
        if name == "xmp":
            stop = re.compile(r"</xmp(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            flush()
            blocks[stack[-1][1]].children += 1
            blocks.append(Block(name, stack[-1][1], m[3]))
            open_(name, len(blocks) - 1, False)
            pending.append(html.escape(page[at : stop.start() if stop else len(page)]))
            close(len(stack) - 1)
            at = stop.end() if stop else len(page)
            continue
        if name in MATH and m[3].endswith("/"):
            continue
        if name in VOID:
            if name in ("br", "wbr", "img"):
                pending.append("" if name == "wbr" else " ")
            elif name == "hr":
                flush()
            continue
        if name in _SIBLINGS:
            ended, inside = _SIBLINGS[name]
            bound = last(*inside)
            lowest = min((places[x][k] for x in ended if (k := bisect_right(places[x], bound)) < len(places[x])), default=None)
            if lowest is not None:
                close(lowest)
        elif name in _ENDS_P and (k := last("p")) and k == not_inline[-1]:
            close(k)
        inline = name in INLINE
        links += name == "a"
        if inline and not (m[3] and apart(m[3])):
            open_(name, stack[-1][1], True)
        else:
            flush()
            parent = stack[-1][1]
            blocks[parent].children += 1
            blocks.append(Block(name, parent, m[3]))
            open_(name, len(blocks) - 1, False)
    flush()
    return blocks
