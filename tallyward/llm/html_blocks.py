"""Leaf text blocks of a page, in page order, each with its tag path."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

#: Elements that end a block of text where they start and end; all others are part of a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold items.
HOLDS = frozenset({"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select"})
CELLS, TERMS = frozenset({"td", "th"}), frozenset({"dd", "dt"})
#: A start tag of the key ends an open element of the first set, unless one of the second is nearer.
ENDS = {"li": ({"li"}, HOLDS), "dd": (TERMS, HOLDS), "dt": (TERMS, HOLDS), "tr": ({"tr"}, HOLDS), "td": (CELLS, HOLDS | {"tr"}), "th": (CELLS, HOLDS | {"tr"}), "option": ({"option"}, HOLDS)}
#: The elements that such a start tag looks at.
ITEMS = HOLDS.union(*(ends for ends, _ in ENDS.values()))
#: Hash slots of the names on a path.
SLOTS = 96

#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template svg iframe object title".split())
ATTRIBUTES = r"""(?:(?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*+)"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-z][a-z0-9:-]*+)({ATTRIBUTES})>|<[!?][^>]*+>""", re.I | re.S)
SPANS = {x: re.compile(rf"<(/?){x}(?![^\s/>])({ATTRIBUTES})>", re.I | re.S) for x in DROPPED}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile("[a-z]+")


def slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class Element:
    """An open element. It knows its parent, so that the paths of all blocks share their elements.

    slots is the set of its path's hashed tags and names, as bits; near, the closest of it and its ancestors in ITEMS.
    """

    __slots__ = ("parent", "tag", "names", "depth", "slots", "near")

    def __init__(self, parent: Element | None, tag: str, names: tuple[str, ...]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.depth = parent.depth + 1 if parent else 0
        self.slots = parent.slots if parent else 0
        for name in (tag, *(f".{n}" for n in names)) if parent else ():
            self.slots |= 1 << slot(name, SLOTS)
        self.near = self if tag in ITEMS else parent.near if parent else None

    def __iter__(self) -> Iterator[tuple[str, tuple[str, ...]]]:
        """(tag, names) of the elements from the outside in, but for the page itself."""
        out, at = [], self
        while at.parent:
            out.append((at.tag, at.names))
            at = at.parent
        return reversed(out)


class Block:
    """A block's text, its innermost element, and how many of its characters are links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: Element, linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def names_of(attributes: str) -> tuple[str, ...]:
    if not attributes or attributes.isspace():
        return ()
    return tuple(p for m in NAMES.finditer(attributes) for p in PARTS.findall((m[1] or m[2] or m[3] or "").lower()))


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Dropped:
    """Where the dropped elements of a page end.

    A script or style reaches to its first end tag, or the end of the page. For the others an end tag belongs to the
    nearest start tag of its name before it; a start tag that has none, or an svg closed in itself, has no content.
    """

    def __init__(self, page: str, limit: int) -> None:
        self.page, self.limit, self.ends = page, limit, {}

    def end(self, name: str, start: int, after: int) -> int:
        """The place after the element whose start tag is page[start:after]."""
        if name in ("script", "style"):
            found = next((m for m in SPANS[name].finditer(self.page, after, self.limit) if m[1]), None)
            return found.end() if found else len(self.page)
        if name not in self.ends:
            ends, opened = self.ends.setdefault(name, {}), []
            for m in SPANS[name].finditer(self.page, 0, self.limit):
                if not m[1]:
                    if name != "svg" or not m[2].endswith("/"):
                        opened.append(m.start())
                elif opened:
                    ends[opened.pop()] = m.end()
        return max(after, self.ends[name].get(start, after))


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks. Broken markup gives blocks too: an end tag without its start is passed over.

    Time and memory grow with the page's length, whatever its nesting: no tag reaches beyond the page's last ">", no
    search goes up the open elements unless it ends one of them or stays among a list's items.
    """
    out: list[Block] = []
    here = Element(None, "", ())
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    at = linked = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        if pieces:
            text = tidy("".join(pieces))
            if text:
                out.append(Block(text, here, linked))
            pieces.clear()
        linked = 0

    def leave(element: Element) -> None:
        """Close the element and all in it."""
        nonlocal here
        while here is not element.parent:
            open_tags[here.tag] -= 1
            here = here.parent

    limit = page.rfind(">") + 1
    dropped = Dropped(page, limit)
    while m := TOKEN.search(page, at, limit):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            linked += in_link and m.start() - at
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if at == limit and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)  # a comment that doesn't end
                break
            continue
        if tag in DROPPED:
            if not m[1] and (not m[3] or m[3][0] == "/" or m[3][0].isspace()):
                at = dropped.end(tag, m.start(), at)
            continue
        if tag not in BLOCK:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = not m[1]
            continue
        close()
        if m[1]:
            if open_tags[tag]:
                found = here
                while found.tag != tag:
                    found = found.parent
                leave(found)
            continue
        if here.tag == "p":
            leave(here)
        if tag in ENDS:
            ends, holds = ENDS[tag]
            found = here.near
            while found and found.tag not in ends and found.tag not in holds:
                found = found.parent.near
            if found and found.tag in ends:
                leave(found)
        if tag not in VOID:
            here = Element(here, tag, names_of(m[3]))
            open_tags[tag] += 1
    if at < len(page):
        rest = page[at:]
        pieces.append(rest[: rest.index("<!--")] if "<!--" in rest else rest)
    close()
    return out
