"""Text blocks of web pages with the path of elements around each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Elements by their role in HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu "
    "nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg object".split())
# Which open elements a start tag ends.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
ENDS_P = BLOCK_TAGS - {"html", "head", "body"}
# An end tag does not reach beyond these.
SCOPE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+)")
_NAMES = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    """One run of text between block borders: its path, its words, how much of it is links."""

    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: float
    place: int


class _Places:
    """Where characters come next in a page. A place is looked up once, however often it is asked for."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def after(self, char: str, at: int) -> int:
        begin, place = self.known.get(char, (0, -2))
        if place == -2 or not begin <= at <= (place if place >= 0 else len(self.page)):
            begin, place = at, self.page.find(char, at)
            self.known[char] = begin, place
        return place


def _tag(page: str, start: int, places: _Places) -> tuple[str, str, str, int] | None:
    """Slash, name, attributes and end of the tag at ``start``; None if it is not closed.

    A `>` within quotes does not close it, however long the quoted value is.
    """
    match = _TAG.match(page, start)
    if match is None:
        return None
    at, end = match.end(), len(page)
    while at < end and page[at] != ">":
        if page[at] in "\"'":
            at = places.after(page[at], at + 1)
            if at < 0:
                return None
            at += 1
        else:
            near = [p for p in (places.after(c, at) for c in "\"'>") if p >= 0]
            at = min(near, default=end)
    if at >= end:
        return None
    return match[1], match[2], page[match.start(3) : at], at + 1


def _names(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role: `ad-box mainNav` has ad, box, main, nav."""
    found: list[str] = []
    for value in _NAMES.findall(attributes):
        found += _PARTS.findall(_CAMEL.sub(r"\1 \2", value.strip("\"'")).lower())
    return tuple(dict.fromkeys(found))


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order; texts are decoded, their white space is one space.

    Comments, declarations and elements without readable text are left out. Inline
    elements do not end a block. What is not well-formed never fails: a stray `<` is text,
    an unknown end tag is ignored, an unclosed element ends with its parent.
    """
    result: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links = 0
    linked = 0
    place = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            result.append(Block(tuple(path), text, min(1.0, linked / len(text)), place))
        pieces.clear()
        linked = 0

    at, end, places = 0, len(page), _Places(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            if not pieces:
                place = at
            piece = html.unescape(page[at:start])
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if start >= end:
            break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        match = _tag(page, start, places)
        if match is None:
            stop = page.find(">", start) if page[start + 1 : start + 2].isalpha() or page.startswith("</", start) else -1
            if stop < 0:
                if not pieces:
                    place = start
                pieces.append("<")
                at = start + 1
                continue
            slash, tag, attributes = "", re.split(r"[\s/>]", page[start + 1 : stop].lstrip("/"))[0], ""
            slash = "/" if page.startswith("</", start) else ""
            at = stop + 1
        else:
            slash, tag, attributes, at = match
        tag = tag.lower()
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                close()
                for depth in range(len(path) - 1, -1, -1):
                    if path[depth][0] == tag:
                        del path[depth:]
                        break
                    if path[depth][0] in SCOPE.get(tag, ()):
                        break
            continue
        if tag in RAW_TAGS:
            if attributes.endswith("/") and tag == "svg":
                continue
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                at = end if tag in ("script", "style", "textarea", "title") else at
                continue
            at = page.find(">", stop.end())
            at = end if at < 0 else at + 1
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            close()
            if tag in ENDS_P and path and path[-1][0] == "p":
                path.pop()
            ended = ENDED_BY.get(tag, ())
            while path and path[-1][0] in ended:
                path.pop()
            if tag not in VOID_TAGS:
                path.append((tag, _names(attributes) if attributes.strip() else ()))
    close()
    return result
