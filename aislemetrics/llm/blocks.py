"""Leaf blocks of a web page: runs of text between block-level tags, with the tags and names around them."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text of the page: to the first end tag or the end of the page, and from a start tag to its own end tag.
RAW = frozenset("script style iframe noembed noframes textarea".split())
SILENT = frozenset("template svg".split())
# Shown as written: no tags, no references, to its end tag or the end of the page.
_XMP_END = re.compile(r"</xmp(?=[\s/>])", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var br wbr img object "
    "math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom "
    "menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction".split()
)
# Start tags that close an open element of these names.
CLOSES = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
# Elements that such a closing does not reach across.
SCOPES = frozenset("table ul ol dl menu select article section div nav aside main header footer body html form".split())

_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class _Tags:
    """Tags of one page, of any length, in time linear in the page.

    Only a quote that follows ``=`` and is closed somewhere holds a value.
    """

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()  # quotes that do not come again
        self.endless: set[int] = set()  # places of =, from which no tag's end is found
        self.ends: dict[str, dict[int, int]] = {}  # of an element's name: from behind its start tags to behind their end tags

    def _end(self, at: int) -> int:
        """After the > that ends the tag, from a place in it outside values; -1 where the page ends before."""
        seen = []
        while (stop := _STOP.search(self.page, at)) and stop.start() not in self.endless:
            at = stop.end()
            if stop[0] == ">":
                return at
            seen.append(stop.start())
            quote = self.page[at : at + 1]
            if quote in ('"', "'") and quote not in self.unclosed:
                close = self.page.find(quote, at + 1)
                if close < 0:
                    self.unclosed.add(quote)
                at = max(at, close) + 1
        self.endless.update(seen)
        return -1

    def read(self, opening: int) -> tuple[int, tuple[str, str, str] | None]:
        """Where to go on behind the < at ``opening``, and the tag: its slash, its name, and what follows that."""
        page = self.page
        head = _HEAD.match(page, opening)
        end = self._end(head.end()) if head else -1
        if end >= 0:
            return end, (head[1], head[2].lower(), page[head.end() : end - 1])
        end = page.find(">", opening) + 1  # a tag with stray quotes ends at the next >
        if not end:
            return len(page), None
        text = page[opening:end].replace('"', " ").replace("'", " ")
        head = _HEAD.match(text)
        return end, (head[1], head[2].lower(), text[head.end() : -1]) if head else None

    def past(self, name: str, at: int) -> int:
        """Behind the end tag that belongs to the start tag ending at ``at``, or ``at`` where it has none.

        The first call for a name pairs all its tags in the rest of the page, so that nesting costs nothing more.
        """
        if name not in self.ends:
            self.ends[name], starts, here = {}, [at], at
            while (here := self.page.find("<", here)) >= 0:
                if self.page.startswith("<!--", here):
                    end = self.page.find("-->", here + 4)
                    here = len(self.page) if end < 0 else end + 3
                    continue
                if not _HEAD.match(self.page, here):
                    here += 1
                    continue
                here, tag = self.read(here)
                if tag and tag[1] == name:
                    if not tag[0]:
                        starts.extend([] if tag[2].endswith("/") else [here])
                    elif starts:
                        self.ends[name][starts.pop()] = here
                elif tag and tag[1] in RAW and not tag[0] and not tag[2].endswith("/"):
                    here = self.past_raw(tag[1], here)
        return self.ends[name].get(at, at)

    def past_raw(self, name: str, at: int) -> int:
        """Behind the next end tag of the name, or at the end of the page."""
        end = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(self.page, at)
        return end.end() if end else len(self.page)


class Block(NamedTuple):
    path: tuple[tuple[str, str], ...]  # (tag, its class, id and role) from the outermost element inwards
    text: str
    linked: int  # characters inside links


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order, character references decoded, white space made single; empty ones are left out.

    Pages of any length are read whole, in time linear in the page; ``xmp`` is shown as written, ``noscript`` is read like any other.

    Unclosed and crossed tags are allowed; a page that ends inside a tag, a comment or an element of ``RAW`` loses that only.  An
    unclosed element of ``SILENT`` loses its start tag.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(tuple(x for x in stack if x[0] not in INLINE), text, min(linked, len(text))))
        parts, linked = [], 0

    def pop_to(place: int) -> None:
        if any(name not in INLINE for name, _ in stack[place:]):
            flush()
        del stack[place:]

    at, size, tags = 0, len(page), _Tags(page)
    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            opening = size
        if opening > at:
            # References are decoded run by run, so none arises from the pieces around a tag.
            parts.append(html.unescape(page[at:opening]))
            if any(name == "a" for name, _ in stack):
                linked += len(parts[-1])
        if opening == size:
            break
        if page.startswith("<!--", opening):
            end = page.find("-->", opening + 4)
            at = size if end < 0 else end + 3
            continue
        if page[opening + 1 : opening + 2] in ("!", "?"):
            end = page.find(">", opening)
            at = size if end < 0 else end + 1
            continue
        following = page[opening + 1 : opening + 3]
        if not (following[:1].isalpha() or following[:1] == "/" and following[1:].isalpha()):
            parts.append("<")
            at = opening + 1
            continue
        at, tag = tags.read(opening)
        if not tag:
            continue
        closing, name, rest = tag
        if closing:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == name:
                    pop_to(place)
                    break
                if name in INLINE and stack[place][0] not in INLINE:
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW or name in SILENT:
            if not rest.endswith("/"):
                at = tags.past_raw(name, at) if name in RAW else tags.past(name, at)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "xmp":
            flush()
            end = _XMP_END.search(page, at)
            parts.append(page[at : end.start() if end else size])
            at = end.start() if end else size
            stack.append((name, ""))
            flush()
            continue
        if name not in INLINE:
            flush()
            closed = CLOSES.get(name, frozenset()) | {"p"}
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] in closed:
                    del stack[place:]
                    break
                if stack[place][0] in SCOPES:
                    break
        if name not in VOID:
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(rest)).lower() if "=" in rest else ""
            stack.append((name, names))
    flush()
    return found
