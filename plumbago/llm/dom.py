"""A tolerant HTML reader: elements and text runs of a page in page order, as flat arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: A quote opens an attribute's value only right after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")

#: Elements whose content is never text of the page; those without an end tag; those that only dress text.
RAW = frozenset("script style noscript template iframe textarea title svg math object select noframes canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
#: A start tag of the first kind ends an open element of the second, up to one of the third.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_NO_CLASS = ("", "", "")


@dataclass
class Page:
    """Node k has a tag ("" for a text run), a parent before it (-1 for the root) and its class, id and role."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, str, str]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, names: tuple[str, str, str] = _NO_CLASS, text: str = "", linked: int = 0) -> int:
        self.tags.append(tag), self.parents.append(parent), self.names.append(names), self.texts.append(text), self.linked.append(linked)
        return len(self.tags) - 1


def _names(attrs: str) -> tuple[str, str, str]:
    if "=" not in attrs:
        return _NO_CLASS
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    return found.get("class", ""), found.get("id", ""), found.get("role", "")


def read(html: str) -> Page:
    """White space in a run is single blanks, references are decoded, and runs without a character are left out."""
    page = Page()
    stack = [page.add("html", -1)]
    parts: list[str] = []
    links: list[str] = []
    in_link = False

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.add("", stack[-1], text=text, linked=min(len(text), len(" ".join(unescape("".join(links)).split()))))
            parts.clear()
            links.clear()

    def text(s: str) -> None:
        if s:
            parts.append(s)
            if in_link:
                links.append(s)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in INLINE:
            in_link = not closing if tag == "a" else in_link
            continue
        if tag in VOID:
            if tag == "br" or tag == "img":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not closing and not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        flush()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if page.tags[stack[k]] == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                page.names[0] = _names(m.group(3))
            continue
        if tag in _P_ENDERS and len(stack) > 1 and page.tags[stack[-1]] == "p":
            stack.pop()
        ended, scope = _ENDS.get(tag, ((), ()))
        while ended and len(stack) > 1 and (page.tags[stack[-1]] in ended or page.tags[stack[-1]] == "p") and page.tags[stack[-1]] not in scope:
            stack.pop()
        stack.append(page.add(tag, stack[-1], _names(m.group(3))))
    flush()
    return page
