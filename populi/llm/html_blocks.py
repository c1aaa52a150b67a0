"""Leaf blocks of an HTML page: the stretches of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")  # a tag with an unpaired quotation mark
NAMED = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile("[a-z]+")

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas noembed xmp".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = {"li": "li", "td": "cell", "th": "cell", "tr": "tr", "dt": "term", "dd": "term"}  # a new one ends an open one of its group
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote figcaption caption pre".split())
NONE: frozenset[str] = frozenset()


class Block(NamedTuple):
    text: str  # white space as single spaces
    links: int  # characters inside links
    tag: str  # innermost block-level element
    above: frozenset  # "t:tag" and "n:name" (of class, id, role) of all block-level ancestors and itself
    container: frozenset  # the same object for blocks of one container


def names_of(attributes: str) -> set[str]:
    out: set[str] = set()
    for m in NAMED.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            out.update("n:" + x for x in PART.findall(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out.add("n:hidden")
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, the head's title and the like give none.

    Elements that the page leaves open end as HTML ends them: a paragraph at the next block, an item at its next sibling."""
    out: list[Block] = []
    stack: list[tuple[str, str, frozenset, frozenset]] = []  # tag; tag, above and container of a block right here
    opened: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                _, tag, above, container = stack[-1] if stack else ("", "", NONE, NONE)
                out.append(Block(text, sum(len(t) for t, linked in held if linked), tag, above, container))
            held.clear()

    def close(depth: int) -> None:
        opened.subtract(entry[0] for entry in stack[depth:])
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            sign = end
        if sign > at:
            held.append((page[at:sign], opened["a"] > 0))
        if sign == end:
            break
        m = TOKEN.match(page, sign) or LOOSE.match(page, sign)
        if not m:
            held.append(("<", opened["a"] > 0))
            at = sign + 1
            continue
        at = m.end()
        if not m.group(2):
            continue  # a comment or declaration
        tag, attributes = m.group(2).lower(), m.group(3)
        if tag not in INLINE:
            flush()
        if m.group(1):
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW:
            if tag in ("svg", "math") and attributes and attributes.rstrip().endswith("/"):
                continue  # closed by itself
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened["p"] > 0 or tag in ITEMS:
            for depth in range(len(stack) - 1, -1, -1):
                name = stack[depth][0]
                if name == "p" and tag in CLOSES_P or tag in ITEMS and ITEMS.get(name) == ITEMS[tag]:
                    close(depth)
                    break
                if name not in INLINE and name != "p":
                    break
        _, inner, above, container = stack[-1] if stack else ("", "", NONE, NONE)
        if tag not in INLINE:
            inner, outer = tag, above
            above = above | {"t:" + tag} | (names_of(attributes) if attributes else set())
            container = outer if tag in LEAVES else above
        stack.append((tag, inner, above, container))
        opened[tag] += 1
    flush()
    return out
