"""Reading lines of text and their place from tag soup, in one pass of one pattern."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|title)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+)|<", re.S)
#: Elements that don't end a line.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Kinds of lines
TEXT, HEADING, LINK, BUTTON, LOOSE = 0, 1, 2, 3, 4


_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")


def _is_sentence(text: str) -> bool:
    return bool(_SENTENCE_END.search(text)) and (text.count(" ") >= 3 or len(text.encode()) > 2 * len(text) and len(text) >= 10)


def lines(source: str) -> list[tuple[str, int, int]]:
    """``(text, kind, block)`` of each visible line of a page.

    A line ends at each element that isn't inline, and at each link or span that stands outside
    running text, begins after a line break or ends the line on its own.  kind: TEXT for running text (p, li), HEADING
    for h1 to h3, LINK where all letters stand inside links, BUTTON, and LOOSE for text
    directly in containers or in spans.  block counts containers opened or closed so far.
    """
    found: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = other = spanned = 0
    in_link = in_button = in_span = heading = paragraph = False
    block = 0

    def end() -> None:
        nonlocal linked, other, spanned
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            linked_title = linked and not other and not (paragraph and _is_sentence(text))
            kind = LINK if linked_title else BUTTON if in_button else HEADING if heading else TEXT if paragraph and (linked or spanned < other) else LOOSE
            found.append((text, kind, block))
        linked = other = spanned = 0

    for m in _TOKEN.finditer(source):
        text = m.group(5)
        if text is not None:
            parts.append(text)
            size = sum(map(str.isalnum, text))
            if in_link:
                linked += size
            else:
                other += size
                if in_span:
                    spanned += size
            continue
        name = m.group(3)
        if name is None:
            continue
        name, closing = name.lower(), bool(m.group(2))
        if name == "br":
            end()
        elif name == "a":
            if not closing and (not other or not (paragraph or heading) or "\n" in "".join(parts[-1:])):
                end()
            if closing and not other:
                end()
            in_link = not closing
        elif name == "span":
            if not closing and (not other or "\n" in parts[-1]) or closing and not paragraph and not heading:
                end()
            in_span = not closing
        elif name == "button":
            end()
            in_button = not closing
        elif name not in INLINE:
            end()
            in_link = in_span = False
            if name in _HEADINGS:
                heading = not closing and name in ("h1", "h2", "h3")
                paragraph = False
            elif name in ("p", "li", "dd", "dt", "blockquote", "pre"):
                paragraph = not closing
                heading = False
            else:
                heading = paragraph = False
            if name not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt"):
                block += 1
    end()
    return found
