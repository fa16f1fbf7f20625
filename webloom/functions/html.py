"""Page structure from tag soup: one parse of a page gives every field that later stages use."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))
_NOISE = frozenset("script style noscript template svg canvas iframe object embed nav footer form".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Ids and classes of the content element, in order of preference after main, article and role=main.
_CONTENT_IDS = ("main-content", "main_content", "content")
_CONTENT_CLASSES = ("main-content", "main_content", "page-content", "page_content", "content")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self, skip=None):
        """Elements in document order; subtrees for which ``skip`` holds are left out."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not (skip and skip(c)))

    def strings(self, skip=None):
        """Stripped, non-empty text nodes; text of scripts, styles and templates only where asked directly."""
        stack = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if text := node.strip():
                    yield text
            elif node is self or not (skip and skip(node)):
                if node.name not in _NO_TEXT or node is self:
                    stack.extend(reversed(node.children))

    def text(self, separator: str, skip=None) -> str:
        return separator.join(self.strings(skip))


class _Builder(HTMLParser):
    """An end tag closes the nearest open element of its name; others are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        first: dict = {}
        for k, v in attrs:
            first[k] = v if v is not None else ""
        node = Node(tag, first)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def _hidden(node: Node) -> bool:
    attrs = node.attrs
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = re.sub(r"\s+", "", attrs.get("style", "").lower())
    return "display:none" in style or "visibility:hidden" in style


def _left_out(node: Node) -> bool:
    return node.name in _NOISE or _hidden(node)


def _collapse(text: str) -> str:
    return " ".join(text.split())


def _first_meta(root: Node, attribute: str, value: str) -> str | None:
    for node in root.walk():
        if node.name == "meta" and node.attrs.get(attribute, "").strip().lower() == value:
            return _collapse(node.attrs.get("content", "")) or None
    return None


def _content_root(root: Node) -> Node:
    found: dict[str, Node] = {}
    for node in root.walk(_left_out):
        keys = [node.name] if node.name in ("main", "article", "body") else []
        if node.attrs.get("role") == "main":
            keys.append("role")
        keys += [f"#{node.attrs.get('id')}", *(f".{c}" for c in node.attrs.get("class", "").split())]
        for key in keys:
            found.setdefault(key, node)
    order = ("main", "article", "role", *(f"#{i}" for i in _CONTENT_IDS), *(f".{c}" for c in _CONTENT_CLASSES), "body")
    return next((found[key] for key in order if key in found), root)


def page_fields(source: str) -> dict:
    """Every field of a page: what extraction, classification and link discovery read.

    Hidden elements are dropped with all they hold; the page stays.
    """
    root = parse(source)
    title = body = language = description = None
    first_headings: list[str] = []
    anchors: list[tuple[int, str, str]] = []
    seen = 0
    for node in root.walk():
        if node.name == "title" and title is None:
            title = node
        elif node.name == "body" and body is None:
            body = node
        elif node.name == "html" and language is None:
            language = node.attrs.get("lang", "").strip().lower() or None
        elif node.name in ("h1", "h2") and seen < 12:
            seen += 1
            if text := node.text(" "):
                first_headings.append(text)
        elif node.name == "meta" and description is None and node.attrs.get("name", "").lower() == "description":
            description = node.attrs.get("content", "")
        elif node.name == "a" and "href" in node.attrs:
            anchors.append((len(anchors), node.attrs["href"].strip(), node.text(" ")))
    headings: dict[str, str] = {}
    for node in root.walk(_left_out):
        if node.name in _HEADINGS and (text := _collapse(node.text(" ", _left_out))):
            headings.setdefault(text.casefold(), text)
    raw = _content_root(root).text("\n", _left_out)
    return {
        "title": (_collapse(title.text(" ")) or None) if title else None,
        "meta_description": _first_meta(root, "name", "description") or _first_meta(root, "property", "og:description") or _first_meta(root, "name", "twitter:description"),
        "html_language": language or (lambda x: x.lower() if x else None)(_first_meta(root, "http-equiv", "content-language")),
        "headings": list(headings.values()),
        "raw_text": raw,
        "signal_title": title.text(" ") if title else "",
        "signal_meta": description or "",
        "signal_headings": " ".join(first_headings),
        "signal_content": body.text(" ") if body else "",
        "anchors": anchors,
    }
