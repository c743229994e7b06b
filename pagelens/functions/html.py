"""HTML as a light tree: sanitising, zones, text and links, in one parse a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

from .text import strip_unseen
from .urls import nested_documents, normalize, resolve

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = ("script", "style", "noscript")
CONTENT_TAGS = ("main", "article", "section")
CHROME_TAGS = ("nav", "header", "footer")
EMBEDDED = (("iframe", "src"), ("object", "data"), ("embed", "src"))
MAX_TEXT = 16_384
MAX_LINKS = 5_000
HIDING_STYLE = (
    r"display:none", r"visibility:hidden", r"opacity:0(?:\.0+)?(?:;|$|!important)", r"font-size:0(?:\.0+)?(?:[a-z%]|;|$)",
    r"position:(?:absolute|fixed).*(?:left|top):-\d{4,}|(?:left|top):-\d{4,}.*position:(?:absolute|fixed)", r"text-indent:-\d{3,}",
)
PASSWORD_INPUT = r"""(?i)<input\b[^>]*\btype\s*=\s*["']?password["']?[^>]*>"""

_HIDING = re.compile("|".join(f"(?:{p})" for p in HIDING_STYLE), re.S)
_AT_BLOCK = re.compile(r"@[a-zA-Z-]+[^{]*\{(?:[^{}]|\{[^{}]*\})*\}", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}", re.S)
_STEP = re.compile(r"\s*([>\s])\s*")
_SIMPLE = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self):
        """(text, element that holds it) below this element, in document order."""
        todo: list[tuple[Node | str, Node]] = [(c, self) for c in reversed(self.children)]
        while todo:
            item, holder = todo.pop()
            if isinstance(item, str):
                yield item, holder
            else:
                todo += [(c, item) for c in reversed(item.children)]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def zone(self) -> int:
        """0 below a content element, 2 below page chrome, 1 elsewhere: the nearest of them counts."""
        node: Node | None = self
        while node is not None:
            if node.tag in CONTENT_TAGS:
                return 0
            if node.tag in CHROME_TAGS:
                return 2
            node = node.parent
        return 1


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Node:
    """The tree of a page; comments and declarations are not kept."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def is_hidden(attrs: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    return "hidden" in attrs or bool(_HIDING.search(re.sub(r"\s+", "", attrs.get("style", "").lower())))


def hiding_selectors(css: str) -> list[str]:
    """Selectors of flat rules that hide what they match."""
    found = []
    for prelude, body in _RULE.findall(_AT_BLOCK.sub("", css)):
        plain = re.sub(r"\s+", "", body.lower())
        if "display:none" in plain or "visibility:hidden" in plain:
            found += [s for s in map(str.strip, prelude.split(",")) if s and not s.startswith("@")]
    return found


def _compound(text: str) -> list[tuple] | None:
    """Tests of one compound selector; null if it holds anything else than tags, classes, ids and attributes."""
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m[1] and at):
            return None
        tests.append(("tag", m[1].lower()) if m[1] else ("class", m[2]) if m[2] else ("id", m[3]) if m[3] else ("attr", m[4].lower(), m[5], m[6]))
        at = m.end()
    return tests or None


def _passes(node: Node, tests: list[tuple]) -> bool:
    for kind, name, *rest in tests:
        if kind == "tag":
            ok = name in ("*", node.tag)
        elif kind == "class":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "id":
            ok = node.attrs.get("id") == name
        else:
            value, (operator, wanted) = node.attrs.get(name), rest
            ok = value is not None and (
                operator is None or (operator == "=" and value == wanted) or (operator == "~=" and wanted in value.split()) or (operator == "^=" and bool(wanted) and value.startswith(wanted))
                or (operator == "$=" and bool(wanted) and value.endswith(wanted)) or (operator == "*=" and bool(wanted) and wanted in value) or (operator == "|=" and (value == wanted or value.startswith(wanted + "-")))
            )
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements that a selector of compounds with descendant and child steps matches; none if it holds more than that."""
    parts = _STEP.split(selector.strip())
    steps = [(parts[i - 1] if i else " ", _compound(parts[i])) for i in range(0, len(parts), 2)]
    if any(t is None for _, t in steps):
        return []

    def holds(node: Node | None, k: int) -> bool:
        if node is None or not node.tag or not _passes(node, steps[k][1]):
            return False
        if not k:
            return True
        above = node.parent
        if steps[k][0] == ">":
            return holds(above, k - 1)
        while above is not None:
            if holds(above, k - 1):
                return True
            above = above.parent
        return False

    return [n for n in root.walk() if holds(n, len(steps) - 1)]


def sanitize(root: Node) -> Node:
    """Remove from a tree what a reader does not see: hidden elements, scripts and styles, invisible characters."""
    css = ["".join(t for t, _ in n.texts()) for n in root.walk() if n.tag == "style"]
    for selector in (s for text in css for s in hiding_selectors(text)):
        for node in select(root, selector):
            node.remove()
    for node in list(root.walk()):
        if node.tag in DROPPED:
            node.remove()
        elif node.tag == "meta":
            node.attrs.pop("content", None)
    for node in list(root.walk()):
        if is_hidden(node.attrs):
            node.remove()
    for node in (root, *root.walk()):
        node.children = [strip_unseen(c) if isinstance(c, str) else c for c in node.children]
    return root


def to_html(node: Node) -> str:
    """A tree as HTML."""
    out: list[str] = []
    todo: list[Node | str | tuple[str]] = list(reversed(node.children))
    while todo:
        item = todo.pop()
        if isinstance(item, tuple):
            out.append(item[0])
        elif isinstance(item, str):
            out.append(escape(item, quote=False))
        else:
            out.append(f"<{item.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in item.attrs.items()) + ">")
            if item.tag not in VOID:
                todo.append((f"</{item.tag}>",))
                todo += reversed(item.children)
    return "".join(out)


def _folded(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text).strip()


def title_of(root: Node) -> str:
    title = next((n for n in root.walk() if n.tag == "title"), None)
    return _folded("".join(t.strip() for t, _ in title.texts())) if title else ""


def text_of(root: Node, most: int = MAX_TEXT) -> str:
    """Text of the page: content first, chrome last, at most so many characters."""
    zones: tuple[list[str], ...] = ([], [], [])
    known: dict[int, int] = {}
    for text, holder in root.texts():
        if text := text.strip():
            zones[known.setdefault(id(holder), holder.zone())].append(text)
    return _folded(" ".join(sum(zones, [])))[:most]


def links_of(root: Node, page_url: str) -> list[dict]:
    """Links in the order found: anchors, embedded sources, then documents named in the query of either."""
    found = []

    def add(reference: str, text: str, zone: int) -> None:
        url = resolve(reference, page_url)
        norm = normalize(url)
        if norm:
            found.append({"text": text, "url": url, "norm": norm, "zone": zone})

    elements = list(root.walk())
    for node in elements:
        if node.tag == "a" and (href := node.attrs.get("href", "").strip()):
            add(href, _folded(" ".join(t for t in (x.strip() for x, _ in node.texts()) if t)), node.zone())
    for tag, attribute in EMBEDDED:
        for node in elements:
            if node.tag == tag and (source := node.attrs.get(attribute, "").strip()):
                add(source, node.attrs.get("title", "").strip() or "[embedded document]", node.zone())
    for link in list(found):
        for inner in nested_documents(link["url"]):
            add(inner, link["text"] or "[embedded document]", link["zone"])
    return [{**link, "pos": i} for i, link in enumerate(found)]


def rank_by_zone(links: list[dict], most: int = MAX_LINKS) -> list[dict]:
    """Links by zone, each address once."""
    kept: dict[str, dict] = {}
    for link in sorted(links, key=lambda x: x["zone"]):
        kept.setdefault(link["norm"], link)
    return list(kept.values())[:most]


def read_page(html: str | None, page_url: str, most: int = MAX_TEXT) -> tuple[str, str, list[dict]]:
    """Title, text and links (not yet deduplicated) of a page, sanitised."""
    root = sanitize(parse(html or ""))
    return title_of(root), text_of(root, most), links_of(root, page_url)


def plain_text(html: str) -> str:
    """All visible text, for relevance scoring: pieces joined by a space."""
    return " ".join(t for t in (x.strip() for x, _ in sanitize(parse(html)).texts()) if t)
