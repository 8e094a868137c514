"""Trees of XHTML files, and the rows that are read from them and written back.

Strict files are parsed as XML. Pages that are no XML are read by a tolerant
builder, which closes what is left open; it never fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from glossaflow.functions.masking import TOKEN, mask_markup, name_of

# Which elements are tasks, which are never translated, and what is watched.
TASK_TAGS = frozenset({
    "title", "section", "article", "div", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "dd", "dt",
    "figcaption", "caption", "td", "th", "q", "cite", "a", "em", "strong", "i", "b", "sup", "sub", "span",
})
OPAQUE_TAGS = frozenset({"code", "pre", "kbd", "samp", "var", "script", "style", "math", "annotation", "semantics"})
OPAQUE_CLASSES = frozenset({"no-translate", "notranslate", "raw", "code"})
CONTAINERS = frozenset({"section", "article", "div"})
WATCHED = frozenset({"id", "href", "src", "role", "epub:type"})
OPS = "http://www.idpf.org/2007/ops"
XHTML = "http://www.w3.org/1999/xhtml"
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})

ET.register_namespace("", XHTML)
ET.register_namespace("epub", OPS)


def parse_xml(data: bytes | str) -> ET.Element:
    return ET.fromstring(data)


def parsed(data: bytes | str | None) -> tuple[ET.Element | None, str | None]:
    """The root of a file, or why it doesn't parse."""
    try:
        return parse_xml(data), None
    except ET.ParseError as e:
        return None, str(e)


class _Tolerant(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if len(node):
            node[-1].tail = (node[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data


def parse_html(text: str | None) -> ET.Element:
    parser = _Tolerant()
    parser.feed(text or "")
    parser.close()
    top = [n for n in parser.root if n.tag == "html"]
    return top[0] if len(parser.root) == 1 and top else parser.root


def attribute(node: ET.Element, key: str) -> str:
    return node.get(key) or ""


def epub_type(node: ET.Element) -> str:
    return node.get("epub:type") or node.get(f"{{{OPS}}}type") or ""


def is_opaque(node: ET.Element) -> bool:
    if not node.attrib:
        return name_of(node.tag) in OPAQUE_TAGS
    return name_of(node.tag) in OPAQUE_TAGS or not OPAQUE_CLASSES.isdisjoint(attribute(node, "class").lower().split()) or attribute(node, "translate").lower() == "no"


def walk(root: ET.Element) -> Iterator[tuple[ET.Element, str, bool, bool]]:
    """(element, path, opaque, footnote) in document order; the last two inherited.

    A path names each step and its place among siblings of the same name.
    Comments and instructions are passed over.
    """
    stack = [(root, f"/{name_of(root.tag)}[1]", False, False)]
    while stack:
        node, path, opaque, footnote = stack.pop()
        opaque = opaque or is_opaque(node)
        footnote = footnote or "footnote" in epub_type(node).split()
        yield node, path, opaque, footnote
        if not len(node):
            continue
        seen: dict[str, int] = {}
        below = []
        for child in node:
            if isinstance(child.tag, str):
                name = name_of(child.tag)
                seen[name] = seen.get(name, 0) + 1
                below.append((child, f"{path}/{name}[{seen[name]}]", opaque, footnote))
        stack.extend(reversed(below))


def inner_xml(node: ET.Element) -> str:
    """Markup inside a node; its own text stays as it reads, unescaped."""
    return (node.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in node)


def _above_tasks(root: ET.Element) -> set[int]:
    """Ids of the elements that have a task element somewhere below."""
    pairs = [(node, child) for node in root.iter() for child in node]  # a parent's pairs come before its children's
    above: set[int] = set()
    for node, child in reversed(pairs):
        if id(child) in above or isinstance(child.tag, str) and name_of(child.tag) in TASK_TAGS:
            above.add(id(node))
    return above


def node_rows(root: ET.Element, titles: bool = True) -> Iterator[dict]:
    """A row for each element to translate, in document order."""
    above = _above_tasks(root)
    for node, path, opaque, footnote in walk(root):
        tag = name_of(node.tag)
        if opaque or tag not in TASK_TAGS or tag == "title" and not titles or tag in CONTAINERS and id(node) in above:
            continue
        text, pairs = mask_markup(inner_xml(node))
        text = text.strip()
        if TOKEN.sub("", text).strip():
            yield {"node_selector": path, "tag": tag, "classes": node.get("class"), "footnote": footnote, "source_text": text, "pairs": [{"token": t, "raw": r} for t, r in pairs]}


def text_rows(root: ET.Element) -> Iterator[str]:
    """Stripped text nodes of two code points or more, outside opaque elements."""
    for node, _, opaque, _ in walk(root):
        inside = [node.text, *(c.tail for c in node)] if not opaque else []
        yield from (t.strip() for t in inside if t and len(t.strip()) >= 2)


def anchor_rows(root: ET.Element) -> tuple[list[str], list[str]]:
    """Ids that a file holds, and the hrefs in it."""
    nodes = [n for n, *_ in walk(root)]
    return [n.get("id") for n in nodes if n.get("id")], [n.get("href") for n in nodes if n.get("href")]


def signatures(root: ET.Element) -> list[str]:
    """``tag|json`` of the watched attributes of each element that has any."""
    out = []
    for node, *_ in walk(root):
        kept = {}
        for key, value in node.attrib.items():
            name = "epub:type" if key.endswith("}type") else name_of(key)
            if name in WATCHED or name.startswith("aria-"):
                kept[name] = value
        if kept:
            out.append(f"{name_of(node.tag)}|{json.dumps(kept, ensure_ascii=False, sort_keys=True)}")
    return out


def nav_items(root: ET.Element) -> list[dict]:
    """Labelled links of the navs that are tables of contents."""
    out = []
    for nav, path, *_ in walk(root):
        if name_of(nav.tag) == "nav" and "toc" in epub_type(nav).split():
            for a, below, *_ in walk(nav):
                label = "".join(a.itertext()).strip()
                if name_of(a.tag) == "a" and a.get("href") and label:
                    out.append({"href": a.get("href"), "label_text": label, "node_selector": path + below[below.index("]") + 1 :], "kind": "nav"})
    return out


def ncx_items(root: ET.Element) -> list[dict]:
    out = []
    for point, path, *_ in walk(root):
        if name_of(point.tag) != "navPoint":
            continue
        steps = {p: n for n, p, *_ in walk(point)}
        content = next((n for n in point if name_of(n.tag) == "content"), None)
        for at, text in steps.items():
            below = at[at.index("]") + 1 :]
            label = (text.text or "").strip()
            if below.count("/") == 2 and below.startswith("/navLabel[") and name_of(text.tag) == "text" and label:
                out.append({"href": attribute(content, "src") if content is not None else "", "label_text": label, "node_selector": path + below, "kind": "ncx"})
    return out


def nav_hrefs(root: ET.Element) -> list[str]:
    """Links of all navs, whatever their type, each once."""
    seen, out = set(), []
    for nav in (n for n in root.iter() if isinstance(n.tag, str) and name_of(n.tag) == "nav"):
        for a in nav.iter():
            if isinstance(a.tag, str) and name_of(a.tag) == "a" and a.get("href") and id(a) not in seen:
                seen.add(id(a))
                out.append(a.get("href"))
    return out


def ncx_hrefs(root: ET.Element) -> list[str]:
    return [c.get("src") for p in root.iter() if isinstance(p.tag, str) and name_of(p.tag) == "navPoint" for c in p if isinstance(c.tag, str) and name_of(c.tag) == "content" and c.get("src")]


def set_inner(node: ET.Element, markup: str) -> None:
    """Replaces what a node holds; markup that doesn't parse becomes its text."""
    tail, attributes, tag = node.tail, dict(node.attrib), node.tag
    node.clear()
    node.tag, node.tail = tag, tail
    node.attrib.update(attributes)
    try:
        new = ET.fromstring(f"<root>{markup}</root>")
    except ET.ParseError:
        node.text = markup
        return
    node.text = new.text
    node.extend(list(new))


def decode(text: str, pairs: list[dict] | None) -> str:
    for p in pairs or ():
        text = text.replace(p["token"], p["raw"])
    return text


Children = dict[ET.Element, dict[str, list[ET.Element]]]


def children(node: ET.Element) -> dict[str, list[ET.Element]]:
    """The elements in a node by their names, in order."""
    out: dict[str, list[ET.Element]] = {}
    for c in node:
        if isinstance(c.tag, str):
            out.setdefault(name_of(c.tag), []).append(c)
    return out


def find(root: ET.Element, path: str, known: Children | None = None) -> ET.Element | None:
    """Element at a path as walk() gives it, or None; ``known`` keeps what the nodes on the way hold, for further paths."""
    first, *steps = path.strip("/").split("/")
    if first.rpartition("[")[0] != name_of(root.tag):
        return None
    node = root
    for step in steps:
        name, _, place = step.rpartition("[")
        held = known.get(node) if known is not None else None
        if held is None:
            held = children(node)
            if known is not None:
                known[node] = held
        same = held.get(name, [])
        n = int(place.rstrip("]"))
        if n > len(same):
            return None
        node = same[n - 1]
    return node


def rewritten(data: bytes, tasks: list[dict], plain_tag: str = "") -> bytes:
    """A file with translations put in; each place is looked up when its turn
    comes, and one that is gone by then is passed over. Elements named
    ``plain_tag`` take text instead of markup."""
    root = parse_xml(data)
    known: Children = {}
    for task in tasks:
        node = find(root, task["node_selector"], known)
        if node is not None:
            known.pop(node, None)  # it holds others from here on
            text = decode(task["text"], task.get("pairs"))
            if plain_tag and name_of(node.tag) == plain_tag:
                node.text = text
            else:
                set_inner(node, text)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


