"""Elements of UI markup: one reader for strict XML and for lenient HTML, and the texts that name an element."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate
from xml.parsers import expat

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: fixed values: attributes that name an element, and what the whitelist of the older element set holds
NAMING = ("description", "id", "text", "aria-label")
INTERACTIVE_TAGS = frozenset(("button", "input", "a", "select", "textarea"))
CONTENT_TAGS = frozenset(("p", "img", "span"))
CLICKABLE = ("clickable", "long-clickable")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str | None]
    depth: int
    direct: list[str] = field(default_factory=list)
    end: int = 0  # number of the first element after its subtree
    begin_text: int = 0  # its subtree's stretch of the document's texts
    end_text: int = 0
    begin: int = 0  # its stretch of characters; what isn't closed ends with its opening tag
    stop: int = 0

    def named(self, names: tuple[str, ...] = NAMING) -> set[str]:
        return {v.strip() for n in names if (v := self.attributes.get(n))}


class Document:
    """Elements in document order and the texts between tags; filled by either parser."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._held: Counter[str] = Counter()  # open elements of each tag
        self._piece: list[str] = []

    def _cut(self, shown: bool = True) -> None:
        piece = "".join(self._piece)
        self._piece.clear()
        if piece:
            if self._open:
                self.nodes[self._open[-1]].direct.append(piece)
            if shown and piece.strip():
                self.texts.append(piece.strip())

    def start(self, tag: str, attributes: dict[str, str | None], empty: bool = False, begin: int = 0, stop: int = 0) -> None:
        self._cut()
        self.nodes.append(Node(tag, attributes, len(self._open), begin_text=len(self.texts), begin=begin, stop=stop))
        self._open.append(len(self.nodes) - 1)
        self._held[tag] += 1
        if empty:
            self._leave()

    def _leave(self) -> None:
        node = self.nodes[self._open.pop()]
        self._held[node.tag] -= 1
        node.end, node.end_text = len(self.nodes), len(self.texts)

    def stop(self, tag: str, upto: int | None = None) -> None:
        """Close the innermost open element of that tag, which ends at ``upto``; a stray end tag does nothing."""
        shown = not (self._open and self.nodes[self._open[-1]].tag in ("script", "style", "template"))
        self._cut(shown)
        if self._held[tag]:
            while self.nodes[self._open[-1]].tag != tag:
                self._leave()
            if upto is not None:
                self.nodes[self._open[-1]].stop = upto
            self._leave()

    def data(self, text: str) -> None:
        self._piece.append(text)

    def comment(self, text: str) -> None:
        """A comment counts as an element's own text, not as that of the elements around it."""
        self._cut()
        self._piece.append(text)
        self._cut(shown=False)

    def close(self) -> Document:
        self._cut()
        while self._open:
            self._leave()
        return self


class _Lenient(HTMLParser):
    def __init__(self, into: Document, text: str):
        super().__init__(convert_charrefs=True)
        self.into, self.text = into, text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]  # where lines begin
        self.feed(text)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def opened(self, tag, attrs, empty):
        at = self.place()
        self.into.start(tag, {k: v if v is not None else "" for k, v in attrs}, empty, at, at + len(self.get_starttag_text()))

    def handle_starttag(self, tag, attrs):
        self.opened(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self.opened(tag, attrs, True)

    def handle_endtag(self, tag):
        self.into.stop(tag, self.text.find(">", self.place()) + 1 or len(self.text))

    def handle_data(self, data):
        self.into.data(data)

    def handle_comment(self, data):
        self.into.comment(data)


class _Strict:
    """Reads well-formed XML; raises ExpatError for anything else."""

    QUOTED = re.compile(rb"""(?:"[^"]*"|'[^']*'|[^"'>])*>""")

    def __init__(self, into: Document, text: str):
        bare = text.strip()
        self.into, self.raw, self.skipped = into, bare.encode("utf-8", "replace"), len(text) - len(text.lstrip())
        expat.ParserCreate().Parse(self.raw, True)  # most markup that isn't well formed ends here, before anything is made of it
        # characters before each byte, where they differ from bytes
        self.before = None if bare.isascii() else [0, *accumulate((b & 0xC0) != 0x80 for b in self.raw)]
        self.empty: list[bool] = []
        self.reader = expat.ParserCreate()
        self.reader.buffer_text = True
        self.reader.StartElementHandler, self.reader.EndElementHandler = self.opened, self.closed
        self.reader.CharacterDataHandler, self.reader.CommentHandler = into.data, into.comment
        self.reader.Parse(self.raw, True)

    def place(self, byte: int) -> int:
        return self.skipped + (byte if self.before is None else self.before[byte])

    def opened(self, tag, attributes):
        at = self.reader.CurrentByteIndex
        end = self.QUOTED.match(self.raw, at).end()
        self.empty.append(self.raw[end - 2 : end] == b"/>")
        self.into.start(tag, attributes, False, self.place(at), self.place(end))

    def closed(self, tag):
        at = self.reader.CurrentByteIndex
        self.into.stop(tag, None if self.empty.pop() else self.place(self.raw.index(b">", at) + 1))


def parsed(markup: str | None) -> Document:
    """Strict XML if it is; what isn't well formed is read as HTML, which skips fences and text before the first tag."""
    for reader in (_Strict, _Lenient):
        out = Document()
        try:
            reader(out, markup or "")
        except expat.ExpatError:
            continue
        return out.close()
    raise AssertionError("the lenient reader takes any text")


def full_text(doc: Document, k: int) -> str:
    """An element's own names and direct texts; if it has none, those of its descendants and all text below it."""
    node = doc.nodes[k]
    found = node.named() | {x.strip() for x in node.direct}
    if not found:
        found = set().union(*(n.named() for n in doc.nodes[k + 1 : node.end]))
        below = " ".join(doc.texts[node.begin_text : node.end_text])
        found |= {below} if below else set()
    return " | ".join(sorted(found))


def legacy_text(doc: Document, k: int, own: bool) -> str:
    """The older rule: own names and direct texts alone, or description and id of it and all below with their joined texts."""
    node = doc.nodes[k]
    if own:
        return " | ".join(sorted(node.named() | {x.strip() for x in node.direct if x.strip()}))
    inside = [node, *doc.nodes[k + 1 : node.end]]
    joined = {"".join(doc.texts[n.begin_text : n.end_text]) for n in inside}
    return " | ".join(sorted({x for n in inside for x in n.named(("description", "id"))} | {x for x in joined if x}))


def number(text: str | None) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return -1


def elements(markup: str | None, kind: str = "full", place: str = "index", aria: bool = False) -> list[dict]:
    """tag, text, index, bounds and depth of every element that counts.

    ``full`` takes every element, tags in lower case. ``legacy`` takes buttons and the like, content tags with text, clickable
    elements and, where ``place`` is "bounds", described ones (also by aria-label if ``aria``); its texts absorb those below
    unless ``place`` is "bounds". A missing or broken index is -1, missing bounds are empty.
    """
    doc, out = parsed(markup), []
    for k, node in enumerate(doc.nodes):
        a = node.attributes
        if kind == "full":
            tag, text = node.tag.lower(), full_text(doc, k)
        else:
            tag, text = node.tag, legacy_text(doc, k, place == "bounds")
            described = place == "bounds" and (a.get("description") or (aria and a.get("aria-label")))
            if not (tag in INTERACTIVE_TAGS or (tag in CONTENT_TAGS and text) or any(a.get(c) for c in CLICKABLE) or described):
                continue
        out.append({"tag": tag, "text": text, "index": number(a.get("index")), "bounds": a.get("bounds") or "", "depth": node.depth})
    return out


def element_lines(markup: str | None) -> list[str]:
    """Sorted distinct lines of the leaves of a tree."""
    doc = parsed(markup)
    return sorted({f"<{n.tag.lower()}>{full_text(doc, k)}" for k, n in enumerate(doc.nodes) if n.end == k + 1})
