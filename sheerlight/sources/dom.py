"""HTML to a tree: elements, text, comments, open shadow roots and inline frames, by the standard library's tokenizer.

The tree follows the rules of HTML that decide what a text's parent is: void elements, implied end tags of paragraphs, list items, table
parts and options, raw text, and what lies inside the body.  Scripts don't run, so what a page builds at runtime isn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta title style script noscript template".split())
#: A new one of these ends an open one of the others, up to a container that stops the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: A block element ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


class Node:
    """An element (``tag``), a text or a comment; ``shadow`` is an element's open shadow root, ``frame`` what an inline frame holds: a
    document, or an ``outside`` node with the address of one.
    """

    __slots__ = ("kind", "tag", "attrs", "text", "parent", "children", "shadow", "frame", "host")

    def __init__(self, kind: str, tag: str = "", attrs: dict[str, str] | None = None, text: str = ""):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.shadow: Node | None = None
        self.frame: Node | None = None
        self.host: Node | None = None

    def add(self, child: Node) -> Node:
        last = self.children[-1] if self.children else None
        if child.kind == "text" and last is not None and last.kind == "text":
            last.text += child.text
            return last
        child.parent = self
        self.children.append(child)
        return child

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order; shadow roots and templates keep theirs to themselves."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "element":
                yield n
                stack += n.children[::-1]

    def walk(self) -> Iterator[Node]:
        """All texts and comments below, in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "element":
                stack += n.children[::-1]
            else:
                yield n


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.document = Node("document")
        self.html = self.document.add(Node("element", "html"))
        self.head = self.html.add(Node("element", "head"))
        self.body: Node | None = None
        self.open: list[Node] = []
        self.quiet = 0  # inside templates and noscript nothing is part of the page
        self.after: Node | None = None
        self.frames: list[tuple[Node, str]] = []  # frames whose documents are still to be parsed

    def top(self) -> Node:
        if self.body is None and not self.open:
            self.body = self.html.add(Node("element", "body"))
        return self.open[-1] if self.open else self.body

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if self.quiet:
            self.quiet += tag in ("template", "noscript")
            return
        if tag == "html":
            self.html.attrs = given | self.html.attrs
            return
        if tag == "head":
            return
        if tag == "body":
            if self.body is None:
                self.body = self.html.add(Node("element", "body", given))
            else:
                self.body.attrs = given | self.body.attrs
            return
        if tag in ENDS:
            ended, stop = ENDS[tag]
            self._end(ended, stop)
        if tag in BLOCKS:
            self._end({"p"}, {"button", "td", "th", "caption", "object"}, first=True)
        place = self.open[-1] if self.open else (self.head if self.body is None and tag in HEAD else self.top())
        if tag in ("template", "noscript"):
            if tag == "template" and given.get("shadowrootmode", "").lower() in ("open", "closed") and place.kind == "element" and place.shadow is None:
                root = Node("shadow")
                root.host = place
                if given["shadowrootmode"].lower() == "open":
                    place.shadow = root
                self.open.append(root)
                return
            place.add(Node("element", tag, given))
            self.quiet = 1
            return
        node = place.add(Node("element", tag, given))
        if tag == "base" and "href" in given:
            self.document.attrs.setdefault("base", given["href"].strip())
        if tag == "iframe" and ("sandbox" not in given or "allow-same-origin" in given["sandbox"].lower().split()):
            if "srcdoc" in given:
                self.frames.append((node, given["srcdoc"]))
            elif given.get("src", "").strip():
                node.frame = Node("outside", text=given["src"].strip())
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _end(self, ended: set[str], stop: set[str], first: bool = False) -> None:
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if n.kind == "shadow" or n.tag in stop:
                break
            if n.tag in ended:
                at = i
                if first:
                    break
        if at is not None:
            del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.quiet:
            self.quiet -= tag in ("template", "noscript")
            return
        if tag in ("body", "html"):
            self.open.clear()
            self.after = self.html if tag == "body" or self.after is None else self.document
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if n.kind == "shadow":
                if tag == "template":
                    del self.open[i:]
                return
            if n.tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        if self.body is None and not self.open and not data.strip(" \t\n\f\r"):
            return
        self.top().add(Node("text", text=data))

    def handle_comment(self, data: str) -> None:
        if self.quiet:
            return
        place = self.open[-1] if self.open else (self.after or self.body or self.head)
        place.add(Node("comment", text=data))

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is a comment up to the next ``>``, whatever stands in it."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def parse(html: str) -> Node:
    """The document, with those of its inline frames; each has a body."""
    whole: Node | None = None
    todo: list[tuple[Node | None, str]] = [(None, html)]
    while todo:
        owner, text = todo.pop()
        b = _Builder()
        b.feed(text)
        b.close()
        if b.body is None:
            b.body = b.html.add(Node("element", "body"))
        if owner is None:
            whole = b.document
        else:
            owner.frame = b.document
        todo += b.frames
    return whole


def body_of(document: Node) -> Node:
    return next(n for n in document.children[0].children if n.tag == "body")


def roots(start: Node, address: str = "") -> list[Node]:
    """A document or shadow root, then those below it in document order: shadow roots first, then the frame, of each element.

    A frame that holds another page is an ``outside`` root, with the whole ``address`` among its attributes.
    """
    out: list[Node] = []
    stack = [(start, address)]
    while stack:
        root, base = stack.pop()
        out.append(root)
        if root.kind == "outside":
            root.attrs["address"] = _joined(base, root.text)
            continue
        base = _joined(base, root.attrs.get("base", "")) if root.kind == "document" else base
        below = [(x, base) for e in scope(root).elements() for x in (e.shadow, e.frame) if x is not None]
        stack += below[::-1]
    return out


def _joined(base: str, address: str) -> str:
    try:
        return urljoin(base, address)
    except ValueError:  # no address
        return ""


def scope(root: Node) -> Node:
    """What is scanned of a root: a document's body, or all of a shadow root."""
    return body_of(root) if root.kind == "document" else root


def parent_or_host(e: Node) -> Node | None:
    p = e.parent
    if p is None or p.kind == "document":
        return None
    return p.host if p.kind == "shadow" else p
