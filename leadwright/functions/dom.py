"""A page's signals for contact extraction: links, microdata, tables and text, by parser events."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from leadwright.functions.addresses import Scanner

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN, NOISE = ("script", "style", "template"), ("script", "style", "noscript", "template")
CONTAINER, ROW = 600, 5000

#: What signals() and links() give for a page, as Spark DDL.
SIGNALS = "title string, page_name string, found array<struct<seq:int,rung:string,kind:string,raw:string,parent:int,container:string,headers:array<string>,cells:array<string>,row_text:string,near:string,snippet:string>>"
LINKS = "array<struct<pos:int,url:string,text:string,rel:array<string>>>"


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items", "number")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None, number: int):
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.items: list = []

    def strings(self, skip: tuple = HIDDEN):
        """The strings below, in order."""
        todo = [iter(self.items)]
        while todo:
            for x in todo[-1]:
                if isinstance(x, str):
                    yield x
                elif x.tag not in skip:
                    todo.append(iter(x.items))
                    break
            else:
                todo.pop()

    def text(self, skip: tuple = HIDDEN, most: int | None = None) -> str:
        """The stripped strings below, joined; not read on beyond `most` characters."""
        parts, size = [], -1
        for s in self.strings(skip):
            if t := s.strip():
                parts.append(t)
                size += len(t) + 1
                if most is not None and size >= most:
                    break
        return " ".join(parts)[:most]


class _Page(HTMLParser):
    """A light tree. An end tag closes up to the nearest open element of its name; others that are open inside it end with it.

    The open elements of each tag are kept, so that a tag is looked up among them and not by walking up.
    """

    #: Tags that end an open element of their own inside the nearest of these.
    SAME = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("div", "td", "body", "li", "section", "article")}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#page", {}, None, 0)
        self.nodes: list[_Node] = []
        self.open: dict[str, list[_Node]] = {}

    def innermost(self, tag: str) -> int:
        """The number of the innermost open element of a tag; 0 if there is none. Of open elements the inner one has the larger number."""
        return self.open[tag][-1].number if self.open.get(tag) else 0

    def close_to(self, tag: str) -> None:
        """Close the innermost element of a tag and all that is open inside it."""
        while True:
            node = self.at
            self.open[node.tag].pop()
            self.at = node.parent
            if node.tag == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SAME and self.innermost(tag) > max(self.innermost(t) for t in self.SAME[tag]):
            self.close_to(tag)
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.nodes) + 1)
        self.at.items.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open.setdefault(tag, []).append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.close_to(tag)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as `<![if x]>` are comments."""
        return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _read(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _ends(nodes: list[_Node]) -> list[int]:
    """For each number, that of the last node in its subtree: nodes are numbered as they open, so a subtree is a run of numbers."""
    last = list(range(len(nodes) + 1))
    for x in reversed(nodes):
        if x.parent:
            last[x.parent.number] = max(last[x.parent.number], last[x.number])
    return last


def _below(node: _Node, nodes: list[_Node], last: list[int], tags: tuple) -> list[_Node]:
    return [x for x in nodes[node.number : last[node.number]] if x.tag in tags]


def links(html: str | None, base: str | None) -> list[dict]:
    """Links of a page in document order, absolute; those that cannot be resolved against the base are left out."""
    found, pos = [], 0
    for a in _read(html).nodes:
        if a.tag == "a" and (href := a.attrs.get("href", "").strip()):
            try:
                found.append({"pos": pos, "url": urljoin(base, href), "text": "".join(a.strings()).strip().lower()[:100], "rel": a.attrs.get("rel", "").lower().split()})
            except ValueError:
                pass
            pos += 1
    return found


def signals(html: str | None, scanner: Scanner, most_chars: int = 0, near: int = 300, snippet: int = 200) -> dict:
    """Title, first itemprop=name, and what may be contacts (raw) of a page. Nothing is judged here.

    Addresses of the running text carry the text around them, `near` and `snippet` characters to both sides. most_chars:
    characters of the text that are scanned for addresses; 0: all.
    """
    page = _read(html)
    found: list[dict] = []

    def add(rung: str, kind: str, raw: str, node: _Node | None = None, **more) -> None:
        parent = node.parent if node else None
        container = parent.text(NOISE, CONTAINER) if parent and rung in ("mailto_tel", "microdata") else None
        found.append({"seq": len(found), "rung": rung, "kind": kind, "raw": raw, "parent": parent.number if parent else None, "container": container} | more)

    for a in page.nodes:
        if a.tag == "a" and (href := a.attrs.get("href", "")):
            if href.startswith("mailto:"):
                add("mailto_tel", "email", href[7:].split("?")[0], a)
            elif href.startswith("tel:"):
                add("mailto_tel", "phone", href, a)
    for x in page.nodes:
        if (prop := x.attrs.get("itemprop", "").lower()) in ("email", "telephone", "phone"):
            if raw := x.attrs.get("content") or "".join(s.strip() for s in x.strings()):
                add("microdata", "email" if prop == "email" else "phone", raw, x)
    last = _ends(page.nodes)
    for table in page.nodes:
        if table.tag != "table" or len(rows := _below(table, page.nodes, last, ("tr",))) < 2:
            continue
        headers = ["".join(s.strip() for s in c.strings()).lower() for c in _below(rows[0], page.nodes, last, ("th", "td"))]
        for row in rows[1:]:
            cells = [c.text() for c in _below(row, page.nodes, last, ("td", "th"))]
            if cells and len(row_text := " ".join(cells)) <= ROW and "@" in row_text:
                add("table_block", "row", row_text, row, headers=headers, cells=cells, row_text=row_text)
    text = " ".join(page.root.strings())
    scanned = text[:most_chars] if most_chars else text
    for kind, places in (("email", scanner.plain(scanned)), ("bracketed", scanner.with_marks(scanned))):
        for start, end in places:
            add("proximity_text", kind, scanned[start:end], near=text[max(start - near, 0) : end + near], snippet=text[max(start - snippet, 0) : end + snippet])
    title = next((t for n in page.nodes if n.tag == "title" and (t := "".join(n.strings()).strip())), "")
    names = (x.text(NOISE) for x in page.nodes if x.attrs.get("itemprop") == "name")
    return {"title": title, "page_name": next((n[:80] for n in names if n), None), "found": found}
