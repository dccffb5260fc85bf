"""HTML text to a tree of elements, and the tree to the semantic nodes of a page.

The standard library splits HTML into tags; the tree follows the rules that browsers share for tags left out: implied ends, void
elements, missing html, head and body, raw text, rows without a table body, and formatting that goes on in the next block. Text
loose in a table stays where it is, and formatting that closes across a block ends at the block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from lakeloom.functions import whatwg
from lakeloom.functions.text import python_role

# Sets of tags that the rules name.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("base basefont bgsound link meta title style script noscript template noframes".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing search section summary table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = ENDS_P | VOID | HEAD | set("html head body li dd dt tr td th tbody thead tfoot caption colgroup button select textarea iframe object marquee applet frameset template title".split())
SCOPE = set("html table td th caption object marquee applet template".split())
ROWS, SECTIONS = {"td", "th"}, {"tbody", "thead", "tfoot"}
EXCLUDED = {"script", "style", "template", "noscript", "head", "textarea"}
REGIONS = dict(main="main", nav="navigation", aside="complementary", header="banner", footer="contentinfo", section="region", article="article", form="form", ul="list", ol="list", li="listitem", table="table", tr="row", td="cell", th="columnheader")
INPUTS = dict(checkbox="checkbox", radio="radio", range="slider", search="searchbox", submit="button", button="button", reset="button")
ACTS = {"button", "link", "textbox", "checkbox", "radio", "combobox", "slider", "searchbox", "switch", "tab", "menuitem"}
TOLD = {"p", "pre", "code", "label", "time", "dt", "dd"}
BLOCKS = {"p", "div", "section", "article", "button", "a"}
CONTAINERS = {"section", "article", "main", "nav", "form", "li", "div"}
#: Attributes that name what a part of a page is about.
ENTITY = ("data-entity", "itemid")
MAX_DEPTH, MAX_TEXT, MAX_CONTENT, MAX_NAME = 100, 4000, 2000, 500
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"[\s\ufeff]+")


class DepthError(ValueError):
    """A page whose elements lie deeper in each other than MAX_DEPTH."""


class Element:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.html.kids = [self.head, self.body]
        self.open: list[Element] = [self.html]
        self.formats: list[Element | None] = []
        self.in_body = False

    # Places.
    def _at(self) -> Element:
        return self.open[-1]

    def _start_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, [self.html, self.body]

    def _in_scope(self, tags: set[str], also: frozenset = frozenset()) -> bool:
        for e in reversed(self.open):
            if e.tag in tags:
                return True
            if e.tag in SCOPE or e.tag in also:
                return False
        return False

    def _pop_to(self, tags: set[str]) -> None:
        while len(self.open) > 2:
            if self.open.pop().tag in tags:
                return

    def _end_p(self) -> None:
        if self._in_scope({"p"}, frozenset({"button"})):
            self._pop_to({"p"})

    def _end_item(self, tags: set[str]) -> None:
        for e in reversed(self.open):
            if e.tag in tags:
                return self._pop_to(tags)
            if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                return None

    def _restore(self) -> None:
        """Open anew the formatting that ended with a block but was never closed."""
        i = len(self.formats)
        while i and self.formats[i - 1] is not None and self.formats[i - 1] not in self.open:
            i -= 1
        for j in range(i, len(self.formats)):
            e = Element(self.formats[j].tag, self.formats[j].attrs)
            self._at().kids.append(e)
            self.open.append(e)
            self.formats[j] = e

    def _add(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        self._at().kids.append(e)
        if tag not in VOID:
            self.open.append(e)
        return e

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        inside = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), 0)
        if not inside:
            return
        keep = {"table"} if tag in SECTIONS | {"caption", "colgroup"} else {"table", "colgroup"} if tag == "col" else {"table"} | SECTIONS if tag == "tr" else {"table", "tr"} | SECTIONS
        while len(self.open) - 1 > inside and self._at().tag not in keep:
            if self.open.pop().tag in ROWS | {"caption"}:
                self._clear_formats()
        if tag in ROWS | {"tr"} and self._at().tag == "table":
            self._add("tbody", {})
        if tag in ROWS and self._at().tag != "tr":
            self._add("tr", {})
        self._add(tag, attrs)
        if tag in ROWS | {"caption"}:
            self.formats.append(None)

    def _clear_formats(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    # Tokens.
    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v if v is not None else "")
        if tag in ("html", "head", "body"):
            for k, v in own.items():
                {"html": self.html, "head": self.head, "body": self.body}[tag].attrs.setdefault(k, v)
            if tag == "body":
                self._start_body()
            return
        if not self.in_body and tag in HEAD:
            self.open = [self.html, self.head]
            self._add(tag, own)
            return
        self._start_body()
        if tag in SECTIONS | ROWS | {"tr", "caption", "col", "colgroup"}:
            self._table_part(tag, own)
            return
        if tag in ENDS_P:
            self._end_p()
        if tag in HEADINGS and self._at().tag in HEADINGS:
            self.open.pop()
        if tag == "li":
            self._end_item({"li"})
            self._end_p()
        elif tag in ("dd", "dt"):
            self._end_item({"dd", "dt"})
            self._end_p()
        elif tag == "button" and self._in_scope({"button"}):
            self._pop_to({"button"})
        elif tag in ("option", "optgroup") and self._at().tag == "option":
            self.open.pop()
        elif tag == "a" and any(f is not None and f.tag == "a" for f in self._since_marker()):
            self.handle_endtag("a")
        if tag not in ENDS_P | HEAD | {"li", "dd", "dt", "param", "source", "track"}:
            self._restore()
        e = self._add(tag, own)
        if tag in FORMATTING:
            same = [f for f in self._since_marker() if f is not None and f.tag == tag and f.attrs == own]
            if len(same) >= 3:
                self.formats = [f for f in self.formats if f is not same[0]]
            self.formats.append(e)

    def _since_marker(self) -> list:
        i = len(self.formats)
        while i and self.formats[i - 1] is not None:
            i -= 1
        return self.formats[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if not self.in_body:
            if tag == "head":
                self._start_body()
            elif tag in HEAD and len(self.open) > 2:
                self.open.pop()
            return
        if tag == "p" and not self._in_scope({"p"}, frozenset({"button"})):
            self._add("p", {})
        if tag == "br":
            self._restore()
            self._add("br", {})
            return
        if tag in FORMATTING:
            e = next((f for f in reversed(self._since_marker()) if f is not None and f.tag == tag), None)
            if e is None:
                return
            self.formats = [f for f in self.formats if f is not e]
            if e in self.open:
                i = self.open.index(e)
                if any(x.tag in SPECIAL for x in self.open[i + 1 :]):
                    self.open.pop(i)
                else:
                    del self.open[i:]
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        for e in reversed(self.open[2:]):
            if e.tag in names:
                while len(self.open) > 2:
                    gone = self.open.pop()
                    if gone.tag in ROWS | {"caption"}:
                        self._clear_formats()
                    if gone is e:
                        return
            if e.tag in SPECIAL and (tag not in SPECIAL or e.tag in SCOPE and e.tag != tag and tag not in SECTIONS | {"tr", "table"}):
                return

    def handle_data(self, data: str) -> None:
        if not self.in_body:
            if len(self.open) > 2:
                self._at().kids.append(data)
                return
            data = data.lstrip()
            if not data:
                return
            self._start_body()
        if data.strip() or self._at().tag not in SECTIONS | {"table", "tr", "colgroup"}:
            self._restore() if data.strip() else None
            self._at().kids.append(data)


def parse_tree(html: str) -> Element:
    """The html element of a text of HTML."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.html


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or "inert" in a or a.get("aria-hidden") == "true" or a.get("type") == "hidden" or bool(_HIDDEN.search(a.get("style", "")))


def editable(a: dict[str, str]) -> bool:
    return "contenteditable" in a and a["contenteditable"] != "false"


def role_of(tag: str, a: dict[str, str]) -> str:
    """The role that an element has by its attribute, else by its tag."""
    if a.get("role"):
        return a["role"].split(" ")[0]
    if editable(a) or tag == "textarea":
        return "textbox"
    if tag in HEADINGS:
        return "heading"
    if tag == "a" and a.get("href"):
        return "link"
    if tag == "input":
        return INPUTS.get(a.get("type", ""), "textbox")
    return {"button": "button", "select": "combobox", "img": "img"}.get(tag) or REGIONS.get(tag, "text")


def nearest_heading(kids: list[Element]) -> Element | None:
    """The first heading among an element's children, else among their children."""
    return next((k for k in kids if k.tag in HEADINGS), None) or next((g for k in kids for g in k.elements() if g.tag in HEADINGS), None)


class _Reader:
    """Walks a tree once from the top and tells its semantic nodes."""

    def __init__(self, root: Element, url: str, entity: tuple[str, ...]):
        self.url, self.entity, self.nodes = url, entity, []
        self.texts: dict[int, str] = {}
        self.ids: dict[str, Element] = {}
        self.labels: dict[str, str] = {}
        self.title = ""
        every: list[Element] = []
        stack = [(root, 1)]
        while stack:
            e, depth = stack.pop()
            if depth > MAX_DEPTH:
                raise DepthError(f"elements lie deeper than {MAX_DEPTH}")
            every.append(e)
            if e.attrs.get("id"):
                self.ids[e.attrs["id"]] = e
            stack += [(k, depth + 1) for k in e.elements()]
        for e in every:
            if e.tag == "label" and e.attrs.get("for"):
                self.labels[e.attrs["for"]] = clean(self.text(e))
            elif e.tag == "title":
                self.title = clean(self.text(e))
        self.visit(root, "html", None, "", False, "", "")

    def text(self, e: Element, all_: bool = False) -> str:
        """An element's text without what is hidden, excluded or typed in by users."""
        if e.tag in EXCLUDED or editable(e.attrs) or not all_ and hidden(e.attrs):
            return ""
        if not all_ and id(e) in self.texts:
            return self.texts[id(e)]
        out = " ".join(k if isinstance(k, str) else self.text(k, all_) for k in e.kids)[:MAX_TEXT]
        if not all_:
            self.texts[id(e)] = out
        return out

    def name(self, e: Element, role: str, content: str, label: str) -> str:
        """The accessible name: the first that is filled of what names an element."""
        a = e.attrs
        labelled = " ".join(self.text(self.ids[i], True) for i in a.get("aria-labelledby", "").split() if i in self.ids)
        ways = [labelled, a.get("aria-label"), self.labels.get(a.get("id", "")), label if e.tag in ("input", "textarea", "select") else "", a.get("alt"), a.get("value") if e.tag == "input" and role == "button" else "", content, a.get("placeholder"), a.get("title")]
        return clean(next((w for w in ways if w), ""))[:MAX_NAME]

    def visit(self, e: Element, path: str, parent: dict | None, context: str, disabled: bool, label: str, entity: str) -> None:
        a, tag = e.attrs, e.tag
        if tag in EXCLUDED and tag != "textarea" or hidden(a):
            return
        kids = e.elements()
        content = clean(self.text(e))[:MAX_CONTENT]
        role = role_of(tag, a)
        label = content if tag == "label" else label
        name = self.name(e, role, content, label)
        acts = role in ACTS
        own = clean(" ".join(k for k in e.kids if isinstance(k, str)))
        told = acts or role != "text" or tag in TOLD or bool(own) and not any(k.tag in BLOCKS for k in kids)
        disabled = disabled or "disabled" in a or a.get("aria-disabled") == "true"
        entity = next((a[k] for k in self.entity if a.get(k)), entity)
        if tag in CONTAINERS:
            heading = nearest_heading(kids)
            context = clean(a.get("aria-label") or (self.text(heading) if heading else "") or context)
        here = parent
        if told and (name or acts or role != "text"):
            here = {
                "node_id": f"n{len(self.nodes) + 1}", "pos": len(self.nodes), "tag": tag, "role": role, "text": content, "name": name, "semantic_role": python_role(name, role),
                "href": whatwg.resolve(a["href"], self.url) if a.get("href") else None, "interactive": acts, "disabled": disabled,
                "checked": "checked" in a or a.get("aria-checked") == "true" if role in ("checkbox", "radio", "switch") else None,
                "expanded": a["aria-expanded"] == "true" if a.get("aria-expanded") else None, "visibility": "unknown", "geometry": None,
                "aria": {k: v for k, v in a.items() if k.startswith("aria-") and k not in ("aria-valuetext", "aria-valuenow")},
                "parent_id": parent["node_id"] if parent else None, "children": [], "context": context, "entity": entity or context or None, "document_url": self.url,
                "frame_path": [], "locator": {"css": path, "test_id": a.get("data-testid"), "html_id": a.get("id")},
                "ancestors": [*parent["ancestors"], parent["node_id"]] if parent else [],
            }
            self.nodes.append(here)
            if parent:
                parent["children"].append(here["node_id"])
        if editable(a) or tag == "textarea":
            return
        seen: dict[str, int] = {}
        for k in kids:
            seen[k.tag] = seen.get(k.tag, 0) + 1
            self.visit(k, f"{path} > {k.tag}:nth-of-type({seen[k.tag]})", here, context, disabled, label, entity)


def semantic_document(html: str, url: str, entity: tuple[str, ...] = ENTITY) -> dict:
    """{"url", "title", "source", "nodes"} of a page's HTML; DepthError where its elements lie too deep."""
    r = _Reader(parse_tree(html), url, entity)
    return {"version": 1, "url": url, "title": r.title, "source": "http", "nodes": r.nodes}
