"""A small HTML tree builder after the HTML standard: implied and missing end tags, void and
raw elements, tables with implied parts and foster parenting, and active formatting elements,
which are opened again in the next paragraph when an end tag is missing."""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

from quire.kernels.html_tokens import END, START, TEXT, Scanner

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre listing search section summary table ul plaintext xmp li dd dt".split())
SPECIAL = CLOSES_P | frozenset("area base body br button caption col colgroup embed frame frameset head html iframe img input link marquee meta noembed noframes noscript object param script select source style tbody td template textarea tfoot th thead title tr track wbr applet".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
BLOCKS = CLOSES_P | frozenset("html head body frameset script noscript style meta link title frame noframes ins del caption thead tfoot tbody colgroup col tr th td video audio canvas template svg math".split())
#: Elements nested deeper than this become siblings, as in browsers; walks of the tree recur.
DEEPEST = 256
#: As many elements that were never closed are opened again in a later paragraph.
REOPENED = 16
sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEEPEST))
_ATTR = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Element | str] = []
        self.parent: Element | None = None

    def add(self, child: Element | str, before: Element | None = None) -> None:
        at = len(self.children)
        if before is not None:  # a table is near the end
            at = next((k for k in range(at - 1, -1, -1) if self.children[k] is before), at)
        if isinstance(child, str):
            self.children.insert(at, child)
            return
        if child.parent is not None:
            child.remove()
        child.parent = self
        self.children.insert(at, child)

    def remove(self) -> None:
        if self.parent is not None:
            own = self.parent.children
            del own[next(k for k in range(len(own) - 1, -1, -1) if own[k] is self)]
            self.parent = None

    def join_texts(self) -> None:
        """Neighbouring texts as one."""
        own, out = self.children, []
        if len(own) < 2:
            return
        run: list[str] = []
        for c in own:
            if isinstance(c, str):
                run.append(c)
            else:
                if run:
                    out.append("".join(run))
                    run = []
                out.append(c)
        if run:
            out.append("".join(run))
        if len(out) < len(own):
            self.children = out

    def elements(self) -> list[Element]:
        return [c for c in self.children if type(c) is Element]

    def descendants(self) -> Iterator[Element]:
        """Elements below this one, in document order."""
        open_ = self.elements()[::-1]
        while open_:
            e = open_.pop()
            yield e
            if e.children:
                open_ += [c for c in reversed(e.children) if type(c) is Element]

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def text(self) -> str:
        """The text with white space made single; blocks and line breaks part words."""
        out: list[str] = []
        open_: list[Element | str] = [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                if x.tag in BLOCKS or x.tag == "br":
                    out.append(" ")
                open_ += x.children[::-1]
        return " ".join(re.split(r"[ \t\n\f\r]+", "".join(out))).strip(" ")


class Document:
    def __init__(self) -> None:
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.html.add(self.head)
        self.html.add(self.body)

    def settle(self) -> None:
        """Ends the building: texts that were added piece by piece become one."""
        self.html.join_texts()
        for e in self.html.descendants():
            e.join_texts()

    def title(self) -> str:
        found = next((e for e in self.html.descendants() if e.tag == "title"), None)
        return found.text() if found is not None else ""


class Builder:
    def __init__(self) -> None:
        self.doc = Document()
        self.stack: list[Element] = [self.doc.html]
        self.active: list[Element | None] = []  # None marks a cell's or caption's start
        self.in_head = True

    # --- where nodes go -----------------------------------------------------------------

    def place(self, node: Element | str) -> None:
        top = self.stack[-1]
        if top.tag not in TABLE_PARTS:
            top.add(node)
            return
        loose = node.strip(" \t\n\f\r") if isinstance(node, str) else node.tag not in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col", "script", "style", "template", "form", "input")
        if loose:
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.add(node, before=table)
                return
        top.add(node)

    def body(self) -> None:
        if self.in_head:
            self.in_head = False
            self.stack = [self.doc.html, self.doc.body]

    def open(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        self.place(e)
        if len(self.stack) < DEEPEST:
            self.stack.append(e)
        return e

    # --- the stack of open elements -----------------------------------------------------

    def in_scope(self, tags: frozenset[str], scope: frozenset[str] = SCOPE) -> bool:
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in scope:
                return False
        return False

    def pop_to(self, tags: frozenset[str]) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope(frozenset({"p"}), SCOPE | {"button"}):
            self.pop_to(frozenset({"p"}))

    def back_to(self, tags: frozenset[str]) -> None:
        while len(self.stack) > 2 and self.stack[-1].tag not in tags:
            self.stack.pop()

    # --- active formatting --------------------------------------------------------------

    def reopen(self) -> None:
        """Opens again the formatting elements that were closed from outside."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for j in range(k, len(self.active)):
            if len(self.stack) == DEEPEST:
                return
            old = self.active[j]
            self.active[j] = self.open(old.tag, dict(old.attrs))

    def push_active(self, e: Element) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        elif len(self.active) >= REOPENED and (own := self.since_mark()) and len(own) >= REOPENED:
            self.active.remove(own[-1])
        self.active.append(e)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end_formatting(self, tag: str) -> None:
        """The adoption agency: misnested formatting is split around the blocks it crosses."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            f = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    f = x
                    break
            if f is None:
                self.end_other(tag)
                return
            if f not in self.stack:
                self.active.remove(f)
                return
            at = self.stack.index(f)
            if not self.in_scope(frozenset({tag})):
                return
            far = next((e for e in self.stack[at + 1 :] if e.tag in SPECIAL), None)
            if far is None:
                del self.stack[at:]
                self.active.remove(f)
                return
            above, mark = self.stack[at - 1], self.active.index(f)
            last, k, inner = far, self.stack.index(far), 0
            while True:
                k -= 1
                node = self.stack[k]
                if node is f:
                    break
                inner += 1
                if node not in self.active or inner > 3:
                    if node in self.active:
                        self.active.remove(node)
                    del self.stack[k]
                    continue
                fresh = Element(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = fresh
                self.stack[k] = fresh
                if last is far:
                    mark = self.active.index(fresh) + 1
                fresh.add(last)
                last = fresh
            if above.tag in TABLE_PARTS and (table := next((e for e in reversed(self.stack) if e.tag == "table"), None)) is not None and table.parent is not None:
                table.parent.add(last, before=table)
            else:
                above.add(last)
            fresh = Element(f.tag, dict(f.attrs))
            fresh.children, far.children = far.children, []
            for c in fresh.elements():
                c.parent = fresh
            far.add(fresh)
            mark = min(mark, len(self.active))
            here = self.active.index(f)
            self.active.remove(f)
            self.active.insert(mark - (here < mark), fresh)
            self.stack.remove(f)
            self.stack.insert(self.stack.index(far) + 1, fresh)

    # --- tokens -------------------------------------------------------------------------

    def characters(self, text: str) -> None:
        if not text:
            return
        if self.in_head:
            if not text.strip(" \t\n\f\r"):
                return
            self.body()
        if self.stack[-1].tag not in TABLE_PARTS or text.strip(" \t\n\f\r"):
            self.reopen()
        self.place(text)

    def start(self, tag: str, attrs: dict[str, str]) -> Element | None:
        if tag in ("html", "body"):
            to = self.doc.html if tag == "html" else self.doc.body
            to.attrs = attrs | to.attrs
            if tag == "body":
                self.body()
            return None
        if tag == "head":
            return None
        if self.in_head and tag in HEAD_ONLY:
            e = Element(tag, attrs)
            self.doc.head.add(e)
            return e
        self.body()
        top = self.stack[-1].tag
        if tag in CLOSES_P:
            if tag == "li":
                self.close_item(frozenset({"li"}))
            elif tag in ("dd", "dt"):
                self.close_item(frozenset({"dd", "dt"}))
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
        elif tag in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"):
            return self.table_part(tag, attrs)
        elif tag == "a" and any(x is not None and x.tag == "a" for x in self.since_mark()):
            self.end_formatting("a")
            stale = next((x for x in self.since_mark() if x.tag == "a"), None)
            if stale is not None:
                self.active.remove(stale)
                if stale in self.stack:
                    self.stack.remove(stale)
        elif tag == "nobr" and self.in_scope(frozenset({"nobr"})):
            self.end_formatting("nobr")
        elif tag == "button" and self.in_scope(frozenset({"button"})):
            self.pop_to(frozenset({"button"}))
        if tag not in SPECIAL or tag in ("br", "img", "input", "embed", "wbr", "area", "button", "select", "textarea", "object", "applet", "marquee"):
            if top not in TABLE_PARTS or tag not in ("input",):
                self.reopen()
        if tag in VOID:
            e = Element(tag, attrs)
            self.place(e)
            return e
        e = self.open(tag, attrs)
        if tag in FORMATTING and self.stack[-1] is e:
            self.push_active(e)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)
        return e

    def since_mark(self) -> list[Element]:
        out = []
        for x in reversed(self.active):
            if x is None:
                break
            out.append(x)
        return out

    def close_item(self, tags: frozenset[str]) -> None:
        for e in reversed(self.stack):
            if e.tag in tags:
                self.pop_to(tags)
                return
            if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, attrs: dict[str, str]) -> Element | None:
        if not any(e.tag == "table" for e in self.stack):
            return None
        if tag in ("td", "th"):
            self.leave_cell()
            self.back_to(frozenset({"tr", "tbody", "thead", "tfoot", "table"}))
            if self.stack[-1].tag == "table":
                self.open("tbody", {})
            if self.stack[-1].tag != "tr":
                self.open("tr", {})
            e = self.open(tag, attrs)
            self.active.append(None)
            return e
        self.leave_cell()
        if tag == "tr":
            self.back_to(frozenset({"tbody", "thead", "tfoot", "table"}))
            if self.stack[-1].tag == "table":
                self.open("tbody", {})
            return self.open(tag, attrs)
        if tag == "col":
            self.back_to(frozenset({"colgroup", "table"}))
            e = Element(tag, attrs)
            self.stack[-1].add(e)
            return e
        self.back_to(frozenset({"table"}))
        e = self.open(tag, attrs)
        if tag == "caption":
            self.active.append(None)
        return e

    def leave_cell(self) -> None:
        cell = frozenset({"td", "th", "caption"})
        if self.in_scope(cell, frozenset({"table", "html"})):
            self.pop_to(cell)
            self.clear_active()

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head") or self.in_head:
            if tag == "head":
                self.body()
            if tag == "br":
                self.start("br", {})
            return
        if tag == "br":
            self.start("br", {})
        elif tag == "p":
            if not self.in_scope(frozenset({"p"}), SCOPE | {"button"}):
                self.start("p", {})
            self.close_p()
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
        elif tag in ("td", "th", "caption"):
            if self.in_scope(frozenset({tag}), frozenset({"table", "html"})):
                self.pop_to(frozenset({tag}))
                self.clear_active()
        elif tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if self.in_scope(frozenset({tag}), frozenset({"html"} if tag == "table" else {"html", "table"})):
                self.leave_cell()
                self.pop_to(frozenset({tag}))
        elif tag == "li":
            if self.in_scope(frozenset({"li"}), SCOPE | {"ul", "ol"}):
                self.pop_to(frozenset({"li"}))
        elif tag in SPECIAL:
            if self.in_scope(frozenset({tag})):
                self.pop_to(frozenset({tag}))
                if tag in ("applet", "marquee", "object"):
                    self.clear_active()
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in SPECIAL:
                return


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(page: str) -> Document:
    """The document of a page; whatever the bytes, there is one."""
    b = Builder()
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
    scan = Scanner(page, 1 if page.startswith("\ufeff") else 0)
    for kind, value, raw in scan:
        tag = value.lower()
        if kind == TEXT:
            b.characters(entities.unescape(value))
        elif kind == END:
            b.end(tag)
        elif kind == START:
            e = b.start(tag, attributes(raw) if raw else {})
            if tag in RAW_TEXT or tag in ("title", "textarea"):
                inner = scan.raw_text(tag)
                if e is not None and inner:
                    e.add(inner if tag in RAW_TEXT else entities.unescape(inner))
                if b.stack and b.stack[-1] is e:
                    b.stack.pop()
            elif tag == "pre" and page[scan.at : scan.at + 1] == "\n":
                scan.at += 1
    b.doc.settle()
    return b.doc
