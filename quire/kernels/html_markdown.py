"""An HTML tree as Markdown."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from quire.kernels.html_dom import Document, Element, parse
from quire.kernels.model import BLANK, BLANK_LINES, escape_cell, pipe_table

#: Elements that are no content; blocks that only set their content apart (fixed values).
DROPPED = frozenset("script style noscript head title meta link svg".split())
APART = frozenset("p div section article main header footer figure figcaption".split())
#: Quotes nested deeper than this are set apart only: each level marks all lines below it.
QUOTES = 32
#: Tables within tables, beyond this many, are set apart only: a table holds the rows of all
#: tables inside it, so that each level would double the text.
TABLES = 4
_SPACES = re.compile(r"[ \t\r\n\f]+")
_GAPS = re.compile(r"\n{3,}")


def single_spaced(text: str) -> str:
    return _SPACES.sub(" ", text)


def tidy(text: str) -> str:
    return _GAPS.sub("\n\n", text).strip(BLANK_LINES)


class Writer:
    """Renders elements; ``base`` resolves relative addresses."""

    def __init__(self, base: str = "") -> None:
        self.base = base if urlsplit(base).scheme else ""
        self.quotes = self.tables = 0

    def address(self, e: Element, name: str) -> str:
        raw = e.get(name)
        if not raw:
            return ""
        try:
            if self.base:
                return urljoin(self.base, raw.strip())
        except ValueError:
            pass
        return raw

    def inline(self, e: Element) -> str:
        return single_spaced(self.inside(e)).strip(BLANK)

    def inside(self, e: Element, as_is: bool = False) -> str:
        return "".join(self.node(c, as_is) for c in e.children)

    def node(self, x: Element | str, as_is: bool = False) -> str:
        if isinstance(x, str):
            return x if as_is else single_spaced(x)
        tag = x.tag
        if tag in DROPPED:
            return ""
        if tag in APART:
            return f"\n\n{self.inside(x, as_is)}\n\n"
        special = getattr(self, f"on_{tag}", None)
        return special(x, as_is) if special else self.inside(x, as_is)

    def heading(self, x: Element, as_is: bool) -> str:
        text = self.inline(x)
        return f"\n\n{'#' * int(x.tag[1])} {text}\n\n" if text else ""

    on_h1 = on_h2 = on_h3 = on_h4 = on_h5 = on_h6 = heading

    def on_br(self, x: Element, as_is: bool) -> str:
        return "  \n"

    def on_hr(self, x: Element, as_is: bool) -> str:
        return "\n\n---\n\n"

    def marked(self, x: Element, mark: str) -> str:
        text = self.inline(x)
        return f"{mark}{text}{mark}" if text else ""

    def on_strong(self, x: Element, as_is: bool) -> str:
        return self.marked(x, "**")

    def on_em(self, x: Element, as_is: bool) -> str:
        return self.marked(x, "*")

    on_b, on_i = on_strong, on_em

    def on_code(self, x: Element, as_is: bool) -> str:
        if x.parent is not None and x.parent.tag == "pre":
            return self.inside(x, True)
        text = x.text()
        return f"`{text}`" if text else ""

    def on_pre(self, x: Element, as_is: bool) -> str:
        return f"\n\n```\n{self.inside(x, True)}\n```\n\n"

    def on_a(self, x: Element, as_is: bool) -> str:
        text, href = self.inline(x), self.address(x, "href")
        return f"[{text}]({href})" if text and href else text

    def on_img(self, x: Element, as_is: bool) -> str:
        src = self.address(x, "src")
        return f"![{x.get('alt')}]({src})" if src else ""

    def items(self, x: Element, numbered: bool) -> str:
        lines, n = [], 1
        for li in (c for c in x.elements() if c.tag == "li"):
            if text := tidy(self.inside(li)):
                mark = f"{n}. " if numbered else "- "
                lines.append(mark + text.replace("\n", "\n" + " " * len(mark)))
                n += 1
        return "\n".join(lines)

    def on_ul(self, x: Element, as_is: bool) -> str:
        return f"\n\n{self.items(x, False)}\n\n"

    def on_ol(self, x: Element, as_is: bool) -> str:
        return f"\n\n{self.items(x, True)}\n\n"

    def on_blockquote(self, x: Element, as_is: bool) -> str:
        if self.quotes == QUOTES:
            return f"\n\n{self.inside(x, as_is)}\n\n"
        self.quotes += 1
        lines = tidy(self.inside(x, as_is)).split("\n")
        self.quotes -= 1
        return "\n\n" + "\n".join(f"> {t}" if t else ">" for t in lines) + "\n\n"

    def on_table(self, x: Element, as_is: bool) -> str:
        if self.tables == TABLES:
            return f"\n\n{self.inside(x, as_is)}\n\n"
        self.tables += 1
        rows = ([c for c in tr.elements() if c.tag in ("td", "th")] for tr in x.descendants() if tr.tag == "tr")
        table = pipe_table([[escape_cell(self.inline(c)) for c in r] for r in rows if r])
        self.tables -= 1
        return f"\n\n{table}\n\n" if table else ""


def element_markdown(e: Element, base: str = "") -> str:
    """Markdown of the element itself, so that a table stays one."""
    return tidy(Writer(base).node(e))


def page_markdown(page: str, base: str = "") -> tuple[str | None, str]:
    """Title and Markdown of a page's body."""
    doc: Document = parse(page)
    return doc.title() or None, tidy(Writer(base).inside(doc.body))
