"""Inline marks of the Markdown subset: code spans, links, emphasis and note references."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

#: Code spans and links are held out of the text by these private-use characters.
CODE, CODE_END, LINK, LINK_END = "\ue000", "\ue001", "\ue002", "\ue003"
_CODE = re.compile(r"`([^`]*)`")
_LINK = re.compile(r"(!)?\[([^\]]*)\]\((?:<([^>]+)>|([^)]+))\)")
EMPHASIS = tuple((re.compile(p), tags) for p, tags in ((r"\*\*\*(.+?)\*\*\*", ("strong", "em")), (r"\*\*(.+?)\*\*", ("strong",)), (r"\*(.+?)\*", ("em",))))


@dataclass
class Link:
    label: str
    url: str
    image: bool


def escape_html(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(a, b)
    return text


def held(text: str) -> tuple[str, list[str], list[Link]]:
    """The text with its code spans and links held out."""
    codes: list[str] = []
    links: list[Link] = []

    def code(m: re.Match) -> str:
        codes.append(m[1])
        return f"{CODE}{len(codes) - 1}{CODE_END}"

    def link(m: re.Match) -> str:
        links.append(Link(m[2], m[3] if m[3] is not None else m[4], bool(m[1])))
        return f"{LINK}{len(links) - 1}{LINK_END}"

    return _LINK.sub(link, _CODE.sub(code, text)), codes, links


def emphasize(text: str, html: bool) -> str:
    for p, tags in EMPHASIS:
        opened = "".join(f"<{t}>" for t in tags) if html else ""
        closed = "".join(f"</{t}>" for t in reversed(tags)) if html else ""
        text = p.sub(lambda m, a=opened, b=closed: a + m[1] + b, text)
    return text


def references(text: str) -> list[str]:
    """The ids of notes that a text refers to, in order."""
    bare, at, out = held(text)[0], 0, []
    while (at := bare.find("[^", at)) >= 0 and (end := bare.find("]", at + 2)) >= 0:
        out.append(bare[at + 2 : end])
        at = end + 1
    return out


def _finished(text: str, numbers: dict[str, int], escape: Callable[[str], str], html: bool) -> str:
    bare, codes, links = held(text)
    out = emphasize(escape(bare), html)
    for key, n in sorted(numbers.items(), key=lambda x: x[1]):
        mark = f'<sup class="footnote-ref"><a href="#fn-{escape(key)}">{n}</a></sup>' if html else f"[{n}]"
        out = out.replace(f"[^{escape(key)}]", mark)
    for k, x in enumerate(links):
        if not html:
            shown = emphasize(x.label, False)
        elif x.image:
            shown = f'<img src="{escape(x.url)}" alt="{escape(x.label)}">'
        else:
            shown = f'<a href="{escape(x.url)}">{emphasize(escape(x.label), True)}</a>'
        out = out.replace(f"{LINK}{k}{LINK_END}", shown)
    for k, c in enumerate(codes):
        out = out.replace(f"{CODE}{k}{CODE_END}", f"<code>{escape(c)}</code>" if html else c)
    return out


def inline_html(text: str, numbers: dict[str, int] | None = None) -> str:
    return _finished(text, numbers or {}, escape_html, True)


def inline_plain(text: str, numbers: dict[str, int] | None = None) -> str:
    return _finished(text, numbers or {}, lambda s: s, False)
