"""Splits a page into text, tags and comments, in time that grows with its length only.

A tag that is closed before the next ``<`` is found by one expression that can't look further
than that. For others, where attribute values may hold ``<``, the next ``>`` outside of quotes
is looked for; what was learnt about an opening quote is kept, so that no part of the page is
walked twice however many tags are left open. A tag whose quotes never close ends at its first
``>``; one without any ``>`` is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TEXT, START, END = 0, 1, 2

_WHOLE = re.compile(r"""<([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_MARK = re.compile("[>\"']")
_COMMENT_END = re.compile("--!?>")


class Scanner:
    """The tokens of a page; raw_text() skips to an element's end tag."""

    def __init__(self, page: str, at: int = 0) -> None:
        self.page, self.at = page, at
        self._ends: dict[int, int] = {}  # of an opening quote: where its tag ends, or -1
        self._mark = (0, -1)  # the last search for > or a quote: from, and found at
        self._last = {c: page.rfind(c) for c in ("'", '"', ">")}

    def _next_mark(self, at: int) -> int:
        begin, found = self._mark
        if not begin <= at <= found:
            m = _MARK.search(self.page, at)
            found = m.start() if m else len(self.page)
            self._mark = (at, found)
        return found

    def _tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, quotes respected; -1 if there's none."""
        page, seen = self.page, []
        end = -1
        while True:
            k = self._next_mark(at)
            if k == len(page):
                break
            if page[k] == ">":
                end = k
                break
            if k in self._ends:
                end = self._ends[k]
                break
            seen.append(k)
            if k >= self._last[page[k]]:
                break
            at = page.find(page[k], k + 1) + 1
        for k in seen:
            self._ends[k] = end
        return end

    def _markup(self, lt: int) -> tuple[int, str, str] | None:
        """What stands at a ``<``: kind, name and attributes, with ``at`` after it; kind TEXT
        for what counts as nothing (comments and the like), None for a literal ``<``."""
        page = self.page
        m = _WHOLE.match(page, lt)
        if m:
            self.at = m.end()
            return START, m[1], m[2]
        c = page[lt + 1 : lt + 2]
        if c == "!" and page.startswith("<!--", lt):
            if page.startswith(">", lt + 4) or page.startswith("->", lt + 4):
                self.at = page.index(">", lt) + 1
            else:
                m = _COMMENT_END.search(page, lt + 4)
                self.at = m.end() if m else len(page)
            return TEXT, "", ""
        if lt > self._last[">"]:
            return None
        if c == "/" or c == "!" or c == "?":
            self.at = page.index(">", lt) + 1
            m = _NAME.match(page, lt + 2) if c == "/" else None
            return (END, m[0], "") if m else (TEXT, "", "")
        m = _NAME.match(page, lt + 1)
        if not m:
            return None
        end = self._tag_end(m.end())
        if end < 0:
            end = page.find(">", m.end())
        self.at = end + 1
        return START, m[0], page[m.end() : end]

    def __iter__(self) -> Iterator[tuple[int, str, str]]:
        """(TEXT, text, ''), (START, name, attributes) and (END, name, '') in page order."""
        page = self.page
        while True:
            begin = lt = self.at
            found = None
            while found is None:
                lt = page.find("<", lt)
                if lt < 0:
                    break
                found = self._markup(lt)
                lt += 1
            if found is None:
                self.at = len(page)
                if begin < len(page):
                    yield TEXT, page[begin:], ""
                return
            if lt - 1 > begin:
                yield TEXT, page[begin : lt - 1], ""
            if found[0] != TEXT:
                yield found

    def raw_text(self, tag: str) -> str:
        """The text up to the end tag of a raw element, which is passed."""
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(self.page, self.at, self._last[">"] + 1)
        text = self.page[self.at : m.start() if m else len(self.page)]
        self.at = m.end() if m else len(self.page)
        return text
