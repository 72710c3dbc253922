"""Web pages: decoding, reader mode, else the whole body."""

from __future__ import annotations

import codecs
import re

from quire.kernels.html_dom import parse
from quire.kernels.html_markdown import element_markdown
from quire.kernels.model import DECODING_FAILED, EMPTY_DOCUMENT, ConvertError, Info, Result, Section, decode_strict
from quire.kernels.reader import Readable, article, readable

_CHARSET = re.compile(r"charset=[\"' ]*([^\W_](?:[\w.-]*)|[\w.-]+)")
#: A declared charset is looked for in this many bytes.
CHARSET_WINDOW = 2048


def known_charset(name: str) -> str | None:
    try:
        return codecs.lookup(name).name
    except (LookupError, ValueError):
        return None


def declared_charset(data: bytes) -> str | None:
    """The charset that a page's head declares, if it's known."""
    head = data[:CHARSET_WINDOW].decode("latin-1").lower()
    m = _CHARSET.search(head) if "charset=" in head else None
    return known_charset(m[1]) if m else None


def decode_page(data: bytes, charset: str | None = None) -> str | None:
    return decode_strict(data, charset or declared_charset(data))


def convert_html(data: bytes, info: Info) -> Result:
    page = decode_page(data, info.charset)
    if page is None:
        raise ConvertError(DECODING_FAILED)
    base = info.url or ""
    if info.reader_mode:
        doc = parse(page)
        if hit := article(doc):
            if markdown := element_markdown(hit[0], base):
                title = hit[1].title or doc.title() or None
                return Result([Section("body", markdown, title=title)], title=title, author=hit[1].byline)
    doc = parse(page)
    markdown = element_markdown(doc.body, base)
    if not markdown:
        raise ConvertError(EMPTY_DOCUMENT)
    title = doc.title() or None
    return Result([Section("body", markdown, title=title)], title=title)


def readable_bytes(data: bytes, response_charset: str | None = None) -> Readable:
    """Reader mode of bytes, which always decode: by the response's charset, the declared one,
    UTF-8, or Latin-1."""
    for name in (response_charset and known_charset(response_charset), declared_charset(data), "utf-8"):
        if name:
            try:
                return readable(data.decode(name))
            except UnicodeDecodeError:
                continue
    return readable(data.decode("latin-1"))
