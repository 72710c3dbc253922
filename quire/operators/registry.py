"""Which converter takes which document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from quire.kernels import delimited, docx, epub, html_page, iwork, ocr, pdf, rtf, xlsx
from quire.kernels.model import DOCUMENT_TYPE_NOT_SUPPORTED, ConvertError, Info, NotAccepted, Result

Kernel = Callable[[bytes, Info], Result]


@dataclass(frozen=True)
class Converter:
    """A kernel for some formats. It may raise NotAccepted, and the next one tries; any other
    error is the document's."""

    formats: frozenset[str]
    kernel: Kernel
    priority: int = 0

    def accepts(self, info: Info) -> bool:
        return info.format in self.formats


@dataclass(frozen=True)
class Registry:
    """Converters in ascending priority; of equal ones the earlier registered comes first."""

    converters: tuple[Converter, ...] = field(default=())

    def registering(self, converter: Converter) -> Registry:
        return replace(self, converters=tuple(sorted((*self.converters, converter), key=lambda c: c.priority)))

    def formats(self) -> list[str]:
        return sorted({f for c in self.converters for f in c.formats})

    def convert(self, data: bytes, info: Info) -> Result:
        for c in self.converters:
            if c.accepts(info):
                try:
                    return c.kernel(data, info)
                except NotAccepted:
                    continue
        raise ConvertError(DOCUMENT_TYPE_NOT_SUPPORTED, info.format)


def default_registry(engine: ocr.Engine | None = None, page_ocr: Callable[[bytes, int], str] | None = None) -> Registry:
    """All converters; images and pages without text need an OCR engine."""
    kernels: list[tuple[str, Kernel, int]] = [
        ("html", html_page.convert_html, 0),
        ("xlsx", xlsx.convert_xlsx, 0),
        ("epub", epub.convert_epub, 0),
        ("docx", docx.convert_docx, 0),
        ("rtf", rtf.convert_rtf, 0),
        ("csv", delimited.convert_csv, 0),
        ("pages", iwork.convert_pages, 0),
        ("keynote", iwork.convert_keynote, 0),
        ("pdf", lambda d, i: pdf.convert_pdf(d, i, page_ocr), 0),
        ("image", lambda d, i: ocr.convert_image(d, i, engine), 0),
        ("plainText json xml", delimited.convert_text, 10),
    ]
    out = Registry()
    for formats, kernel, priority in kernels:
        out = out.registering(Converter(frozenset(formats.split()), kernel, priority))
    return out
