"""EPUB: chapters in the order of the spine."""

from __future__ import annotations

from quire.kernels.html_markdown import page_markdown
from quire.kernels.model import EMPTY_DOCUMENT, FILE_CORRUPTED, ConvertError, Info, Result, Section
from quire.kernels.package import Package, XmlNode, decode_part, folder, resolved


def first_text(opf: XmlNode, *names: str) -> str | None:
    for n in names:
        if (e := opf.first(n)) is not None:
            return e.text() or None
    return None


def cover_of(package: Package, opf: XmlNode, manifest: dict[str, str], base: str) -> bytes | None:
    href = next((i.get("href") for i in opf.all("item") if "cover-image" in i.get("properties")), None)
    if href is None:
        href = next((manifest.get(m.get("content")) for m in opf.all("meta") if m.get("name") == "cover"), None)
    return package.read(resolved(href, base, percent=True)) if href is not None else None


def convert_epub(data: bytes, info: Info) -> Result:
    package = Package(data)
    container = package.xml("META-INF/container.xml")
    root = container.first("rootfile") if container is not None else None
    path = root.get("full-path") if root is not None else ""
    opf = package.xml(path) if path else None
    if opf is None:
        raise ConvertError(FILE_CORRUPTED)
    base = folder(path)
    manifest = {i.get("id"): i.get("href") for i in opf.all("item") if i.get("id") and i.get("href")}
    sections = []
    for ref in opf.all("itemref"):
        href = manifest.get(ref.get("idref"))
        if href is None or ref.get("linear").lower() == "no":
            continue
        at = resolved(href, base, percent=True)
        chapter = package.read(at)
        if chapter is not None:
            title, markdown = page_markdown(decode_part(chapter))
            if markdown:
                sections.append(Section("chapter", markdown, title=title, source_path=at))
    if not sections:
        raise ConvertError(EMPTY_DOCUMENT)
    title = first_text(opf, "dc:title", "title") or info.filename
    return Result(sections, title, first_text(opf, "dc:creator", "creator"), cover_of(package, opf, manifest, base))
