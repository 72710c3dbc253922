"""Word documents: paragraphs, tables, text boxes, notes and images."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element

from quire.kernels.model import BLANK, BLANK_LINES, EMPTY_DOCUMENT, FILE_CORRUPTED, ConvertError, Info, Result, Section, escape_cell, pipe_table
from quire.kernels.package import Package, basename, folder, resolved

#: Media types by extension; note types that separate (fixed values).
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/emf", "wmf": "image/wmf"}
SEPARATORS = frozenset("separator continuationSeparator continuationNotice".split())
#: Relationship type's end, usual part, note element, root element, prefix of ids.
NOTES = (("/footnotes", "word/footnotes.xml", "w:footnote", "w:footnotes", "fn"), ("/endnotes", "word/endnotes.xml", "w:endnote", "w:endnotes", "en"))
MAIN = "word/document.xml"
#: The names of elements that are looked for, by their lower case (fixed values).
NAMES = {
    n.lower(): n
    for n in (
        "Relationship w:body w:p w:pPr w:pStyle w:numPr w:r w:rPr w:i w:b w:t w:tab w:br w:cr w:hyperlink w:footnoteReference w:endnoteReference w:drawing w:pict w:tbl w:tr w:tc w:gridSpan "
        "w:sdt w:sdtContent w:txbxContent w:footnotes w:footnote w:endnotes w:endnote a:blip v:imagedata wp:docPr pic:cNvPr mc:AlternateContent mc:Choice mc:Fallback"
    ).split()
}


def rels_of(part: str) -> str:
    at = folder(part)
    return f"{at}/_rels/{basename(part)}.rels" if at else f"_rels/{basename(part)}.rels"


def label(text: str) -> str:
    return text.replace("[", r"\[").replace("]", r"\]")


def destination(url: str) -> str:
    return f"<{url}>" if re.search("[ ()]", url) else url


def heading_level(style: str) -> int | None:
    style = style.lower()
    if style == "title":
        return 1
    digits = "".join(c for c in style.removeprefix("heading") if c.isdigit()) if style.startswith("heading") else ""
    return min(max(int(digits), 1), 6) if digits else None


def first(e: Element, name: str) -> Element | None:
    """The first element of the name, this one or below it."""
    return next(e.iter(name), None)


def own_text(e: Element) -> str:
    return (e.text or "") + "".join([c.tail or "" for c in e]) if len(e) else e.text or ""


def switched_on(style: Element, name: str) -> bool:
    e = first(style, name)
    return e is not None and e.get("w:val") not in ("false", "0", "none")


class Part:
    """One part of a document with the targets of its relationships."""

    def __init__(self, package: Package, path: str) -> None:
        self.path, self.root, rels = path, package.elements(path, NAMES), package.elements(rels_of(path), NAMES)
        found = list(rels.iter("Relationship")) if rels is not None else []
        self.types = [(r.get("Type", ""), r.get("Target")) for r in found if r.get("Target")]
        self.target = {r.get("Id"): r.get("Target") for r in found if r.get("Id") and r.get("Target")}

    # --- inline -------------------------------------------------------------------------

    def inline(self, e: Element) -> str:
        out = []
        for c in e:
            name = c.tag
            if name == "w:r":
                out.append(self.run(c))
            elif name == "w:hyperlink":
                inner, url = self.inline(c), self.target.get(c.get("r:id"))
                image_only = inner.startswith("![") and inner.endswith(")")
                out.append(f"[{label(inner)}]({destination(url)})" if url and inner and not image_only else inner)
            elif name != "w:pPr":
                out.append(self.inline(c))
        return "".join(out)

    def run(self, r: Element) -> str:
        style, mark = r[0] if len(r) and r[0].tag == "w:rPr" else first(r, "w:rPr"), ""
        if style is not None and len(style):
            mark = ("*" if switched_on(style, "w:i") else "") + ("**" if switched_on(style, "w:b") else "")
        out: list[str] = []
        text = ""
        for c in r:
            name = c.tag
            if name == "w:t":
                text += own_text(c)
            elif name == "w:tab":
                text += "\t"
            elif name in ("w:br", "w:cr"):
                text += "  \n"
            elif name in ("w:footnoteReference", "w:endnoteReference") and c.get("w:id"):
                text += f"[^{'fn' if name[2] == 'f' else 'en'}{c.get('w:id')}]"
            elif name in ("w:drawing", "w:pict"):
                out += [mark + text + mark[::-1] if text else "", self.image(c)]
                text = ""
        if text:
            out.append(mark + text + mark[::-1])
        return "".join(out)

    def image(self, drawing: Element) -> str:
        blip, vml = first(drawing, "a:blip"), first(drawing, "v:imagedata")
        rel = (blip.get("r:embed") if blip is not None else "") or (vml.get("r:id") if vml is not None else "")
        if not (target := self.target.get(rel)):
            return ""
        named = [e for tag in ("wp:docPr", "pic:cNvPr") if (e := first(drawing, tag)) is not None]
        alt = next((v for e in named for v in (e.get("descr"), e.get("name")) if v), "image")
        return f"![{label(alt)}]({destination(basename(target))})"

    # --- blocks -------------------------------------------------------------------------

    def blocks(self, e: Element) -> Iterator[str]:
        for c in e:
            name = c.tag
            block = ""
            if name == "w:p":
                block = self.paragraph(c)
            elif name == "w:tbl":
                block = self.table(c)
            elif name == "w:sdt" and (inner := first(c, "w:sdtContent")) is not None:
                yield from self.blocks(inner)
            if block:
                yield block

    def paragraph(self, p: Element) -> str:
        text = self.inline(p).strip(BLANK)
        style = first(p, "w:pStyle")
        if not text:
            return ""
        if level := heading_level(style.get("w:val", "") if style is not None else ""):
            return "#" * level + " " + text
        return "- " + text if first(p, "w:numPr") is not None else text

    def table(self, t: Element) -> str:
        rows = []
        for tr in (c for c in t if c.tag == "w:tr"):
            cells: list[str] = []
            for tc in (c for c in tr if c.tag == "w:tc"):
                boxed = {p for box in tc.iter("w:txbxContent") for p in box.iter("w:p")}
                lines = [s for p in tc.iter("w:p") if p not in boxed and (s := self.inline(p).strip(BLANK))]
                cells.append(re.sub(r"\r\n|\r|\n", "<br>", escape_cell("\n".join(lines))))
                span = first(tc, "w:gridSpan")
                wide = span.get("w:val", "") if span is not None else ""
                cells += [""] * (int(wide) - 1 if wide.isdigit() else 0)
            if cells:
                rows.append(cells)
        return pipe_table(rows)

    def text_boxes(self, body: Element) -> Iterator[str]:
        if boxes := list(body.iter("w:txbxContent")):
            hidden = self.hidden_boxes()
            for box in boxes:
                if box not in hidden:
                    yield from self.blocks(box)

    def hidden_boxes(self) -> set[Element]:
        """Of alternate contents, only the first choice that has a text box is shown, else the
        fallback; this holds at every level around a box."""
        hidden: set[Element] = set()
        for a in self.root.iter("mc:AlternateContent"):
            boxed = [c for c in a if first(c, "w:txbxContent") is not None]
            chosen = next((c for kind in ("mc:Choice", "mc:Fallback") for c in boxed if c.tag == kind), None)
            hidden.update(box for c in boxed if c is not chosen for box in c.iter("w:txbxContent"))
        return hidden

    def images(self, root: Element, package: Package) -> Iterator[Section]:
        for e in [*root.iter("a:blip"), *root.iter("v:imagedata")]:
            if not (target := self.target.get(e.get("r:embed") or e.get("r:id"))):
                continue
            at, name = resolved(target, folder(self.path)), basename(target)
            if data := package.read(at):
                kind = MEDIA.get(name.rpartition(".")[2].lower() if "." in name else "", "application/octet-stream")
                yield Section("image", f"![{name}]({name})", title=name, source_path=at, metadata={"mimeType": kind, "base64": base64.b64encode(data).decode()})


def note_part(package: Package, main: Part, suffix: str, usual: str) -> Part:
    target = next((t for kind, t in main.types if kind.endswith(suffix)), None)
    return Part(package, resolved(target, "word") if target else usual)


def convert_docx(data: bytes, info: Info) -> Result:
    package = Package(data)
    main = Part(package, MAIN)
    if main.root is None:
        raise ConvertError(FILE_CORRUPTED)
    body = first(main.root, "w:body")
    if body is None:
        raise ConvertError(EMPTY_DOCUMENT)
    markdown = "\n\n".join([*main.blocks(body), *main.text_boxes(body)]).strip(BLANK_LINES)
    notes: dict[str, str] = {}
    images = list(main.images(body, package))
    cited: list[str] = []
    for suffix, usual, tag, root_tag, prefix in NOTES:
        part = note_part(package, main, suffix, usual)
        cited += dict.fromkeys(prefix + r.get("w:id") for r in body.iter(f"{tag}Reference") if r.get("w:id"))
        if part.root is None:
            continue
        for n in part.root.iter(tag):
            text = " ".join(s for p in n.iter("w:p") if (s := part.inline(p).strip(BLANK)))
            if n.get("w:id") and text and n.get("w:type") not in SEPARATORS:
                notes[prefix + n.get("w:id")] = text
        if (root := first(part.root, root_tag)) is not None:
            images += part.images(root, package)
    defined = [f"[^{k}]: " + notes[k].replace("\n", "\n    ") for k in cited if k in notes]
    if defined:
        markdown = "\n\n".join(filter(None, [markdown, "\n".join(defined)]))
    sections = [Section("body", markdown)] if markdown else []
    sections += _first_of_each(images)
    if not sections:
        raise ConvertError(EMPTY_DOCUMENT)
    return Result(sections, title=info.filename)


def _first_of_each(images: list[Section]) -> list[Section]:
    seen: dict[str | None, Section] = {}
    for s in images:
        seen.setdefault(s.source_path, s)
    return list(seen.values())
