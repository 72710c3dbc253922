"""Small documents in each format, made from text and rows; queries and tests read them back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape, quoteattr

from quire.kernels.snappy import pack_stream

W = 'xmlns:w="urn:w" xmlns:r="urn:r" xmlns:a="urn:a" xmlns:wp="urn:wp" xmlns:pic="urn:pic" xmlns:v="urn:v" xmlns:mc="urn:mc"'
#: Characters that XML can't hold.
_NO_XML = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def xml_text(text: str) -> str:
    return escape(text.translate(_NO_XML)).replace("\r", "&#13;")


def zipped(members: dict[str, str | bytes], stored: bool = False) -> bytes:
    """A zip archive, written as zipfile does but in a fraction of its time; members are below
    4 GiB, and at most 65,535."""
    out, directory, at = [], [], 0
    for path, data in members.items():
        raw, name = data.encode() if isinstance(data, str) else data, path.encode()
        packed = raw
        if not stored:
            deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
            packed = deflate.compress(raw) + deflate.flush()
        # version, flags (names in UTF-8), method, time, day, CRC, sizes, length of name, extra
        head = struct.pack("<5H3L2H", 20, 0 if path.isascii() else 0x800, 0 if stored else 8, 0, 33, zlib.crc32(raw), len(packed), len(raw), len(name), 0)
        directory += [b"PK\1\2\x14\x03" + head + struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), name]
        out += [b"PK\3\4" + head, name, packed]
        at += 30 + len(name) + len(packed)
    tail = b"".join(directory)
    return b"".join(out) + tail + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(members), len(members), len(tail), at, 0)


def relationships(rows: list[tuple[str, str, str]]) -> str:
    return "<Relationships>" + "".join(f"<Relationship Id={quoteattr(i)} Type={quoteattr(k)} Target={quoteattr(t)}/>" for i, k, t in rows) + "</Relationships>"


def docx(body: str, rels: list[tuple[str, str, str]] = (), parts: dict[str, str | bytes] | None = None) -> bytes:
    """A Word document from the XML of its body."""
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": relationships(list(rels)), **(parts or {})})


def docx_paragraph(text: str, style: str = "") -> str:
    own = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
    return f'<w:p>{own}<w:r><w:t xml:space="preserve">{xml_text(text)}</w:t></w:r></w:p>'


def docx_of_lines(lines: list[str]) -> bytes:
    return docx("".join(map(docx_paragraph, lines)))


def xlsx(sheets: dict[str, Iterable[Sequence[str]]]) -> bytes:
    """A workbook whose cells are shared strings."""
    shared: dict[str, int] = {}
    parts: dict[str, str] = {}
    names, rels = [], []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        grid = "".join("<row>" + "".join(f'<c t="s"><v>{shared.setdefault(v, len(shared))}</v></c>' for v in r) + "</row>" for r in rows)
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{grid}</sheetData></worksheet>"
        names.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>')
        rels.append((f"rId{k}", "urn:x/worksheet", f"worksheets/sheet{k}.xml"))
    rels.append(("rIdS", "urn:x/sharedStrings", "sharedStrings.xml"))
    strings = "".join(f'<si><t xml:space="preserve">{xml_text(s)}</t></si>' for s in shared)
    return zipped(
        {
            "_rels/.rels": relationships([("rId1", "urn:x/officeDocument", "xl/workbook.xml")]),
            "xl/workbook.xml": f'<workbook xmlns:r="urn:r"><sheets>{"".join(names)}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relationships(rels),
            "xl/sharedStrings.xml": f"<sst>{strings}</sst>",
            **parts,
        }
    )


def epub(title: str, author: str, chapters: list[tuple[str, str]], cover: bytes | None = None) -> bytes:
    """A book from (title, body HTML) of its chapters."""
    items = "".join(f'<item id="c{k}" href="text/ch%20{k}.xhtml"/>' for k in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    if cover is not None:
        items += '<item id="cov" href="cover.png" properties="cover-image"/>'
    members: dict[str, str | bytes] = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "OEBPS/content.opf": f'<package xmlns:dc="urn:dc"><metadata><dc:title>{xml_text(title)}</dc:title><dc:creator>{xml_text(author)}</dc:creator></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>',
    }
    for k, (name, body) in enumerate(chapters):
        members[f"OEBPS/text/ch {k}.xhtml"] = f"<html><head><title>{xml_text(name)}</title></head><body>{body}</body></html>"
    if cover is not None:
        members["OEBPS/cover.png"] = cover
    return zipped(members)


def rtf(lines: list[str]) -> bytes:
    """Paragraphs with all but plain ASCII as Unicode escapes."""

    def one(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        if " " <= c <= "~":
            return c
        units = c.encode("utf-16-le")
        return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2))

    return ("{\\rtf1\\ansi " + "\\par\n".join("".join(map(one, x)) for x in lines) + "}").encode()


def pdf(pages: list[list[str]], title: str = "") -> bytes:
    """Pages of lines; characters that Windows-1252 lacks become question marks."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        show = b"".join(b"(" + x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td\n" for x in lines)
        data = zlib.compress(b"BT /F1 11 Tf 60 780 Td\n" + show + b"ET", 1)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    objects.append(b"<< /Title (" + title.encode("cp1252", "replace") + b") >>")
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % k + o + b"\nendobj\n" for k, o in enumerate(objects, 1))
    return body + b"trailer\n<< /Root 1 0 R /Info %d 0 R >>\n%%%%EOF\n" % len(objects)


# --- iWork ----------------------------------------------------------------------------------


def number(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out) + bytes((value,))


def varint_field(tag: int, value: int) -> bytes:
    return number(tag << 3) + number(value)


def bytes_field(tag: int, value: bytes) -> bytes:
    return number(tag << 3 | 2) + number(len(value)) + value


def reference_field(tag: int, who: int) -> bytes:
    return bytes_field(tag, varint_field(1, who))


def iwa_object(who: int, kind: int, payload: bytes, references: list[int] = (), info_first: bool = False) -> bytes:
    info = bytes_field(2, varint_field(1, kind) + varint_field(3, len(payload)) + (bytes_field(5, b"".join(map(number, references))) if references else b""))
    own = varint_field(1, who)
    envelope = info + own if info_first else own + info
    return number(len(envelope)) + envelope + payload


def run_table(tag: int, runs: list[tuple[int, int | None]]) -> bytes:
    return bytes_field(tag, b"".join(bytes_field(1, varint_field(1, at) + (reference_field(2, who) if who is not None else b"")) for at, who in runs))


def storage(text: str, kind: int | None = None, extra: bytes = b"") -> bytes:
    return (varint_field(1, kind) if kind is not None else b"") + bytes_field(3, text.encode("utf-8", "replace")) + extra


def style(name: str | None = None, parent: int | None = None, bold: bool | None = None, italic: bool | None = None) -> bytes:
    archive = (bytes_field(1, name.encode()) if name is not None else b"") + (reference_field(3, parent) if parent is not None else b"")
    traits = (varint_field(1, int(bold)) if bold is not None else b"") + (varint_field(2, int(italic)) if italic is not None else b"")
    return bytes_field(1, archive) + (bytes_field(11, traits) if traits else b"")


def iwork(streams: dict[str, bytes], nested: bool = False) -> bytes:
    """A package of unpacked streams by name."""
    members = {name: pack_stream(s) for name, s in streams.items()}
    return zipped({"Index.zip": zipped(members, stored=True)}, stored=True) if nested else zipped(members, stored=True)


def decimal_cell(value: int, exponent: int) -> bytes:
    biased = exponent + 6176
    magnitude = abs(value)
    raw = bytearray(magnitude.to_bytes(14, "little"))
    raw += bytes(((biased & 0x7F) << 1 | magnitude >> 112 & 1, biased >> 7 & 0x7F | (0x80 if value < 0 else 0)))
    return bytes(raw)


def table_objects(model: int, tile: int, texts: int, rows: list[list[bytes | None]], lists: list[str]) -> bytes:
    """A table model with its tile and a list of inline texts; cells are made by cell()."""
    packed = b""
    for r in rows:
        buffer, offsets = b"", b""
        for c in r:
            offsets += (len(buffer) if c is not None else 0xFFFF).to_bytes(2, "little")
            buffer += c or b""
        packed += bytes_field(5, bytes_field(6, buffer) + bytes_field(7, offsets))
    entries = b"".join(bytes_field(3, varint_field(1, k) + bytes_field(3, t.encode())) for k, t in enumerate(lists))
    return iwa_object(model, 6001, b"", [tile, texts]) + iwa_object(tile, 6002, packed) + iwa_object(texts, 6005, varint_field(1, 1) + entries)


def cell(kind: int, value: bytes) -> bytes:
    return bytes((5, kind)) + b"\0" * 10 + value


def pages_of_lines(lines: list[str]) -> bytes:
    return iwork({"Index/Document.iwa": iwa_object(1, 2001, storage("\n".join(lines), 0))})


def keynote_of_slides(slides: list[str]) -> bytes:
    """A deck whose document lists the slides in order; their files are named in reverse."""
    streams: dict[str, bytes] = {}
    for k, text in enumerate(slides):
        streams[f"Index/Slide{len(slides) - k}.iwa"] = iwa_object(100 + k, 5, b"") + iwa_object(5000 + k, 2001, storage(text, 0))
    nodes = b"".join(iwa_object(1000 + k, 4, b"", [100 + k]) for k in range(len(slides)))
    streams["Index/Document.iwa"] = nodes + iwa_object(1, 2, b"", [1000 + k for k in range(len(slides))])
    return iwork(streams)
