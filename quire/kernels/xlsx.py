"""Spreadsheets: a pipe table for each sheet with cells."""

from __future__ import annotations

from quire.kernels.model import EMPTY_DOCUMENT, FILE_CORRUPTED, ConvertError, Info, Result, Section, flat_cell, pipe_table
from quire.kernels.package import Package, XmlNode, each_of, folder, resolved


def rich_text(e: XmlNode) -> str:
    """The text of a shared or inline string, phonetic runs left out."""
    out = []
    for c in e.elements():
        if c.name == "t":
            out.append(c.own_text())
        elif c.name == "r":
            out += [t.own_text() for t in c.elements() if t.name == "t"]
    return "".join(out)


def relations(package: Package, part: str) -> list[XmlNode]:
    rels = package.xml(f"{folder(part)}/_rels/{part.rpartition('/')[2]}.rels".lstrip("/"))
    return list(rels.all("Relationship")) if rels is not None else []


def cell_text(cell: XmlNode, shared: list[str]) -> str:
    value = next((c.own_text() for c in cell.elements() if c.name == "v"), None)
    raw = value or ""
    if cell.get("t") == "s" and raw.isdigit() and int(raw) < len(shared):
        raw = shared[int(raw)]
    elif (inline := next((c for c in cell.elements() if c.name == "is"), None)) is not None:
        raw = rich_text(inline)
    return flat_cell(raw)


def convert_xlsx(data: bytes, info: Info) -> Result:
    package = Package(data)
    top = package.xml("_rels/.rels")
    books = [r.get("Target") for r in top.all("Relationship") if r.get("Type").endswith("/officeDocument")] if top is not None else []
    books = [resolved(b, "") for b in books] or ["xl/workbook.xml"]
    sections, names = [], []
    found = False
    for part in books:
        book = package.xml(part)
        if book is None:
            continue
        found = True
        rels = relations(package, part)
        target = {r.get("Id"): resolved(r.get("Target"), folder(part)) for r in rels}
        strings = next((target[r.get("Id")] for r in rels if r.get("Type").endswith("/sharedStrings")), f"{folder(part)}/sharedStrings.xml")
        table = package.read(strings)
        shared = each_of(table, "si", rich_text) if table is not None else []
        for sheet in book.all("sheet"):
            own = package.read(target.get(sheet.get("r:id"), ""))
            rows = each_of(own, "row", lambda r: [cell_text(c, shared) for c in r.elements() if c.name == "c"]) if own is not None else []
            grid = pipe_table(rows)
            if not grid:
                continue
            name = sheet.get("name") or None
            names += [name] if name else []
            sections.append(Section("sheet", (f"## {name}\n\n" if name else "") + grid + "\n", title=name, sheet_name=name))
    if not found:
        raise ConvertError(FILE_CORRUPTED)
    if not sections:
        raise ConvertError(EMPTY_DOCUMENT)
    return Result(sections, title=", ".join(names) or info.filename)
