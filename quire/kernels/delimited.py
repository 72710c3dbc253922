"""Plain text and comma-separated values."""

from __future__ import annotations

import re

from quire.kernels.model import DECODING_FAILED, EMPTY_DOCUMENT, ConvertError, Info, NotAccepted, Result, Section, decode_strict, flat_cell, is_blank, pipe_table

#: The next thing outside and inside quotes: what goes on plainly, then what doesn't.
_OUTSIDE = re.compile(r'([^",\r\n]*)("|,|\r\n|\r|\n|\Z)')
_INSIDE = re.compile(r'((?:[^"]|"")*)("|\Z)')


def convert_text(data: bytes, info: Info) -> Result:
    text = decode_strict(data, info.charset)
    if text is None:
        raise NotAccepted
    if is_blank(text):
        raise ConvertError(EMPTY_DOCUMENT)
    return Result([Section("body", text, title=info.filename)], title=info.filename)


def parse_csv(text: str) -> list[list[str]]:
    """Records of fields. A quote anywhere opens a quoted stretch, in which only a doubled
    quote is special; an empty line is a record of one empty field, and nothing follows the
    last line end."""
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    begun, at = False, 0
    while True:
        m = _OUTSIDE.match(text, at)
        begun = begun or bool(m[1])
        field.append(m[1])
        at, what = m.end(), m[2]
        if what == '"':
            m = _INSIDE.match(text, at)
            field.append(m[1].replace('""', '"'))
            begun, at = True, m.end()
            continue
        if not what and not begun and not row:
            return rows
        row.append("".join(field))
        field = []
        if what == ",":
            begun = True
            continue
        rows.append(row)
        row, begun = [], False
        if not what:
            return rows


def csv_field(value: str) -> str:
    """Quoted where a reader would else lose something, edge blanks included."""
    if any(c in value for c in ',"\n\r') or value.strip(" \t") != value:
        return '"' + value.replace('"', '""') + '"'
    return value


def serialize_csv(rows: list[list[str]]) -> str:
    return "\n".join(",".join(map(csv_field, r)) for r in rows)


def csv_table(rows: list[list[str]]) -> str:
    return pipe_table([[flat_cell(v) for v in r] for r in rows])


def convert_csv(data: bytes, info: Info) -> Result:
    text = decode_strict(data, info.charset)
    if text is None:
        raise ConvertError(DECODING_FAILED)
    rows = parse_csv(text)
    table = csv_table(rows)
    if not table:
        raise ConvertError(EMPTY_DOCUMENT)
    return Result([Section("table", table, title=info.filename, metadata={"csv": serialize_csv(rows)})], title=info.filename)
