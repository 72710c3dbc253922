"""Tables of iWork documents: tiles of packed cells with lists of texts."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable
from decimal import Decimal

from quire.kernels.iwa import DATA_LIST, RICH_TEXT, STORAGE, TABLE_MODELS, TILE, Object, fields, messages, numbers, reference, utf8
from quire.kernels.model import BLANK, escape_cell, pipe_table

#: Kinds of lists and cells (fixed values of the format).
INLINE_LIST, RICH_LIST = 1, 8
CELL_VERSION, NUMBER, INLINE, DATE, RICH, FORMULA = 5, 0x02, 0x03, 0x05, 0x09, 0x0A
ABSENT = 0xFFFF
_FOLDED = re.compile("\r\n|[\r\n\u2028\u2029\x0b\x0c]")
_DROPPED = re.compile("[\x00-\x08\x0a-\x1f\x7f-\x9f\ufffc]")
#: How far a slide's and an attachment's tables may be from it.
SLIDE_STEPS, ATTACHMENT_STEPS = 12, 5


def clean_cell(text: str) -> str:
    return escape_cell(_DROPPED.sub("", _FOLDED.sub(" ", text))).strip(BLANK)


def decimal_text(raw: bytes) -> str:
    """A 16-byte decimal: sign, exponent of 14 bits less 6176, and a whole coefficient."""
    if len(raw) < 16 or raw[15] >> 5 & 3 == 3:
        return ""
    exponent = ((raw[15] & 0x7F) << 7 | raw[14] >> 1) - 6176
    coefficient = int.from_bytes(raw[:14], "little") | (raw[14] & 1) << 112
    if not coefficient:
        return "0"
    digits = str(coefficient)
    sign = "-" if raw[15] & 0x80 else ""
    size = exponent + len(digits) - 1
    if -6 <= size < 21:
        text = f"{Decimal((0, tuple(map(int, digits)), exponent)):f}"
        return sign + (text.rstrip("0").rstrip(".") if "." in text else text)
    rest = digits[1:].rstrip("0")
    return f"{sign}{digits[0]}{'.' + rest if rest else ''}E{size}"


def iso_date(seconds: float) -> str:
    """The day of so many seconds after the start of 2001, in the proleptic calendar."""
    if not math.isfinite(seconds) or abs(seconds) >= 4e11:
        return ""
    days = math.floor(seconds / 86400) + 730_791  # since 1 March of the year 0
    # whole cycles of 400 years, then the year within; years begin in March
    cycle, day = divmod(days, 146_097)
    century = min(day // 36_524, 3)
    day -= century * 36_524
    leap, day = divmod(day, 1_461)
    single = min(day // 365, 3)
    day -= single * 365
    year = 400 * cycle + 100 * century + 4 * leap + single
    month = (5 * day + 2) // 153
    day -= (153 * month + 2) // 5
    year, month = (year, month + 3) if month < 10 else (year + 1, month - 9)
    return f"{str(year).rjust(4, '0')}-{month:02d}-{day + 1:02d}"


def rich_texts(data: bytes, by_id: dict[int, Object]) -> dict[int, str]:
    out = {}
    for entry in messages(data, 3):
        key, payload = None, None
        for n, v in fields(entry):
            if n == 1 and isinstance(v, int):
                key = v & 0xFFFFFFFF
            elif n == 9 and isinstance(v, bytes):
                payload = reference(v)
        rich = by_id.get(payload) if key is not None else None
        if rich is not None and rich.type == RICH_TEXT:
            storage = by_id.get(reference(rich.payload))
            if storage is not None and storage.type == STORAGE:
                out[key] = "".join(s for m in messages(storage.payload, 3) if (s := utf8(m)) is not None)
    return out


def inline_texts(data: bytes) -> dict[int, str]:
    out = {}
    for entry in messages(data, 3):
        key, text = None, None
        for n, v in fields(entry):
            if n == 1 and isinstance(v, int):
                key = v & 0xFFFFFFFF
            elif n == 3 and isinstance(v, bytes):
                text = utf8(v)
        if key is not None and text is not None:
            out[key] = text
    return out


def cell(buffer: bytes, at: int, rich: dict[int, str], inline: dict[int, str]) -> str:
    if at + 2 > len(buffer) or buffer[at] != CELL_VERSION:
        return ""
    kind, value = buffer[at + 1], buffer[at + 12 :]
    if kind in (RICH, INLINE) and len(value) >= 4:
        return clean_cell((rich if kind == RICH else inline).get(int.from_bytes(value[:4], "little"), ""))
    if kind == DATE and len(value) >= 8:
        return iso_date(struct.unpack_from("<d", value)[0])
    return decimal_text(value[:16]) if kind in (NUMBER, FORMULA) else ""


def row(data: bytes, rich: dict[int, str], inline: dict[int, str]) -> list[str | None]:
    buffer = offsets = b""
    for n, v in fields(data):
        if isinstance(v, bytes):
            buffer, offsets = (v if n == 6 else buffer), (v if n == 7 else offsets)
    places = struct.unpack(f"<{len(offsets) // 2}H", offsets[: len(offsets) // 2 * 2])
    cells = [None if p == ABSENT else cell(buffer, p, rich, inline) for p in places]
    while cells and cells[-1] is None:
        cells.pop()
    return cells


def grid_table(grid: list[list[str | None]]) -> str:
    rows = [[c or "" for c in r] for r in grid]
    return pipe_table(rows) if any(c for r in rows for c in r) else ""


def tables(by_id: dict[int, Object]) -> dict[int, str]:
    """Markdown by tile. Of several models of a tile the one of least identifier counts."""
    kind = {o.id: next(numbers(o.payload, 1), None) for o in by_id.values() if o.type == DATA_LIST}
    rich = {i: m for i, k in kind.items() if k == RICH_LIST and (m := rich_texts(by_id[i].payload, by_id))}
    inline = {i: m for i, k in kind.items() if k == INLINE_LIST and (m := inline_texts(by_id[i].payload))}
    out: dict[int, str] = {}
    for model in sorted((o for o in by_id.values() if o.type in TABLE_MODELS), key=lambda o: o.id):
        tile = next((r for r in model.references if r in by_id and by_id[r].type == TILE), None)
        if tile is None or tile in out:
            continue
        a = next((rich[r] for r in model.references if r in rich), {})
        b = next((inline[r] for r in model.references if r in inline), {})
        if table := grid_table([row(m, a, b) for m in messages(by_id[tile].payload, 5)]):
            out[tile] = table
    return out


def reachable(start: int, by_id: dict[int, Object], tiles: Iterable[int], steps: int, blocked: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """The tiles within so many references of an object, nearest first."""
    tiles, seen, edge = set(tiles), {start}, [start]
    found: dict[int, None] = {}
    for _ in range(steps):
        ahead = []
        for i in edge:
            for r in by_id[i].references if i in by_id else ():
                if r in blocked:
                    continue
                if r in tiles:
                    found.setdefault(r)
                if r not in seen:
                    seen.add(r)
                    ahead.append(r)
        edge = ahead
        if not edge:
            break
    return list(found)


def tables_by_slide(slides: list[int], by_id: dict[int, Object], blocked: set[int]) -> dict[int, list[str]]:
    """Each slide's tables; a tile belongs to the first slide that reaches it."""
    found = tables(by_id)
    claimed: set[int] = set()
    out: dict[int, list[str]] = {}
    for s in slides:
        for t in reachable(s, by_id, found, SLIDE_STEPS, blocked):
            if t not in claimed:
                claimed.add(t)
                out.setdefault(s, []).append(found[t])
    return out
