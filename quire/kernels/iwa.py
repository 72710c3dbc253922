"""Objects of iWork streams: envelopes of messages with references to each other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from quire.kernels.snappy import varint

#: Message types (fixed values of the format).
STORAGE, HYPERLINK, TILE, DATA_LIST, RICH_TEXT, SLIDE = 2001, 2032, 6002, 6005, 6218, 5
TABLE_MODELS = frozenset({6001, 6316})


@dataclass
class Object:
    id: int
    type: int
    payload: bytes
    references: list[int]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each varint (an int) and each length-delimited field (bytes); fixed
    values are passed over, and damage ends the message."""
    at, end = 0, len(data)
    while at < end:
        tag = data[at]  # numbers of one byte are read in place, as nearly all are
        at += 1
        if tag >= 0x80:
            if (long := varint(data, at - 1)) is None:
                return
            tag, at = long
        number, wire = tag >> 3, tag & 7
        if not number:
            return
        if wire in (1, 5):
            at += 8 if wire == 1 else 4
            if at > end:
                return
            continue
        if wire not in (0, 2) or at >= end:
            return
        value = data[at]
        at += 1
        if value >= 0x80:
            if (long := varint(data, at - 1)) is None:
                return
            value, at = long
        if wire == 0:
            yield number, value
        elif at + value <= end:
            yield number, data[at : at + value]
            at += value
        else:
            return


def numbers(data: bytes, field: int) -> Iterator[int]:
    return (v for n, v in fields(data) if n == field and isinstance(v, int))


def messages(data: bytes, field: int) -> Iterator[bytes]:
    return (v for n, v in fields(data) if n == field and isinstance(v, bytes))


def utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def reference(data: bytes) -> int | None:
    """The identifier in a reference message, which may be nested."""
    for n, v in fields(data):
        if n == 1:
            found = v if isinstance(v, int) else reference(v)
            if found is not None:
                return found
    return None


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while (v := varint(data, at)) is not None:
        out.append(v[0])
        at = v[1]
    return out


def objects(stream: bytes) -> list[Object]:
    """The objects of a stream, as far as it is sound."""
    out: list[Object] = []
    at = 0
    while (head := varint(stream, at)) is not None:
        size, at = head
        envelope = stream[at : at + size]
        if not size or len(envelope) < size:
            break
        at += size
        infos, own = [], 0
        for number, m in fields(envelope):
            if number == 1 and isinstance(m, int):
                own = m
            if number != 2 or isinstance(m, int):
                continue
            kind = length = None
            refs: list[int] = []
            for n, v in fields(m):
                if n == 5:
                    refs += [v] if isinstance(v, int) else packed(v)
                elif n == 1 and isinstance(v, int):
                    kind = v
                elif n == 3 and isinstance(v, int):
                    length = v
            if kind is not None and length is not None:
                infos.append((kind, length, refs))
        if not infos:
            break
        for kind, length, refs in infos:
            if at + length > len(stream):
                return out
            out.append(Object(own, kind, stream[at : at + length], refs))
            at += length
    return out


def graph(streams: Iterable[list[Object]]) -> dict[int, Object]:
    """All objects of streams by identifier; a later stream's replaces an earlier one's."""
    return {o.id: o for found in streams for o in found}


def body_text(storage: bytes) -> str | None:
    """The text of a storage; None for one that isn't body text (a kind other than 0)."""
    out = []
    for n, v in fields(storage):
        if n == 1 and isinstance(v, int) and v:
            return None
        if n == 3 and isinstance(v, bytes) and (s := utf8(v)) is not None:
            out.append(s)
    return "".join(out)


def stream_text(found: list[Object]) -> str:
    return "\n\n".join(t for o in found if o.type == STORAGE and (t := body_text(o.payload)))
