"""Raw Snappy blocks, and their framing in iWork streams."""

from __future__ import annotations

#: A block may claim this much at most.
LARGEST = 512 << 20


class Malformed(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int] | None:
    """An unsigned 64-bit varint and the place after it; None if it breaks off or is larger."""
    if at < len(data) and data[at] < 0x80:
        return data[at], at + 1
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            return (value, at + k + 1) if value < 1 << 64 else None
    return None


def unpack_block(data: bytes) -> bytes:
    """The bytes of one block, which must be as many as it says."""
    head = varint(data, 0)
    if head is None or head[0] > LARGEST:
        raise Malformed("length")
    size, at = head
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        kind = tag & 3
        if kind == 0:
            n = tag >> 2
            if n >= 60:
                extra = n - 59
                n = int.from_bytes(data[at : at + extra], "little")
                at += extra
            n += 1
            if at + n > len(data):
                raise Malformed("literal")
            out += data[at : at + n]
            at += n
        else:
            width = (1, 2, 4)[kind - 1]
            if at + width > len(data):
                raise Malformed("copy")
            back = int.from_bytes(data[at : at + width], "little")
            at += width
            n = 4 + (tag >> 2 & 7) if kind == 1 else 1 + (tag >> 2)
            if kind == 1:
                back |= tag >> 5 << 8
            if not 0 < back <= len(out):
                raise Malformed("offset")
            piece = out[len(out) - back :][:n]
            out += (piece * (-(-n // len(piece))))[:n]
        if len(out) > size:
            raise Malformed("size")
    if len(out) != size:
        raise Malformed("size")
    return bytes(out)


def unpack_stream(data: bytes) -> bytes:
    """The blocks of a stream: a zero byte, a length of three bytes, the block."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at + 1 : at + 4], "little")
        if at + 4 + n > len(data) or data[at]:
            raise Malformed("frame")
        out.append(unpack_block(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return b"".join(out)


def pack_block(data: bytes) -> bytes:
    """A block of literals only."""
    n, head = len(data), bytearray()
    while n >= 0x80:
        head.append(n & 0x7F | 0x80)
        n >>= 7
    head.append(n)
    for k in range(0, len(data), 1 << 16):
        part = data[k : k + (1 << 16)]
        m = len(part) - 1
        head += bytes((m << 2,)) if m < 60 else bytes((61 << 2,)) + m.to_bytes(2, "little")
        head += part
    return bytes(head)


def pack_stream(data: bytes) -> bytes:
    out = []
    for k in range(0, max(1, len(data)), 1 << 16):
        block = pack_block(data[k : k + (1 << 16)])
        out.append(b"\0" + len(block).to_bytes(3, "little") + block)
    return b"".join(out)
