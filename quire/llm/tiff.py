"""TIFF pages as rows: a writer and a reader.

The reader walks the image file directories of classic TIFF in either byte order, decodes
strips or tiles that are stored plain, by PackBits, LZW or deflate, in either fill order, undoes
the horizontal and the floating-point predictor, joins planes, and yields one page after
another. The writer makes such files (predictors 1 and 2).

LZW codes are read most significant bit first with early change. Offsets that lie outside the
file, loops of directories, and unknown compressions end in an error, which the DataFrame
operator reports in the row's ``error`` column; other rows go on. Defined results: null bytes
give one row with error 'no bytes' and null page fields; a directory without strips gives an
error too, as does a page of more than LARGEST_PAGE bytes, which no binary column holds; tiles'
padding is cut. Null and empty texts are stored as a page of spaces, long ones as tall pages;
rows that repeat, or have null keys, have pages of their own; an empty table gives no rows.
Columns of df with an output's name are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import bounded_batches

#: Tag numbers, field types' sizes and compression numbers of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
FILL_ORDER = 266
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: A page's samples may take this many bytes.
LARGEST_PAGE = 1 << 30


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


class TiffError(ValueError):
    pass


def packbits(data: bytes) -> bytes:
    """Runs of 3 or more equal bytes as repeats, the rest as literals; numpy finds the runs."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edge = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    size = np.diff(edge)
    long = np.flatnonzero(size >= 3)
    out, at = [], 0
    for k in long.tolist():
        begin, n = int(edge[k]), int(size[k])
        _literal(out, data, at, begin)
        while n:
            m = min(n, 128)
            out.append(bytes((257 - m, data[begin])) if m > 1 else bytes((0, data[begin])))
            n -= m
        at = int(edge[k + 1])
    _literal(out, data, at, len(data))
    return b"".join(out)


def _literal(out: list[bytes], data: bytes, at: int, end: int) -> None:
    while at < end:
        n = min(128, end - at)
        out.append(bytes((n - 1,)) + data[at : at + n])
        at += n


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, have = [], 0, 0
    while i < len(data) and have < size:
        n = data[i]
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            part = data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            part, i = b"", i + 1
        out.append(part)
        have += len(part)
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    codes, widths = [256], [9]
    table: dict[bytes, int] = {bytes((k,)): k for k in range(256)}
    fresh = dict(table)
    following, width = 258, 9
    at, n = 0, len(data)
    while at < n:
        end = at + 1
        code = data[at]
        while end < n:
            got = table.get(data[at : end + 1])
            if got is None:
                break
            code = got
            end += 1
        codes.append(code)
        widths.append(width)
        if end < n:
            table[data[at : end + 1]] = following
            following += 1
            if following == (1 << width) and width < 12:
                width += 1
            elif following >= 4094:
                codes.append(256)
                widths.append(width)
                table, following, width = dict(fresh), 258, 9
        at = end
    following += 1
    if following >= (1 << width) and width < 12:
        width += 1
    codes.append(257)
    widths.append(width)
    return _pack_codes(codes, widths)


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    shift = np.arange(11, -1, -1)
    bits = (c[:, None] >> shift & 1).astype(np.uint8)
    return np.packbits(bits[shift < w[:, None]]).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    if len(data) > 1 and data[0] == 0 and data[1] & 1:
        raise TiffError("LZW of the old bit order")
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table = base.copy()
    out: list[bytes] = []
    acc = bits = have = 0
    width, top, last = 9, 511, b""
    for byte in data:
        acc = acc << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code < 256 or code > 257:
            if last:
                if code < len(table):
                    entry = table[code]
                    table.append(last + entry[:1])
                elif code == len(table):
                    entry = last + last[:1]
                    table.append(entry)
                else:
                    raise TiffError("LZW code out of order")
                if len(table) >= top and width < 12:
                    width += 1
                    top = (1 << width) - 1
            elif code < 256:
                entry = base[code]
            else:
                raise TiffError("LZW code out of order")
            out.append(entry)
            have += len(entry)
            if have >= size:
                break
            last = entry
        elif code == 256:
            table, width, top, last = base.copy(), 9, 511, b""
        else:
            break
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, size))


ENCODE = {PLAIN: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: zlib.compress}


def decode(compression: int, data: bytes, size: int) -> bytes:
    try:
        if compression == PLAIN:
            return data
        if compression == PACKBITS:
            return unpackbits(data, size)
        if compression == LZW:
            return unlzw(data, size)
        if compression in (DEFLATE, OLD_DEFLATE):
            return inflate(data, size)
    except (zlib.error, IndexError) as e:
        raise TiffError(str(e)) from e
    raise TiffError(f"compression {compression}")


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes  # rows of pixels, samples together, little-endian


def fields_of(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """The fields of the directory at an offset, and the next directory's offset."""
    if at + 2 > len(raw):
        raise TiffError("directory outside the file")
    (n,) = struct.unpack_from(order + "H", raw, at)
    if at + 2 + 12 * n + 4 > len(raw):
        raise TiffError("directory outside the file")
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        if where + size > len(raw):
            raise TiffError(f"field {tag} outside the file")
        if kind in (1, 3, 4):
            out[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw, where)
    (following,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return out, following


def unpredicted(block: bytes, predictor: int, rows: int, wide: int, each: int, bits: int, order: str) -> np.ndarray:
    """Rows of bytes from those that a predictor left: differences of neighbouring samples (2),
    or of neighbouring bytes where a row's samples are stored by bytes, the highest first (3)."""
    if predictor == 2:
        kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "u4", 64: order + "u8"}[bits])
        samples = np.frombuffer(block, kind).astype(kind.newbyteorder("=")).reshape(rows, wide, each)
        return np.cumsum(samples, axis=1, dtype=samples.dtype).astype(kind).view(np.uint8).reshape(rows, -1)
    size = bits // 8
    summed = np.cumsum(np.frombuffer(block, np.uint8).reshape(rows, wide * size, each), axis=1, dtype=np.uint8)
    high_first = summed.reshape(rows, size, wide * each).transpose(0, 2, 1)
    return np.ascontiguousarray(high_first if order == ">" else high_first[:, :, ::-1]).reshape(rows, -1)


def page_of(raw: bytes, f: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default: f.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if not width or not height or len(set(f.get(BITS, (bits,)))) > 1:
        raise TiffError("no size, or samples of unlike size")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or predictor not in (1, 2, 3) or bits < 8 * min(predictor - 1, 2):
        raise TiffError(f"{bits} bits with predictor {predictor}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILE_OFFSETS in f
    tall, wide = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    offsets, counts = (f.get(TILE_OFFSETS, ()), f.get(TILE_COUNTS, ())) if tiled else (f.get(STRIP_OFFSETS, ()), f.get(STRIP_COUNTS, ()))
    if not tall or not wide or not offsets:
        raise TiffError("no strips or tiles")
    row_bytes = (wide * each * bits + 7) // 8
    page_row = (width * each * bits + 7) // 8
    if page_row * height * planes > LARGEST_PAGE:
        raise TiffError("page too large")
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("too few strips or tiles")
    reverse = one(FILL_ORDER, 1) == 2
    step = each * bits // 8 if bits >= 8 else 0
    out = np.zeros((planes, height, page_row), np.uint8)
    for k in range(across * down * planes):
        plane, within = divmod(k, across * down)
        y, x = divmod(within, across)
        rows = tall if tiled else min(tall, height - y * tall)
        if offsets[k] + counts[k] > len(raw):
            raise TiffError("strip or tile outside the file")
        size = rows * row_bytes
        stored = raw[offsets[k] : offsets[k] + counts[k]]
        if reverse:
            stored = _REVERSED[np.frombuffer(stored, np.uint8)].tobytes()
        block = decode(compression, stored, size)[:size]
        if len(block) < size:
            raise TiffError("strip or tile too short")
        flat = np.frombuffer(block, np.uint8).reshape(rows, row_bytes)
        if predictor > 1:
            flat = unpredicted(block, predictor, rows, wide, each, bits, order)
        top, left = y * tall, x * wide * step if step else x * row_bytes
        high, broad = min(rows, height - top), min(row_bytes, page_row - left)
        out[plane, top : top + high, left : left + broad] = flat[:high, :broad]
    if planes == 1:
        data = out.tobytes()
    elif bits >= 8:
        data = np.stack([p.reshape(height, width, bits // 8) for p in out], 2).tobytes()
    else:
        raise TiffError("planes of less than 8 bits")
    if bits > 8 and order == ">":
        data = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)[:, ::-1].tobytes()
    return Page(width, height, samples, bits, compression, predictor, tiled, data)


def pages(raw: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2], "")
    if not order or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories in a loop")
        seen.add(at)
        f, at = fields_of(raw, at, order)
        yield page_of(raw, f, order)


@dataclass(frozen=True)
class Layout:
    compression: int = DEFLATE
    predictor: int = 1
    tile: int = 0  # tiles of this many pixels a side (a multiple of 16), or strips
    rows: int = 256  # of a strip


def write_tiff(images: list[tuple[int, int, int, bytes, Layout]]) -> bytes:
    """A little-endian file of 8-bit images: (width, height, samples, data, layout) each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for width, height, samples, data, layout in images:
        a = np.frombuffer(data, np.uint8).reshape(height, width, samples)
        tall, wide = (layout.tile, layout.tile) if layout.tile else (min(layout.rows, height), width)
        offsets, counts = [], []
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                block = a[y : y + tall, x : x + wide]
                if layout.tile and block.shape[:2] != (tall, wide):
                    block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if layout.predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
                stored = ENCODE[layout.compression](block.tobytes())
                offsets.append(len(out))
                counts.append(len(stored))
                out += stored
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [layout.compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [layout.predictor])]
        fields += [(TILE_WIDTH, 3, [wide]), (TILE_HEIGHT, 3, [tall]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if layout.tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [tall]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                where, raw = len(out), out.extend(raw) or struct.pack("<I", len(out) - len(raw))
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


LAYOUTS = (Layout(DEFLATE, 2), Layout(PACKBITS, 1, tile=32), Layout(LZW, 1), Layout(DEFLATE, 1, tile=64), Layout(LZW, 1, tile=64), Layout(PACKBITS, 2, rows=64))


def text_to_tiff(text: str | None) -> bytes:
    """A text as a page of 64 RGB pixels a row: its UTF-8 bytes and spaces up to a positive
    multiple of 192. The payload's checksum chooses the layout."""
    data = (text or "").encode("utf-8", "replace")
    data += b" " * (-len(data) % 192 or (0 if data else 192))
    layout = LAYOUTS[zlib.crc32(data) % len(LAYOUTS)]
    return write_tiff([(64, len(data) // 192, 3, data, layout)])


def store_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the TIFF file that holds the text."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def stored(column: pa.Array) -> pa.Array:
        return pa.array(map(text_to_tiff, column.to_pylist()), pa.binary())

    return df.withColumn(media, stored(F.col(text)))


def page_feature(data: Column, width: Column, height: Column, samples: Column) -> Column:
    """Size, and each channel's mean and deviation, of an 8-bit page."""

    @F.arrow_udf("string")
    def feature(data: pa.Array, width: pa.Array, height: pa.Array, samples: pa.Array) -> pa.Array:
        out = []
        for d, w, h, s in zip(data, width.to_pylist(), height.to_pylist(), samples.to_pylist()):
            if d.is_valid and s and len(d.as_buffer()) == w * h * s:
                a = np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, s)
                each = " ".join(f"{m:.3f}/{v:.3f}" for m, v in zip(a.mean(0), a.std(0)))
                out.append(f"{w}x{h}x{s} {each}")
            else:
                out.append(None)
        return pa.array(out, pa.string())

    return feature(data, width, height, samples)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def read_pages(df: DataFrame, media: str = "media", keep_data: bool = True) -> DataFrame:
    """One row for each page of each file in df: df's columns without ``media`` (those with an
    output's name are replaced), and the page's fields. A file that can't be read on has its
    pages so far and a row with the error."""
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(PAGE_FIELDS)
    kept = [f for f in df.schema.fields if f.name != media and f.name not in added.names]
    names = [f.name for f in kept]
    types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source: list[int] = []
            size = 0

            def flush() -> pa.RecordBatch:
                own = batch.select(names).take(pa.array(source, pa.int64()))
                columns = list(zip(*rows)) if rows else [()] * len(types)
                return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*names, *added.names])

            for k in range(len(batch)):
                raw = batch.column(media)[k].as_py()
                n = 0
                try:
                    if raw is None:
                        raise TiffError("no bytes")
                    for p in pages(raw):
                        rows.append((n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data if keep_data else None, None))
                        source.append(k)
                        size += len(p.data)
                        n += 1
                except (TiffError, struct.error) as e:
                    rows.append((None,) * 9 + (str(e),))
                    source.append(k)
                if size > 4 << 20:
                    yield flush()
                    rows, source, size = [], [], 0
            if rows:
                yield flush()

    return df.mapInArrow(walk, T.StructType(kept + added.fields))
