"""Clean-up of text: line ends, control and invisible characters, spaces, and composition."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What becomes a space and what is dropped, as ranges of a character class (fixed values).
#: ZWNJ and ZWJ stay, as scripts and emoji need them.
TO_SPACE = [(0x0B, 0x0C), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
DROPPED = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x61C, 0x61C), (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD)]
_TABLE = {c: " " for a, b in TO_SPACE for c in range(a, b + 1)} | {c: None for a, b in DROPPED for c in range(a, b + 1)}
_LINE_END = re.compile("\r\n?")


def sanitize_text(text: str) -> str:
    return unicodedata.normalize("NFC", _LINE_END.sub("\n", text).translate(_TABLE))


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@F.arrow_udf(T.StringType())
def _composed(column: pa.Array) -> pa.Array:
    return pa.array([None if s is None else unicodedata.normalize("NFC", s) for s in column.to_pylist()], pa.string())


def sanitize(c: Column) -> Column:
    """Cleaned text. Only text with characters from U+0300 on, which alone can need to be
    composed, goes through Python."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, _class(TO_SPACE), " "), _class(DROPPED), "")
    return F.coalesce(_composed(F.when(c.rlike(r"[\x{300}-\x{10FFFF}]"), c)), c)
