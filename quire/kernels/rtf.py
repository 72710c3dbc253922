"""Rich text: control words, groups, code pages and emphasis as Markdown paragraphs."""

from __future__ import annotations

import codecs
import re

from quire.kernels.model import BLANK_LINES, DECODING_FAILED, EMPTY_DOCUMENT, FILE_CORRUPTED, ConvertError, Info, Result, Section, is_blank

#: Destinations without body text, and what words stand for (fixed values of the format).
IGNORED = frozenset(
    "fonttbl colortbl stylesheet info pict header footer headerl headerr headerf footerl footerr footerf footnote object themedata "
    "colorschememapping latentstyles datastore generator xmlnstbl listtable listoverridetable revtbl rsidtbl".split()
)
TEXT = {"line": "  \n", "tab": "\t", "cell": "\t", "emdash": "\u2014", "endash": "\u2013", "bullet": "\u2022", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d", "emspace": " ", "enspace": " ", "qmspace": " "}
BREAKS = frozenset("par row sect page".split())
CODE_PAGES = {932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1361: "johab", 10000: "mac_roman", 65001: "utf-8", 20127: "ascii", 28591: "latin-1", 28592: "iso8859-2", 20866: "koi8-r"}
DOUBLE_BYTE = frozenset({932, 936, 949, 950, 1361})
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_TOKEN = re.compile(
    rf"\\'(?P<hex>[0-9A-Fa-f]{{2}})|\\(?P<word>[{_LETTERS}]+)(?P<number>-?[0-9]*) ?|\\(?P<sign>\r\n|[^{_LETTERS}]|\Z)|(?P<brace>[{{}}])|(?P<line>\r\n|\r|\n)|(?P<text>[^\\{{}}\r\n]+)",
    re.S,
)
#: What counts as one character of the fallback after a Unicode escape.
_UNIT = re.compile(rf"\\'.{{0,2}}|\\[{_LETTERS}]+-?[0-9]* ?|\\(?:\r\n|.)?|\r\n|[^{{}}]", re.S)


def code_page(number: int) -> str | None:
    name = CODE_PAGES.get(number, f"cp{number}")
    try:
        return codecs.lookup(name).name if number > 0 else None
    except LookupError:
        return None


def one_byte(byte: int, page: str) -> str:
    for name in (page, "cp1252"):
        try:
            if s := bytes((byte,)).decode(name):
                return s
        except UnicodeDecodeError:
            continue
    return chr(byte)


def some_bytes(data: bytes, page: str) -> str:
    """Bytes as a whole, else pair by pair, else byte by byte."""
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (2, 1):
                try:
                    out.append(data[i : i + n].decode(page))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append(one_byte(data[i], page))
                i += 1
        return "".join(out)


def emphasized(text: str, bold: bool, italic: bool) -> str:
    """Marks hug the text; blanks stay outside of them."""
    core = text.strip(" \t")
    if not text.strip(" \t\n"):
        return text
    lead = text[: len(text) - len(text.lstrip(" \t"))]
    tail = text[len(text.rstrip(" \t")) :]
    mark = "**" * bold + "*" * italic
    return lead + mark + core + mark[::-1] + tail


class Reader:
    def __init__(self, source: str) -> None:
        self.source = source
        self.bold = self.italic = self.ignore = False
        self.fallback = 1
        self.groups: list[tuple[bool, bool, bool, int]] = []
        self.page, self.double = "cp1252", False
        self.high: int | None = None
        self.waiting = bytearray()
        self.runs: list[list] = []
        self.paragraphs: list[str] = []

    def put(self, text: str) -> None:
        if self.ignore or not text:
            return
        if self.runs and self.runs[-1][1:] == [self.bold, self.italic]:
            self.runs[-1][0] += text
        else:
            self.runs.append([text, self.bold, self.italic])

    def settle(self) -> None:
        if self.waiting:
            self.put(some_bytes(bytes(self.waiting), self.page))
            self.waiting.clear()

    def break_paragraph(self) -> None:
        text = "".join(emphasized(*r) for r in self.runs).strip(BLANK_LINES)
        self.runs = []
        if text:
            self.paragraphs.append(text)

    def unicode(self, value: int) -> None:
        value += 65536 if value < 0 else 0
        if 0xD800 <= value < 0xDC00:
            self.high = value
            return
        high, self.high = self.high, None
        if 0xDC00 <= value < 0xE000:
            if high is not None:
                self.put(chr(0x10000 + ((high - 0xD800) << 10) + value - 0xDC00))
        elif 0 <= value < 0x110000:
            self.put(chr(value))

    def skip(self, at: int, units: int) -> int:
        """Past so many fallback characters, but not out of the group."""
        for _ in range(units):
            m = _UNIT.match(self.source, at)
            if m is None:
                break
            at = m.end()
        return at

    def word(self, word: str, number: int | None, at: int) -> int:
        if word in BREAKS:
            if not self.ignore:
                self.break_paragraph()
        elif word in TEXT:
            self.put(TEXT[word])
        elif word == "plain":
            self.bold = self.italic = False
        elif word == "b":
            self.bold = number != 0
        elif word == "i":
            self.italic = number != 0
        elif word == "uc" and number is not None:
            self.fallback = max(0, number)
        elif word == "u":
            if number is not None:
                self.unicode(number)
            return self.skip(at, self.fallback)
        elif word == "bin" and number and number > 0:
            for _ in range(number):  # a CRLF counts as one
                at += 2 if self.source.startswith("\r\n", at) else 1
            return min(at, len(self.source))
        elif word == "ansicpg" and number is not None:
            if page := code_page(number):
                self.page, self.double = page, number in DOUBLE_BYTE
        elif word in IGNORED:
            self.ignore = True
        return at

    def sign(self, sign: str) -> None:
        if sign in ("\\", "{", "}"):
            self.put(sign)
        elif sign == "~":
            self.put("\u00a0")
        elif sign == "_":
            self.put("-")
        elif sign == "*":
            self.ignore = True
        elif sign in ("\n", "\r", "\r\n") and not self.ignore:
            self.break_paragraph()

    def read(self) -> str:
        at = 0
        while at < len(self.source):
            m = _TOKEN.match(self.source, at)
            at = m.end()
            kind = m.lastgroup
            if self.waiting and kind not in ("hex", "line"):
                self.settle()
            if kind == "hex":
                byte = int(m["hex"], 16)
                if not self.double:
                    self.put(one_byte(byte, self.page))
                elif not self.ignore:
                    self.waiting.append(byte)
            elif kind in ("word", "number"):
                digits = m["number"]
                at = self.word(m["word"], int(digits) if digits not in ("", "-") else None, at)
            elif kind == "sign":
                self.sign(m["sign"])
            elif kind == "brace":
                if m["brace"] == "{":
                    self.groups.append((self.bold, self.italic, self.ignore, self.fallback))
                elif self.groups:
                    self.bold, self.italic, self.ignore, self.fallback = self.groups.pop()
            elif kind == "text":
                self.put(m["text"])
        self.settle()
        self.break_paragraph()
        return "\n\n".join(self.paragraphs)


def convert_rtf(data: bytes, info: Info) -> Result:
    source = data.decode("latin-1")
    if not source:
        raise ConvertError(DECODING_FAILED)
    if not source.lstrip().startswith("{\\rtf"):
        raise ConvertError(FILE_CORRUPTED)
    markdown = Reader(source).read()
    if is_blank(markdown):
        raise ConvertError(EMPTY_DOCUMENT)
    return Result([Section("body", markdown, title=info.filename)], title=info.filename)
