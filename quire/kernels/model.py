"""What the parsers pass on: hints in, sections out, and errors as codes."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Error codes (fixed values).
DOCUMENT_TYPE_NOT_SUPPORTED = "documentTypeNotSupported"
PARSING_ERROR = "parsingError"
EMPTY_DOCUMENT = "emptyDocument"
NO_CONTENT = "noContent"
NO_ACCESS = "noAccess"
STALE = "stale"
INVALID_URL = "invalidURL"
UNABLE_TO_EXPORT = "unableToExportToRequestedFormat"
FILE_CORRUPTED = "fileCorrupted"
DECODING_FAILED = "decodingFailed"
TOO_LARGE = "tooLarge"

#: Formats that detection can name, and kinds of sections (fixed values).
FORMATS = "pdf docx xlsx pptx epub pages keynote html rtf plainText csv json xml zip image audio unknown".split()
KINDS = "body heading paragraph table list code image sheet slide chapter metadata".split()

#: A member of an archive may unpack to this many bytes.
LARGEST_MEMBER = 512 << 20
#: White space that trimming removes, without and with line ends.
BLANK = " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANK_LINES = BLANK + "\n\r\x0b\x0c\u0085\u2028\u2029"


class ConvertError(Exception):
    """A document that can't be converted, with its code."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


class NotAccepted(Exception):
    """The next converter shall try."""


@dataclass
class Info:
    """Hints on a document, and what detection made of it."""

    filename: str | None = None
    extension: str | None = None
    mime: str | None = None
    url: str | None = None
    charset: str | None = None
    format: str = "unknown"
    reader_mode: bool = True
    ocr: bool = True
    key: str = ""


@dataclass
class Section:
    kind: str
    markdown: str
    title: str | None = None
    source_path: str | None = None
    page_start: int | None = None
    page_end: int | None = None
    sheet_name: str | None = None
    slide_number: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Result:
    sections: list[Section]
    title: str | None = None
    author: str | None = None
    cover: bytes | None = None

    def markdown(self) -> str:
        return "\n\n".join(s.markdown for s in self.sections if s.kind != "image")


def is_blank(text: str) -> bool:
    return not text.strip(BLANK_LINES)


def escape_cell(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|")


def flat_cell(text: str, joint: str = " ") -> str:
    """A cell on one line, with its delimiters escaped."""
    one = escape_cell(text).replace("\r\n", joint).replace("\r", joint).replace("\n", joint)
    return one.strip(BLANK)


def pipe_table(rows: list[list[str]]) -> str:
    """A Markdown table of finished cells; the first row is the header, short rows are padded."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def decode_strict(data: bytes, charset: str | None) -> str | None:
    """Text by the charset, else by UTF-8; None where neither fits."""
    for name in dict.fromkeys([charset or "utf-8", "utf-8"]):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return None
