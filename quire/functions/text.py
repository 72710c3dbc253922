"""String functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that trimming takes off, for a character class.
BLANKS = r" \t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
ENDS = BLANKS + r"\n\r\x0B\x0C\x{0085}\x{2028}\x{2029}"
#: Character sets by the names that media types give them.
CHARSETS = {
    "utf-8": "utf-8 utf8",
    "utf-16": "utf-16 utf16",
    "utf-16le": "utf-16le",
    "utf-16be": "utf-16be",
    "utf-32": "utf-32 utf32",
    "utf-32le": "utf-32le",
    "utf-32be": "utf-32be",
    "iso-8859-1": "iso-8859-1 latin1 latin-1 iso_8859-1",
    "iso-8859-2": "iso-8859-2 latin2",
    "iso-8859-15": "iso-8859-15 latin-9",
    "us-ascii": "us-ascii ascii",
    "windows-1252": "windows-1252 cp1252",
    "windows-1251": "windows-1251 cp1251",
    "windows-1250": "windows-1250 cp1250",
    "shift_jis": "shift_jis shift-jis sjis",
    "euc-jp": "euc-jp",
    "gb2312": "gb2312",
    "gbk": "gbk",
    "gb18030": "gb18030",
    "big5": "big5",
    "euc-kr": "euc-kr",
    "koi8-r": "koi8-r",
}
WIDE = ("utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be")


def trimmed(c: Column, blanks: str = BLANKS) -> Column:
    return F.regexp_replace(c, f"^[{blanks}]+|[{blanks}]+$", "")


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape_cell(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def flat_cell(c: Column) -> Column:
    """A table cell on one line."""
    return trimmed(F.regexp_replace(escape_cell(c), r"\r\n|\r|\n", " "))


def csv_field(c: Column, edges: bool = True) -> Column:
    """A field, quoted where it must be; edges: also where blanks stand at its ends."""
    plain = rf'[,"\n\r]{"|^[ \t]|[ \t]$" if edges else ""}'.replace("$", r"\z")
    return F.when(c.rlike(plain), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_text(rows: Column) -> Column:
    """Rows of fields (array of arrays) as CSV."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda v: csv_field(v)), ",")), "\n")


def pipe_table(rows: Column) -> Column:
    """A Markdown table of raw cells (array of arrays); the first row is the header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, lambda v: flat_cell(v)), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.coalesce(width, F.lit(0)) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n\f]+", " ")


def collapse_gaps(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_emphasis(c: Column) -> Column:
    for p in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*"):
        c = F.regexp_replace(c, p, "$1")
    return c


def emphasis_html(c: Column) -> Column:
    for p, r in ((r"\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"\*(.+?)\*", "<em>$1</em>")):
        c = F.regexp_replace(c, p, r)
    return c


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, else null."""
    mark = F.regexp_extract(line, "^(#{1,6}) ", 1)
    return F.nullif(F.char_length(mark), F.lit(0))


def list_kind(line: Column) -> Column:
    """ordered, unordered, or null."""
    return F.when(line.rlike("^[-*+] "), "unordered").when(line.rlike(r"^\p{N}+\. "), "ordered")


def is_separator(cells: Column) -> Column:
    """Whether a table row's cells are all dashes and colons."""
    return (F.size(cells) > 0) & F.forall(cells, lambda c: trimmed(c).rlike(r"^[-:]+\z"))


def file_extension(filename: Column, url: Column) -> Column:
    """The lower-case extension of a name, else of an address's path; null if neither has one."""

    def of(c: Column) -> Column:
        last = F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
        return F.nullif(F.lower(F.regexp_extract(last, r"[^.]\.([^./ ]+)$", 1)), F.lit(""))

    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.coalesce(of(filename), of(path))


def base_mime(mime: Column) -> Column:
    return F.lower(trimmed(F.split_part(mime, F.lit(";"), F.lit(1))))


def charset_name(name: Column) -> Column:
    """The usual name of a character set; null if it isn't known."""
    name, out = F.lower(name), None
    for usual, others in CHARSETS.items():
        hit = name.isin(others.split())
        out = F.when(hit, usual) if out is None else out.when(hit, usual)
    return out


def mime_charset(mime: Column) -> Column:
    """The character set that a media type's parameters name."""
    found = F.regexp_extract(mime, r"(?i);[ \t]*charset=[ \t\"']*([^;\"' \t]+)", 1)
    return charset_name(found)


def html_charset(content: Column) -> Column:
    """The character set that an HTML head declares within 2048 bytes."""
    head = F.lower(F.decode(F.substring(content, F.lit(1), F.lit(2048)), "ISO-8859-1"))
    return charset_name(F.regexp_extract(head, r"charset=[\"' ]*([\p{L}\p{N}_.-]+)", 1))


def tidy_lines(c: Column) -> Column:
    """Folded line ends, no control characters, trimmed lines, single gaps."""
    c = F.regexp_replace(c, r"\r\n|[\r\x{2028}\x{2029}\x0B\x0C]", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0E-\x1F\x7F-\x{9F}\x{FFFC}]", "")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+\z", "")
    return c


def iso_date(seconds: Column) -> Column:
    """The day of so many seconds after the start of 2001."""
    return F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
