"""Content types from bytes and hints. All but the search in the directory of zip archives is
built-in expressions; of archives only that directory is sent to Python, or windows of the two
ends where there's none."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import WIDE, base_mime, charset_name, file_extension, mime_charset
from quire.functions.types import EXTENSIONS, GENERIC, MIMES, family
from quire.plans.schema import HINTS

#: Windows of bytes that are looked at (fixed values).
SNIFF, BINARY_WINDOW, ZIP_WINDOW = 1024, 8192, 128 << 10
END_SIZE, END_COMMENT = 22, 65_535
#: What names an archive's kind, in this order (fixed values).
ZIP_KINDS = (("epub", (b"application/epub+zip", b"META-INF/container.xml")), ("docx", (b"word/document.xml",)), ("xlsx", (b"xl/workbook.xml",)), ("pptx", (b"ppt/presentation.xml",)))
IWORK_MARKS = (b".iwa", b"Index.zip", b"Metadata/DocumentIdentifier")
PLAIN_EXTENSIONS = ("md", "markdown", "txt", "text")


def zip_part(content: Column) -> Column:
    """The bytes of an archive that name its members: its directory, as the end record gives
    it, or else its first and last ZIP_WINDOW bytes."""
    size = F.octet_length(content)
    # as hexadecimal text, in which two characters are a byte, the last end record is found; one
    # without a comment, as nearly all are, ends the file, and nothing is searched
    last = F.substring(content, size - END_SIZE + 1, F.lit(END_SIZE))
    tail = F.hex(F.substring(content, F.greatest(size - END_SIZE - END_COMMENT + 1, F.lit(1)), F.lit(END_SIZE + END_COMMENT)))
    ended = (size >= END_SIZE) & (F.substring(last, F.lit(1), F.lit(4)) == F.lit(bytearray(b"PK\x05\x06")))
    found = F.when(ended, F.hex(last)).otherwise(F.regexp_extract(tail, r"(?s)^(?:..)*(504B0506(?:..){18})", 1))

    def number(record: Column, at: int) -> Column:
        digits = F.concat(*(F.substring(record, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0)))
        return F.coalesce(F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long"), F.lit(0))

    ends = F.when(size <= 2 * ZIP_WINDOW, content).otherwise(F.concat(F.substring(content, F.lit(1), F.lit(ZIP_WINDOW)), F.lit(bytearray(1)), F.substring(content, (size - ZIP_WINDOW + 1), F.lit(ZIP_WINDOW))))

    def part(place: Column) -> Column:
        length, offset = place["length"], place["offset"]
        whole = (length > 0) & (length != 0xFFFFFFFF) & (offset != 0xFFFFFFFF) & (offset + length <= size)
        return F.when(whole, F.substring(content, (offset + 1).cast("int"), length.cast("int"))).otherwise(ends)

    # bound by lambdas, so that the record is looked for once and not at each of its bytes
    places = F.transform(F.array(found), lambda r: F.struct(number(r, 12).alias("length"), number(r, 16).alias("offset")))
    return F.transform(places, part)[0]


def zip_kind(names: bytes) -> tuple[str, bool]:
    """An archive's kind, and whether it is laid out as an iWork package."""
    kind = next((k for k, marks in ZIP_KINDS if any(m in names for m in marks)), "zip")
    return kind, any(m in names for m in IWORK_MARKS)


@F.arrow_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("iwork", T.BooleanType())]))
def _zip_kind(column: pa.Array) -> pa.Array:
    found = [zip_kind(x) if x is not None else (None, None) for x in column.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_())], names=["kind", "iwork"])


def begins(content: Column, *marks: bytes) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | (F.substring(content, F.lit(1), F.lit(len(m))) == F.lit(bytearray(m)))
    return F.coalesce(out, F.lit(False))


def bom_charset(content: Column) -> Column:
    """utf-32 is tried before utf-16, whose mark it begins with."""
    return F.when(begins(content, b"\xff\xfe\0\0", b"\0\0\xfe\xff"), "utf-32").when(begins(content, b"\xff\xfe", b"\xfe\xff"), "utf-16").when(begins(content, b"\xef\xbb\xbf"), "utf-8")


def looks_binary(content: Column) -> Column:
    return F.coalesce(F.contains(F.substring(content, F.lit(1), F.lit(BINARY_WINDOW)), F.lit(bytearray(b"\0"))), F.lit(False))


def looks_html(content: Column) -> Column:
    """Whether an HTML mark stands among the first bytes; zero bytes of wide text are skipped."""
    head = F.make_valid_utf8(F.substring(content, F.lit(1), F.lit(SNIFF)).cast("string"))
    return F.lower(F.replace(head, F.lit("\0"), F.lit(""))).rlike("<!doctype html|<html|<head|<body")


def with_hints(df: DataFrame) -> DataFrame:
    """df with all hint columns, file_extension, type family, and charset by its usual name."""
    for h in HINTS:
        if h not in df.columns:
            df = df.withColumn(h, F.lit(None).cast("string"))
    mime = base_mime(F.col("mime_type"))
    mime = F.when(~mime.isin(*GENERIC), mime)
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif(F.regexp_extract(path, "([^/]+)/*$", 1), F.lit("")))
    df = df.withColumn("file_extension", file_extension(F.col("filename"), F.col("url"))).withColumn("filename", name)
    df = df.withColumn("type_family", F.coalesce(family(mime, MIMES), family(F.col("file_extension"), EXTENSIONS)))
    return df.withColumn("charset", F.coalesce(charset_name(F.col("charset")), mime_charset(F.col("mime_type"))))


def classify(df: DataFrame) -> DataFrame:
    """df (with content) and hints, detected_format and confidence."""
    df = with_hints(df)
    content, ext, kin = F.col("content"), F.col("file_extension"), F.col("type_family")
    df = df.withColumn("charset", F.coalesce("charset", bom_charset(content)))
    is_zip = begins(content, b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
    df = df.withColumn("_zip", _zip_kind(F.when(is_zip, zip_part(content))))
    mime = base_mime(F.col("mime_type"))
    iwork = F.when(kin.isin("pages", "keynote"), kin).when(ext == "pages", "pages").when(ext == "key", "keynote").when(mime.isin(MIMES["pages"].split()), "pages").when(mime.isin(MIMES["keynote"].split()), "keynote")
    document = F.when(kin.isin("pdf", "docx", "xlsx", "pptx", "epub"), kin).when(ext.isin("pdf", "docx", "xlsx", "pptx", "epub"), ext)
    by_name = F.when(ext == "rtf", "rtf").when(ext.isin("html", "htm", "xhtml"), "html").when(ext.isin("csv", "json", "xml"), ext).when(ext.isin(*PLAIN_EXTENSIONS), "plainText")
    text = F.coalesce(F.when(kin.isin("rtf", "html", "csv", "json"), kin), by_name, F.when(kin == "xml", "xml").when(kin == "text", "plainText"))
    keynote_by_mime = mime.isin(MIMES["keynote"].split()) & ~F.coalesce(ext == "key", F.lit(False))
    wide = F.coalesce(F.col("charset").isin(*WIDE), F.lit(False))
    sub = F.col("_zip.kind")

    def found(format: Column | str, confidence: float | Column) -> Column:
        return F.struct((F.lit(format) if isinstance(format, str) else format).alias("format"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    answer = (
        F.when(content.isNull(), found("unknown", 0.0))
        .when(begins(content, b"%PDF"), found("pdf", 1.0))
        .when((sub == "zip") & iwork.isNotNull(), found(iwork, F.when(F.col("_zip.iwork"), 0.95).otherwise(0.5)))
        .when((sub == "zip") & document.isNotNull(), found(document, 0.5))
        .when(sub.isNotNull(), found(sub, 0.9))
        .when(begins(content, b"{\\rtf"), found("rtf", 0.95))
        .when(kin.isin("image", "audio"), found(kin, 0.6))
        .when(iwork == "pages", found("pages", 0.4))
        .when(keynote_by_mime, found("keynote", 0.4))
        .when(document.isNotNull(), found(document, 0.4))
        .when(~wide & looks_binary(content), found("unknown", 0.0))
        .when(text.isNotNull(), found(text, 0.5))
        .when(looks_html(content), found("html", 0.7))
        .otherwise(found("plainText", 0.4))
    )
    df = df.withColumn("_found", answer)
    return df.withColumn("detected_format", F.col("_found.format")).withColumn("confidence", F.col("_found.confidence")).drop("_found", "_zip", "type_family")
