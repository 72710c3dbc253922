"""Families of types by extension and by media type: a small fixed table in place of an
operating system's type database. A name that isn't here has no family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by family (fixed values).
EXTENSIONS = {
    "pdf": "pdf",
    "docx": "docx",
    "xlsx": "xlsx",
    "pptx": "pptx",
    "epub": "epub",
    "pages": "pages",
    "keynote": "key",
    "rtf": "rtf",
    "html": "html htm shtml xhtml xht",
    "csv": "csv",
    "json": "json",
    "xml": "xml xsl xslt plist rss atom",
    "text": "txt text md markdown log c h cc cpp hpp m mm swift java js mjs ts py rb pl php sh bash zsh css sql yaml yml toml ini s asm tsv eml",
    "image": "png jpg jpeg gif bmp tif tiff webp heic heif svg ico",
    "audio": "mp3 m4a wav aac aif aiff flac ogg",
    "zip": "zip",
    "doc": "doc",
    "rtfd": "rtfd",
    "webloc": "webloc",
}
#: Media types by family (fixed values).
MIMES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "epub": "application/epub+zip",
    "pages": "application/vnd.apple.pages application/x-iwork-pages-sffpages",
    "keynote": "application/vnd.apple.keynote application/x-iwork-keynote-sffkey",
    "rtf": "text/rtf application/rtf",
    "html": "text/html application/xhtml+xml",
    "csv": "text/csv text/comma-separated-values",
    "json": "application/json",
    "xml": "application/xml text/xml application/rss+xml application/atom+xml",
    "text": "text/plain text/markdown text/css text/javascript application/javascript application/x-sh message/rfc822 text/tab-separated-values",
    "image": "image/png image/jpeg image/gif image/bmp image/tiff image/webp image/heic image/heif image/svg+xml image/x-icon",
    "audio": "audio/mpeg audio/mp4 audio/wav audio/x-wav audio/aac audio/aiff audio/flac audio/ogg",
    "zip": "application/zip",
    "doc": "application/msword",
}
#: Families of which documents can be declared supported; images need a recogniser.
SUPPORTED = ("pdf", "docx", "xlsx", "epub", "pages", "keynote", "rtf", "rtfd", "html", "csv", "json", "xml", "text", "doc", "webloc", "folder")
#: Media types that say nothing, so that a file's own name counts.
GENERIC = ("application/octet-stream", "inode/directory", "application/x-directory")


def family(value: Column, table: dict[str, str]) -> Column:
    """The family of a lower-case extension or media type; null if there's none."""
    out: Column | None = None
    for name, members in table.items():
        hit = value.isin(members.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_supported(extension: Column, images: bool = False) -> Column:
    """Whether documents of an extension are declared supported; a folder has none."""
    known = family(F.lower(extension), EXTENSIONS)
    return F.coalesce(known.isin(*SUPPORTED, *(["image"] if images else [])), F.lit(False))
