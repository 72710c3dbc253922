"""Row schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT = T.StringType(), T.IntegerType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: What a source gives and detection reads. Only doc_key and content are needed; the other
#: columns are hints and may be missing or null.
INPUT = _row(doc_key=_TEXT, filename=_TEXT, mime_type=_TEXT, url=_TEXT, charset=_TEXT, content=T.BinaryType())
SECTION = _row(id=_TEXT, title=_TEXT, kind=_TEXT, markdown=_TEXT, source_path=_TEXT, page_start=_INT, page_end=_INT, sheet_name=_TEXT, slide_number=_INT, metadata=T.MapType(_TEXT, _TEXT))
CONVERTED = _row(title=_TEXT, author=_TEXT, cover=T.BinaryType(), sections=T.ArrayType(SECTION), status=_TEXT, error_code=_TEXT, error_message=_TEXT)
HINTS = ("filename", "mime_type", "url", "charset")
#: States of a document.
AWAITING, DOWNLOADED, PARSED, FAILED = "awaitingFetch", "downloaded", "parsed", "failed"
