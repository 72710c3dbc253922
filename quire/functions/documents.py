"""Parsers as column functions, and their registration for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.unicode import sanitize_text
from quire.kernels.delimited import parse_csv, serialize_csv
from quire.kernels.html_markdown import page_markdown
from quire.kernels.reader import Readable
from quire.kernels.reader import readable as read_one

_TEXT = T.StringType()
READABLE = T.StructType([T.StructField(n, T.LongType() if n == "length" else _TEXT) for n in Readable.__dataclass_fields__])
ROWS = T.ArrayType(T.ArrayType(_TEXT))


@F.arrow_udf(READABLE)
def _readable(column: pa.Array) -> pa.Array:
    found = [None if h is None else vars(read_one(h)) for h in column.to_pylist()]
    return pa.array(found, pa.struct([(f.name, pa.int64() if f.name == "length" else pa.string()) for f in READABLE.fields]))


@F.arrow_udf(_TEXT)
def _markdown(html: pa.Array, base: pa.Array) -> pa.Array:
    return pa.array([None if h is None else page_markdown(h, b or "")[1] for h, b in zip(html.to_pylist(), base.to_pylist())], pa.string())


@F.arrow_udf(ROWS)
def _csv_rows(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else parse_csv(t) for t in column.to_pylist()], pa.list_(pa.list_(pa.string())))


@F.arrow_udf(_TEXT)
def _csv_text(column: pa.Array) -> pa.Array:
    return pa.array([None if r is None else serialize_csv([[v or "" for v in own or ()] for own in r]) for r in column.to_pylist()], pa.string())


@F.arrow_udf(_TEXT)
def _clean(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else sanitize_text(t) for t in column.to_pylist()], pa.string())


def readable(html: Column) -> Column:
    """The reader-mode value of a page: title, content (HTML), text_content, length, excerpt,
    byline, dir, site_name, lang."""
    return _readable(html)


def html_markdown(html: Column, base: Column | None = None) -> Column:
    """A page's whole body as Markdown; ``base`` resolves relative links."""
    return _markdown(html, base if base is not None else F.lit(None).cast("string"))


def csv_rows(text: Column) -> Column:
    """The records of a CSV text as an array of arrays."""
    return _csv_rows(text)


def register(spark: SparkSession) -> list[str]:
    """Registers the parsers for SQL, and gives their names."""
    found = {"readable": _readable, "html_markdown": _markdown, "csv_rows": _csv_rows, "csv_text": _csv_text, "sanitize_unicode": _clean}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
