"""Documents to sections: one Arrow-batched stage after detection, without a shuffle."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.unicode import sanitize_text
from quire.kernels.model import EMPTY_DOCUMENT, PARSING_ERROR, TOO_LARGE, ConvertError, Info, Result, Section, is_blank
from quire.operators.detect import classify
from quire.operators.registry import Registry, default_registry
from quire.plans.schema import CONVERTED, FAILED, PARSED

#: Files above this many bytes aren't read; they get an error instead.
LARGEST_FILE = 1 << 30
#: Bytes of an Arrow batch.
BATCH = 16 << 20


def sanitized(result: Result) -> Result:
    """The result with clean text; bytes that images carry stay as they are."""
    clean = lambda s: None if s is None else sanitize_text(s)
    for s in result.sections:
        s.markdown, s.title = clean(s.markdown), clean(s.title)
        if s.kind != "image":
            s.metadata = {k: clean(v) for k, v in s.metadata.items()}
    result.title, result.author = clean(result.title), clean(result.author)
    if is_blank(result.markdown()) and not any(s.kind == "image" for s in result.sections):
        raise ConvertError(EMPTY_DOCUMENT)
    return result


def section_row(key: str, ordinal: int, s: Section) -> dict:
    own = hashlib.sha256(f"{key}\0{ordinal}".encode("utf-8", "replace")).hexdigest()
    return {"id": own, "title": s.title, "kind": s.kind, "markdown": s.markdown, "source_path": s.source_path, "page_start": s.page_start, "page_end": s.page_end, "sheet_name": s.sheet_name, "slide_number": s.slide_number, "metadata": list(s.metadata.items())}


def convert_one(data: bytes, info: Info, registry: Registry, sanitize: bool = False) -> dict:
    """A document's output columns; whatever goes wrong is its error."""
    out = dict.fromkeys(CONVERTED.names) | {"sections": [], "status": FAILED}
    try:
        result = registry.convert(data, info)
        result = sanitized(result) if sanitize else result
    except ConvertError as e:
        return out | {"error_code": e.code, "error_message": str(e)}
    except (MemoryError, KeyboardInterrupt):
        raise
    except Exception as e:  # a parser's fault with one file must not end the job
        return out | {"error_code": PARSING_ERROR, "error_message": f"{type(e).__name__}: {e}"}
    sections = [section_row(info.key, k, s) for k, s in enumerate(result.sections)]
    return out | {"title": result.title, "author": result.author, "cover": result.cover, "sections": sections, "status": PARSED}


def safe(value: object) -> object:
    """Text without lone surrogates, which no column can hold."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode() if not value.isascii() else value
    if isinstance(value, list):
        return [safe(v) for v in value]
    if isinstance(value, tuple):
        return tuple(safe(v) for v in value)
    return {k: safe(v) for k, v in value.items()} if isinstance(value, dict) else value


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow holds them; text with lone surrogates, which it refuses, is made safe."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([safe(v) for v in values], kind)


def sections_column(lists: list[list[dict]], kind: pa.DataType) -> pa.Array:
    """Lists of section_row's rows, put together by columns."""
    flat = [s for own in lists for s in own]
    parts = []
    for f in kind.value_type:
        values = [s[f.name] for s in flat]
        if pa.types.is_map(f.type):
            pairs = [p for own in values for p in own]
            places = pa.array(itertools.accumulate(map(len, values), initial=0), pa.int32())
            parts.append(pa.MapArray.from_arrays(places, column([k for k, _ in pairs], f.type.key_type), column([v for _, v in pairs], f.type.item_type)))
        else:
            parts.append(column(values, f.type))
    places = pa.array(itertools.accumulate(map(len, lists), initial=0), pa.int32())
    return pa.ListArray.from_arrays(places, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)


def bounded_batches(spark: SparkSession, size: int = BATCH) -> None:
    """Keeps Arrow batches to about ``size`` bytes, unless the session has a bound of its own: a
    number of rows bounds no worker's memory where documents are of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(size))


def convert(df: DataFrame, registry: Registry | None = None, enhance_readability: bool = True, enable_ocr: bool = True, sanitize_unicode: bool = False, largest: int = LARGEST_FILE) -> DataFrame:
    """df (doc_key, content, hints) without content, with detection's and conversion's columns:
    title, author, cover, sections, status, error_code, error_message.

    Bytes of formats that no converter takes, and of files above ``largest``, stay out of
    Python. Columns of df with an output's name are replaced."""
    registry = registry or default_registry()
    bounded_batches(df.sparkSession)
    found = classify(df.drop("file_extension", "detected_format", "confidence", *CONVERTED.names))
    big = F.coalesce(F.octet_length("content") > largest, F.lit(False))
    takes = F.col("detected_format").isin(registry.formats()) & ~big
    found = found.withColumn("_big", big).withColumn("content", F.when(takes, F.col("content")))
    kept = [f for f in found.schema.fields if f.name not in ("content", "_big")]
    names = [f.name for f in kept]
    types = [to_arrow_type(f.dataType) for f in CONVERTED.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, k, size = [], 0, 0
            hints = zip(*(b.column(c).to_pylist() for c in ("doc_key", "filename", "file_extension", "mime_type", "url", "charset", "detected_format", "_big")))
            content = b.column("content")
            for j, (key, filename, extension, mime, url, charset, detected, too_big) in enumerate(hints):
                info = Info(filename, extension, mime, url, charset, detected, enhance_readability, enable_ocr, str(key))
                data = content[j].as_py()
                if too_big:
                    row = dict.fromkeys(CONVERTED.names) | {"sections": [], "status": FAILED, "error_code": TOO_LARGE}
                else:
                    row = convert_one(data or b"", info, registry, sanitize_unicode)
                rows.append(row)
                size += len(data or b"")
                if size > BATCH or j + 1 == len(b):
                    new = [(sections_column if c == "sections" else column)([r[c] for r in rows], t) for c, t in zip(CONVERTED.names, types)]
                    yield pa.RecordBatch.from_arrays([*b.slice(k, len(rows)).select(names).columns, *new], names=[*names, *CONVERTED.names])
                    k, rows, size = j + 1, [], 0

    return found.mapInArrow(run, T.StructType(kept + CONVERTED.fields))


def sections_of(df: DataFrame) -> DataFrame:
    """One row a section: doc_key, ordinal, and the section's fields."""
    return df.select("doc_key", F.posexplode("sections").alias("ordinal", "s")).select("doc_key", "ordinal", "s.*")


def markdown_of(sections: Column) -> Column:
    """The Markdown of a sections column: all but images, joined by blank lines."""
    shown = F.filter(sections, lambda s: s["kind"] != "image")
    return F.array_join(F.transform(shown, lambda s: s["markdown"]), "\n\n")


def section_texts(sections: Column) -> Column:
    """A string for each section that isn't an image."""
    return F.transform(F.filter(sections, lambda s: s["kind"] != "image"), lambda s: s["markdown"])
