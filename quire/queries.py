"""The registered queries of the conversion engine, and DuckDB SQL for those that SQL can
express. Binary formats are made from the tables' own rows and read back, so that SQL over the
same rows gives what must come out. All queries run over whole tables and whole texts."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quire
from quire import fixtures
from quire.functions import text as X
from quire.kernels.ocr import ROW_HEIGHT
from quire.operators import relational

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as make and read documents side by side: a table holds
    a row in a few bytes, so that splits of its files by size leave millions of documents to
    one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def made(make: Callable[..., bytes], *columns: Column) -> Column:
    """Bytes made of each row's values."""

    @F.arrow_udf("binary")
    def out(*values: pa.Array) -> pa.Array:
        return pa.array([make(*v) for v in zip(*(x.to_pylist() for x in values))], pa.binary())

    return out(*columns)


def pages_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_key"), "url", F.col("html").cast("binary").alias("content"))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


# --- detection ------------------------------------------------------------------------------


@query("""
SELECT 'p' || page_id AS doc_key, 'html' AS detected_format, CAST(0.7 AS DOUBLE) AS confidence FROM pages
UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plainText' ELSE 'csv' END, CASE WHEN doc_id % 2 = 0 THEN 0.4 ELSE 0.5 END FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, CASE role WHEN 'user' THEN 'rtf' WHEN 'assistant' THEN 'pdf' ELSE 'unknown' END,
  CASE role WHEN 'user' THEN 0.95 WHEN 'assistant' THEN 1.0 ELSE 0.0 END FROM conversations""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("doc_key"), F.lit(None).cast("string").alias("filename"), F.col("html").cast("binary").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_key"), F.when(F.col("doc_id") % 2 == 1, "a.CSV").alias("filename"), F.col("text").cast("binary").alias("content"))
    mark = F.when(F.col("role") == "user", "{\\rtf1 ").when(F.col("role") == "assistant", "%PDF-1.7 ").otherwise("\0")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("doc_key"), F.lit("b.txt").alias("filename"), F.concat(mark, "text").cast("binary").alias("content"))
    return quire.classify(pages.unionByName(docs).unionByName(turns)).select("doc_key", "detected_format", "confidence")


@query("""
SELECT page_id, nullif(lower(regexp_extract(list_extract(string_split(regexp_replace(regexp_replace(p, '^[A-Za-z]+://[^/]*', ''), '/+$', ''), '/'), -1), '[^.]\\.([^./ ]+)$', 1)), '') AS ext
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)
UNION ALL SELECT -1 - p_partkey, lower(split_part(p_brand, '#', 2)) FROM part""")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", X.file_extension(F.lit(None).cast("string"), F.col("url")).alias("ext"))
    name = F.concat(F.lit("dir/File.tar.X"), F.split_part("p_brand", F.lit("#"), F.lit(2)))
    part = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("page_id"), F.replace(X.file_extension(name, F.lit(None).cast("string")), F.lit("x"), F.lit("")).alias("ext"))
    return pages.unionByName(part)


@query("""
SELECT n_nationkey, 'text/html' AS mime, CASE n_nationkey % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'windows-1252' WHEN 3 THEN 'shift_jis' END AS charset FROM nation""")
def mime_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, "UTF-8").when(k == 1, '"latin1"').when(k == 2, "cp1252").when(k == 3, "Shift_JIS").otherwise(F.col("n_name"))
    mime = F.concat(F.lit(" Text/HTML ; boundary=x; Charset="), name)
    return table(spark, sf_dir, "nation").select("n_nationkey", X.base_mime(mime).alias("mime"), X.mime_charset(mime).alias("charset"))


@query("SELECT page_id, 'utf-8' AS charset FROM pages")
def html_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_charset(F.col("html").cast("binary")).alias("charset"))


# --- text functions -------------------------------------------------------------------------

_INJECTED = "'e' || chr(769) || replace(replace(text, ' ', chr(160)), chr(10), chr(13) || chr(10)) || chr(8203) || chr(7) || chr(65279) || chr(8232) || 'x'"


@query(f"SELECT doc_id, nfc_normalize('e' || chr(769) || text || ' x') AS clean, length({_INJECTED}) AS n_before FROM documents")
def sanitize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit(" "), F.lit(" ")), F.lit("\n"), F.lit("\r\n"))
    t = F.concat(F.lit("é"), t, F.lit("​\u0007﻿ x"))
    return table(spark, sf_dir, "documents").select("doc_id", quire.sanitize(t).alias("clean"), F.char_length(t).cast("long").alias("n_before"))


@query("SELECT doc_id, nfc_normalize('e' || chr(769) || text || ' x') AS markdown FROM documents")
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with characters that are cleaned, converted with the clean-up switched on."""
    t = F.replace(F.replace("text", F.lit(" "), F.lit(chr(160))), F.lit("\n"), F.lit("\r\n"))
    t = F.concat(F.lit("e" + chr(769)), t, F.lit(chr(8203) + chr(7) + chr(65279) + chr(8232) + "x"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.lit("a.txt").alias("filename"), t.cast("binary").alias("content"))
    return converted_as(d, sanitize_unicode=True).select(F.col("doc_key").cast("long").alias("doc_id"), "markdown")


@query(r"SELECT doc_id, replace(replace(replace(text, 'e', '\|'), '\', '\\'), '|', '\|') AS escaped, replace(text, 'e', '\|') AS back FROM documents")
def escape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace("text", F.lit("e"), F.lit("\\|"))
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_cell(t).alias("escaped"), X.unescape_cell(X.escape_cell(t)).alias("back"))


@query("SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g') AS spaced, regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\\n{3,}', chr(10) || chr(10), 'g') AS gaps FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", X.collapse_spaces(F.col("text")).alias("spaced"), X.collapse_gaps(many).alias("gaps"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_html(F.col("text")).alias("escaped"))


@query("""SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS plain, '<strong>' || p_name || '</strong> <em>' || p_brand || '</em> <strong><em>' || p_type || '</em></strong>' AS html FROM part""")
def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("**"), "p_name", F.lit("** *"), "p_brand", F.lit("* ***"), "p_type", F.lit("***"))
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_emphasis(t).alias("plain"), X.emphasis_html(t).alias("html"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 BETWEEN 1 AND 6 THEN CAST(o_orderkey % 8 AS INTEGER) END AS level,
CASE o_custkey % 3 WHEN 0 THEN 'ordered' WHEN 1 THEN 'unordered' END AS list FROM orders""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat(F.repeat(F.lit("#"), (F.col("o_orderkey") % 8).cast("int")), F.lit(" "), "o_orderpriority")
    k = F.col("o_custkey") % 3
    item = F.when(k == 0, F.concat("o_orderkey", F.lit(". "), "o_orderpriority")).when(k == 1, F.concat(F.lit("- "), "o_orderpriority")).otherwise(F.concat(F.lit("-"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.heading_level(mark).alias("level"), X.list_kind(item).alias("list"))


@query("""SELECT o_orderkey, o_custkey % 2 = 0 AS separator FROM orders""")
def table_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit(" --- "), F.when(F.col("o_custkey") % 2 == 0, ":-:").otherwise(F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.is_separator(cells).alias("separator"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def iwork_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2001-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.iso_date(day * F.lit(86400.0) + 3600).alias("day"))


_LINES = "[trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10))]"
_TIDY = r"regexp_replace(regexp_replace(array_to_string([trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query(f"SELECT doc_id, {_TIDY} AS tidy FROM documents")
def tidy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("\n\t"), F.replace("text", F.lit("\n"), F.lit(" \u0001\r\n ".replace(" ", "\t"))), F.lit(" ￼"))
    return table(spark, sf_dir, "documents").select("doc_id", X.tidy_lines(t).alias("tidy"))


# --- CSV and tables -------------------------------------------------------------------------


@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, c_name || ', "' || c_mktsegment || '"' AS name, ' ' || c_mktsegment || chr(10) AS segment FROM customer""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each block of keys as one CSV text, read back record by record."""
    c = table(spark, sf_dir, "customer")
    row = F.array(F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')), F.concat(F.lit(" "), "c_mktsegment", F.lit("\n")))
    texts = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("block")).agg(F.collect_list(row).alias("rows")).select(X.csv_text(F.col("rows")).alias("csv"))

    return texts.select(F.explode(quire.csv_rows(F.col("csv"))).alias("r")).select(F.col("r")[0].alias("k"), F.col("r")[1].alias("name"), F.col("r")[2].alias("segment"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || ', ""x"" "' ELSE n_name END AS field, CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || ', ""x"" "' ELSE n_name END AS plain,
'" ' || n_name || '"' AS edged FROM nation""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(', "x" '))).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.csv_field(v).alias("field"), X.csv_field(v, edges=False).alias("plain"), X.csv_field(F.concat(F.lit(" "), "n_name")).alias("edged"))


@query("""SELECT r_name, '| key | name |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || n_nationkey || ' | ' || n_name || '\\| |', '' ORDER BY n_nationkey) AS md
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform(rows, lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(F.lit(" "), x["n_name"], F.lit("|\n")))))
    return n.groupBy("r_name").agg(X.pipe_table(grid).alias("md"))


# --- containers, read back ------------------------------------------------------------------


def converted(df: DataFrame) -> DataFrame:
    return quire.sections_of(quire.convert(df))


def converted_as(df: DataFrame, **options) -> DataFrame:
    return quire.sections_of(quire.convert(df, **options))


@query("""SELECT p_brand AS sheet, '## ' || p_brand || chr(10) || chr(10) || '| name | type |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || p_name || ' | ' || p_type || '\\| |', '' ORDER BY p_partkey) || chr(10) AS markdown
FROM part GROUP BY p_brand""")
def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a brand. The rows of a brand go to its task sorted, and no row holds a brand."""

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for brand, own in itertools.groupby(rows, lambda r: r[0]):
            book = fixtures.xlsx({brand: itertools.chain([("name", "type")], ((name, kind + "|") for _, name, kind in own))})
            yield pa.RecordBatch.from_arrays([pa.array([brand], pa.string()), pa.array([book], pa.binary())], names=["doc_key", "content"])

    part = spread(table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type", "p_partkey"), "p_brand").sortWithinPartitions("p_brand", "p_partkey", "p_name", "p_type")
    made_of = part.select("p_brand", "p_name", "p_type").mapInArrow(books, "doc_key string, content binary")
    return converted(made_of).select(F.col("sheet_name").alias("sheet"), "markdown")


_PARAGRAPHS = "array_to_string([trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10)) IF trim(x, ' ' || chr(9)) <> ''], chr(10) || chr(10))"


def documents_as(spark: SparkSession, sf_dir: str, make: Callable[[list[str]], bytes]) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_key"), made(make, lines_of(F.col("text"))).alias("content"))


@query(f"SELECT doc_id, {_PARAGRAPHS} AS markdown FROM documents WHERE {_PARAGRAPHS} <> ''")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(documents_as(spark, sf_dir, fixtures.docx_of_lines)).select(F.col("doc_key").cast("long").alias("doc_id"), "markdown")


@query(f"SELECT doc_id, {_PARAGRAPHS} AS markdown FROM documents WHERE {_PARAGRAPHS} <> ''")
def rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(documents_as(spark, sf_dir, fixtures.rtf)).select(F.col("doc_key").cast("long").alias("doc_id"), "markdown")


@query(f"SELECT doc_id, {_PARAGRAPHS} AS markdown FROM documents WHERE {_PARAGRAPHS} <> ''")
def iwork_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_as(spark, sf_dir, fixtures.pages_of_lines).withColumn("filename", F.lit("a.pages"))
    return converted(d).select(F.col("doc_key").cast("long").alias("doc_id"), "markdown")


@query("SELECT doc_id, array_to_string([trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10)) IF trim(x, ' ' || chr(9)) <> ''], chr(10)) AS markdown, 1 AS page FROM documents")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_as(spark, sf_dir, lambda lines: fixtures.pdf([lines]))
    return converted(d).select(F.col("doc_key").cast("long").alias("doc_id"), "markdown", F.col("page_start").alias("page"))


@query(f"SELECT doc_id, 'Document ' || doc_id AS title, '# ' || source || chr(10) || chr(10) || {_PARAGRAPHS} AS markdown FROM documents")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def book(doc: int, source: str, lines: list[str]) -> bytes:
        body = "".join(f"<p>{fixtures.xml_text(x)}</p>" for x in lines)
        return fixtures.epub(f"Book {doc}", "A. Author", [(f"Document {doc}", f"<h1>{source}</h1>{body}")])

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), made(book, F.col("doc_id"), F.col("source"), lines_of(F.col("text"))).alias("content"))
    return converted(d).select(F.col("doc_key").cast("long").alias("doc_id"), "title", "markdown")


@query(r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS slide,
regexp_replace(regexp_replace(array_to_string([trim(x, ' ' || chr(9)) FOR x IN string_split(text, chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS markdown FROM conversations""")
def keynote_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    decks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(slides.alias("slides"))
    deck = decks.select(F.col("conv_id").cast("string").alias("doc_key"), F.lit("deck.key").alias("filename"), made(fixtures.keynote_of_slides, F.col("slides")).alias("content"))
    return converted(deck).select(F.col("doc_key").cast("long").alias("conv_id"), F.col("slide_number").alias("slide"), "markdown")


@query("""SELECT s_suppkey, '| ' || s_name || ' | ' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) // 100 AS VARCHAR) || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 2001-01-' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || ' |  |' AS markdown FROM supplier""")
def iwork_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Pages document a supplier with a table of text, number and date cells."""
    import struct

    def document(name: str, whole: int, nation: int) -> bytes:
        rows = [[fixtures.cell(3, (0).to_bytes(4, "little")), fixtures.cell(2, fixtures.decimal_cell(whole * 10, -1))], [fixtures.cell(5, struct.pack("<d", nation * 86400.0 + 60)), None]]
        body = fixtures.iwa_object(1, 2001, fixtures.storage("￼", 0, fixtures.run_table(9, [(0, 30)]))) + fixtures.iwa_object(30, 2003, b"", [50])
        return fixtures.iwork({"Index/Document.iwa": body, "Index/Tables/T.iwa": fixtures.table_objects(50, 51, 52, rows, [name])})

    s = table(spark, sf_dir, "supplier")
    whole = F.expr("CAST(round(s_acctbal * 100) AS BIGINT) div 100")
    d = s.select(F.col("s_suppkey").cast("string").alias("doc_key"), F.lit("a.pages").alias("filename"), made(document, F.col("s_name"), whole, F.col("s_nationkey")).alias("content"))
    return converted(d).select(F.col("doc_key").cast("long").alias("s_suppkey"), "markdown")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS p, CAST(o_custkey AS VARCHAR) AS c FROM orders)
SELECT o_orderkey, 0 AS ordinal, 'body' AS kind, '### ' || p || chr(10) || chr(10) || 'Some **' || c || '** text' AS markdown FROM o
UNION ALL SELECT o_orderkey, 1, 'table', '| h\\| | ' || c || '.5 |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 2001-01-02 |  |  |' FROM o
UNION ALL SELECT o_orderkey, 2, 'body', 'after [link](<http://x/(' || c || ')>) end' FROM o""")
def pages_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inherited paragraph and character styles, links, an inline table and an empty
    attachment of a Pages document an order."""
    import struct

    fx = fixtures

    def document(title: str, customer: int) -> bytes:
        c = str(customer)
        bold = len(title) + 6
        first = bold + len(c) + 6
        link = first + 8
        text = f"{title}\nSome {c} text ￼\nafter link￼ end"
        runs = fx.run_table(5, [(0, 20), (len(title) + 1, 22)]) + fx.run_table(8, [(bold, 21), (bold + len(c), None)])
        runs += fx.run_table(9, [(first, 30), (link + 4, 31)]) + fx.run_table(11, [(link, 40), (link + 4, None)])
        body = fx.iwa_object(1, 2001, fx.storage(text, 0, runs)) + fx.iwa_object(2, 2001, fx.storage("header", 1))
        body += fx.iwa_object(20, 2025, fx.style(None, parent=23)) + fx.iwa_object(23, 2025, fx.style("Heading 2")) + fx.iwa_object(22, 2025, fx.style("Body"))
        body += fx.iwa_object(21, 2021, fx.style(None, parent=24, italic=False)) + fx.iwa_object(24, 2021, fx.style(None, None, True, True))
        body += fx.iwa_object(40, 2032, fx.bytes_field(2, f"http://x/({c})".encode())) + fx.iwa_object(30, 2003, b"", [50]) + fx.iwa_object(31, 2003, b"", [])
        rows = [[fx.cell(3, (0).to_bytes(4, "little")), fx.cell(2, fx.decimal_cell(customer * 10 + 5, -1)), None], [fx.cell(5, struct.pack("<d", 86400.0)), None, fx.cell(7, b"")]]
        return fx.iwork({"Index/Document.iwa": body, "Index/Tables/T.iwa": fx.table_objects(50, 51, 52, rows, ["h|"])}, nested=customer % 2 == 1)

    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    d = o.select(F.col("o_orderkey").cast("string").alias("doc_key"), F.lit("a.pages").alias("filename"), made(document, F.col("o_orderpriority"), F.col("o_custkey")).alias("content"))
    return converted(d).select(F.col("doc_key").cast("long").alias("o_orderkey"), "ordinal", "kind", "markdown")


@query("""SELECT c_custkey, 0 AS ordinal, 'slide' AS kind, 1 AS slide, 'a ' || c_name AS markdown FROM customer
UNION ALL SELECT c_custkey, 1, 'slide', 2, 'b ' || c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 2, 'table', 2, '| ' || c_custkey || ' | ' || c_nationkey || ' |' || chr(10) || '| --- | --- |' FROM customer""")
def keynote_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks without a list of slides, which go by their files' numbers; notes and masters are
    left out, a slide's table comes with it and a master's doesn't."""
    fx = fixtures

    def slide(who: int, text: str, refs: list[int]) -> bytes:
        return fx.iwa_object(who, 5, b"", refs) + fx.iwa_object(who + 500, 2001, fx.storage(text, 0)) + fx.iwa_object(who + 600, 2001, fx.storage("notes", 4))

    def deck(key: int, name: str, segment: str, nation: int) -> bytes:
        rows = [[fx.cell(3, (0).to_bytes(4, "little")), fx.cell(2, fx.decimal_cell(nation, 0))]]
        master = fx.iwa_object(90, 5, b"", [50]) + fx.iwa_object(91, 2001, fx.storage("master"))
        return fx.iwork({"Index/Slide-10.iwa": slide(10, f"b {segment}", [50]), "Index/Slide-2.iwa": slide(2, f"a {name}", [90]), "Index/MasterSlide-1.iwa": master, "Index/T.iwa": fx.table_objects(50, 51, 52, rows, [str(key)])})

    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    d = c.select(F.col("c_custkey").cast("string").alias("doc_key"), F.lit("a.key").alias("filename"), made(deck, F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("content"))
    return converted(d).select(F.col("doc_key").cast("long").alias("c_custkey"), "ordinal", "kind", F.col("slide_number").alias("slide"), "markdown")


@query("""SELECT o_orderkey, '# ' || o_orderpriority || chr(10) || chr(10) || '###### Sub' || chr(10) || chr(10) || '**' || o_custkey || '** and ***both***off' || chr(10) || chr(10) || '- item  ' || chr(10) || o_orderstatus || chr(10) || chr(10) ||
'| a\\|<br>b |  |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || o_orderkey || ' |' || chr(10) || chr(10) || '[li\\[n\\]k](<http://h/(' || o_custkey || ')>)' || chr(10) || chr(10) ||
'see[^fn2]![A dot](image1.png) end[^en5]' || chr(10) || chr(10) || 'boxed ' || o_custkey || chr(10) || chr(10) || '[^fn2]: note  ' || chr(10) || '    ' || o_custkey || chr(10) || '[^en5]: last' AS markdown,
'word/media/image1.png' AS image, 'image/png' AS mime, base64(encode('PNG' || o_orderkey)) AS data FROM orders""")
def docx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles, marks, list items, line breaks, merged cells, links, text boxes, foot- and
    endnotes and images of a document an order."""

    def run(text: str, props: str = "") -> str:
        return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{fixtures.xml_text(text)}</w:t></w:r>'

    p = fixtures.docx_paragraph
    # what all documents share is put together once
    sub, marks = p("Sub", "Heading9"), run(" and ") + run("both", "<w:b/><w:i/>") + run("off", '<w:b w:val="0"/>')
    merged, link = f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("a|")}{p("b")}</w:tc>', run("li[n]k")
    see = f'<w:p>{run("see")}<w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:drawing><wp:docPr descr="A dot"/><a:blip r:embed="i"/></w:drawing></w:r>{run(" end")}<w:r><w:endnoteReference w:id="5"/></w:r></w:p>'
    note = f'<w:footnotes {fixtures.W}><w:footnote w:id="0" w:type="separator"><w:p>{run("x")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("note")}<w:r><w:br/></w:r>'
    ends = f'<w:endnotes {fixtures.W}><w:endnote w:id="5"><w:p>{run("last")}</w:p></w:endnote></w:endnotes>'

    def document(key: int, customer: int, status: str, priority: str) -> bytes:
        bold = run(str(customer), "<w:b/>")
        body = f"{p(priority, 'Title')}{sub}<w:p>{bold}{marks}</w:p>"
        body += f"<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:br/><w:t>{status}</w:t></w:r></w:p>"
        body += f'<w:tbl><w:tr>{merged}</w:tr><w:tr><w:tc>{p("1")}</w:tc><w:tc>{p(str(key))}</w:tc></w:tr></w:tbl>'
        body += f'<w:p><w:hyperlink r:id="h">{link}</w:hyperlink></w:p>'
        box = f"<w:r><w:drawing><w:txbxContent>{p(f'boxed {customer}')}</w:txbxContent></w:drawing></w:r>"
        body += f"<w:p><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:p>{see}"
        notes = f"{note}{run(str(customer))}</w:p></w:footnote></w:footnotes>"
        rels = [("h", "x/hyperlink", f"http://h/({customer})"), ("i", "x/image", "media/image1.png")]
        return fixtures.docx(body, rels, {"word/footnotes.xml": notes, "word/endnotes.xml": ends, "word/media/image1.png": f"PNG{key}".encode()})

    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    d = o.select(F.col("o_orderkey").cast("string").alias("doc_key"), made(document, F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content"))
    out = quire.convert(d).withColumn("i", F.filter("sections", lambda x: x["kind"] == "image")[0])
    return out.select(F.col("doc_key").cast("long").alias("o_orderkey"), quire.markdown_of(F.col("sections")).alias("markdown"), F.col("i.source_path").alias("image"), F.col("i.metadata")["mimeType"].alias("mime"), F.col("i.metadata")["base64"].alias("data"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Order **' || o_custkey || '** x' || chr(10) || chr(10) || '*' || o_orderstatus || '*' WHEN 1 THEN chr(8217) || o_orderstatus || ' ' || chr(8220) || o_custkey || chr(8221) || ' ' || chr(8364) || '!'
WHEN 2 THEN 'a  ' || chr(10) || o_custkey || chr(9) || 'c' || chr(8212) || chr(160) || 'd-{}' ELSE chr(1055) || chr(1088) || ' ' || o_custkey || ' ' || chr(128512) END AS markdown FROM orders""")
def rtf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, escapes, special characters, code pages, surrogate pairs and destinations."""
    c, st = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    k = F.col("o_orderkey") % 4
    zero = joined(r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}{\footnote no\par}Order {\b ", c, r" }x\par\i ", st, r"\i0 }")
    one = joined("{\\rtf1 \\" + "u8217?", st, r" \'93", c, "\\'94 \\uc2\\" + "u8364ab!}")
    two = joined(r"{\rtf1 a\line ", c, r"\tab c\emdash\~d\_\{\}}")
    three = joined(r"{\rtf1\ansicpg1251 \'cf\'f0 ", c, r" \u-10179?\u-8704?}")
    text = F.when(k == 0, zero).when(k == 1, one).when(k == 2, two).otherwise(three)
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_key"), text.cast("binary").alias("content"))
    return converted(d).select(F.col("doc_key").cast("long").alias("o_orderkey"), "markdown")


@query("""SELECT 'c' || c_custkey AS doc_key, 'csv' AS format, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ', "' || c_mktsegment || '\\|" |' AS markdown FROM customer
UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'plainText' WHEN 1 THEN 'json' WHEN 2 THEN 'xml' ELSE 'plainText' END, CASE s_suppkey % 4 WHEN 1 THEN '{"name": "' || s_name || '"}' WHEN 2 THEN '<s>' || s_name || '</s>' ELSE s_name || ' ' || chr(233) END FROM supplier""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV, plain, JSON and XML texts by their hints, some in other charsets."""
    quoted = joined('key,name\r\n', F.col("c_custkey").cast("string"), ',"', F.col("c_name"), ', ""', F.col("c_mktsegment"), '|"""\r\n')
    null = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("doc_key"), F.lit("a.csv").alias("filename"), null.alias("mime_type"), null.alias("charset"), quoted.cast("binary").alias("content"))
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    plain = F.concat(name, F.lit(" é"))
    content = F.when(k == 0, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(plain, "UTF-16LE"))).when(k == 1, joined('{"name": "', name, '"}').cast("binary")).when(k == 2, joined("<s>", name, "</s>").cast("binary")).otherwise(F.encode(plain, "ISO-8859-1"))
    file = F.when(k == 1, "a.json").when(k == 2, "b.xml").when(k == 0, "c.txt")
    mime = F.when(k == 3, "text/plain; charset=latin1")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("doc_key"), file.alias("filename"), mime.alias("mime_type"), null.alias("charset"), content.alias("content"))
    out = quire.convert(c.unionByName(s))
    return out.select("doc_key", F.col("detected_format").alias("format"), quire.markdown_of(F.col("sections")).alias("markdown"))


# --- sections and rendering -----------------------------------------------------------------


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'system') AS markdown, CAST(count(*) FILTER (role <> 'system') AS INTEGER) AS parts FROM conversations GROUP BY conv_id""")
def section_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "image").otherwise("body").alias("kind")
    sections = F.array_sort(F.collect_list(F.struct("turn", kind, F.col("text").alias("markdown"))))
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sections.alias("sections"))
    text = F.when(F.exists("sections", lambda s: s["kind"] != "image"), quire.markdown_of(F.col("sections")))
    from quire.operators.convert import section_texts

    return own.select("conv_id", text.alias("markdown"), F.size(section_texts(F.col("sections"))).alias("parts"))


#: Text without Markdown's marks, on one line.
_PLAIN_SQL = r"'Text ' || trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}.,;:@&<>]', ' ', 'g'), ' +', ' ', 'g'))"


def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Text "), F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N}.,;:@&<>]", " "), " +", " ")))
    null = F.lit(None).cast("string")
    section = F.struct(null.alias("id"), F.col("source").alias("title"), F.lit("body").alias("kind"), t.alias("markdown"), null.alias("source_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), null.alias("sheet_name"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), null.alias("author"), F.array(section).alias("sections"))


_ESCAPED = f"replace(replace(replace({_PLAIN_SQL}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<document title="' || lang || '">' || chr(10) || '  <section kind="body" title="' || source || '">' || chr(10) || '    ' || {_ESCAPED} || chr(10) || '  </section>' || chr(10) || '</document>' AS output FROM documents""")
def render_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quire.render(plain_sections(spark, sf_dir), "xml").select("doc_id", "output")


@query(f"""SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || lang || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<p>' || {_ESCAPED} || '</p>' || chr(10) || '</body>' || chr(10) || '</html>' AS output FROM documents""")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quire.render(plain_sections(spark, sf_dir), "html").select("doc_id", "output")


@query(f"""SELECT doc_id, CASE WHEN contains({_PLAIN_SQL}, ',') THEN '"' || {_PLAIN_SQL} || '"' ELSE {_PLAIN_SQL} END AS output FROM documents""")
def render_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quire.render(plain_sections(spark, sf_dir), "csv").select("doc_id", "output")


@query(f"SELECT doc_id, {_PLAIN_SQL} AS output FROM documents")
def render_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quire.render(plain_sections(spark, sf_dir), "plaintext").select("doc_id", "output")


@query("""SELECT o_orderkey, o_orderpriority || chr(10) || chr(10) || 'See ' || o_orderstatus || '[1] and code' || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || 'a' || chr(9) || 'b' || chr(10) || chr(10) || '[1] note ' || o_custkey AS output FROM orders""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, emphasis, lists, tables, code spans and notes of Markdown made from orders."""
    md = F.concat(F.lit("# "), "o_orderpriority", F.lit("\n\nSee **"), "o_orderstatus", F.lit("**[^n] and `code`\n\n1. one\n1. two\n\n| a | b |\n| --- | --- |\n\n[^n]: note "), F.col("o_custkey").cast("string"))
    null = F.lit(None).cast("string")
    section = F.struct(null.alias("id"), null.alias("title"), F.lit("body").alias("kind"), md.alias("markdown"), null.alias("source_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), null.alias("sheet_name"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("map<string,string>").alias("metadata"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", null.alias("title"), null.alias("author"), F.array(section).alias("sections"))
    return quire.render(d, "plaintext").select("o_orderkey", "output")


def said(template: str, **columns: str) -> str:
    """SQL that fills a template; {name} stands for a column, line ends for themselves."""
    out = []
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            out.append(columns[part])
        elif part:
            out += [" || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in part.split("\n"))]
    return " || ".join(out)


def filled(template: str, **columns: Column) -> Column:
    """The same as a column."""
    return F.concat(*(columns[part] if k % 2 else F.lit(part) for k, part in enumerate(re.split(r"\{(\w+)\}", template))))


#: Every block and mark, with notes; and what the formats make of it.
_RICH = "# {p} <b>\n\nx[^b] **{c} *i* d** & `y*<` [l*m*](u&v) ![i](<a b>)\nsecond[^a] again[^b] gone[^x]\n\n1. a\n   more\n1. b\n\n- c\n\n| h | k |\n| --- | :-: |\n| {s} | p\\|,q |\n\n> q\n> r\n\n```\n<&\n```\n---\n\n[^a]: A [^d]\n[^b]: B {c}\n[^c]: C\n[^d]: D"
_RICH_HTML = """<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
<title>a &amp; b</title>
</head>
<body>
<h1>{p} &lt;b&gt;</h1>
<p>x<sup class="footnote-ref"><a href="#fn-b">1</a></sup> <strong>{c} <em>i</em> d</strong> &amp; <code>y*&lt;</code> <a href="u&amp;v">l<em>m</em></a> <img src="a b" alt="i"><br>
second<sup class="footnote-ref"><a href="#fn-a">2</a></sup> again<sup class="footnote-ref"><a href="#fn-b">1</a></sup> gone[^x]</p>
<ol>
<li>a more</li>
<li>b</li>
</ol>
<ul>
<li>c</li>
</ul>
<table>
<thead>
<tr><th>h</th><th>k</th></tr>
</thead>
<tbody>
<tr><td>{s}</td><td>p|,q</td></tr>
</tbody>
</table>
<blockquote>q<br>
r</blockquote>
<pre><code>&lt;&amp;</code></pre>
<hr>
<section class="footnotes">
<hr>
<ol>
<li id="fn-b">B {c}</li>
<li id="fn-a">A <sup class="footnote-ref"><a href="#fn-d">3</a></sup></li>
<li id="fn-d">D</li>
</ol>
</section>
</body>
</html>"""
_RICH_PLAIN = "{p} <b>\n\nx[1] {c} i d & y*< lm i\nsecond[2] again[1] gone[^x]\n\n1. a more\n2. b\n\n- c\n\nh\tk\n{s}\tp|,q\n\nq\nr\n\n<&\n\n---\n\n[1] B {c}\n[2] A [3]\n[3] D"
_RICH_CSV = '# {p} <b>\nx[^b] {c} i d & y*< lm i\nsecond[^a] again[^b] gone[^x]\n1. a\nmore\n1. b\n- c\nh,k\n{s},"p|,q"\n> q\n> r\n<&\n---\n[^a]: A [^d]\n[^b]: B {c}\n[^c]: C\n[^d]: D'
_RICH_XML = '<?xml version="1.0" encoding="UTF-8"?>\n<document title="a &amp; b" author="An &quot;author&quot;">\n  <section kind="body">\n    ' + _RICH.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") + "\n  </section>\n</document>"
_ORDER = {"p": "o_orderpriority", "c": "o_custkey", "s": "o_orderstatus"}


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS format, {said(t, **_ORDER)} AS output FROM orders" for f, t in (("markdown", _RICH), ("html", _RICH_HTML), ("plaintext", _RICH_PLAIN), ("csv", _RICH_CSV), ("xml", _RICH_XML))))
def render_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five formats of Markdown with every block, mark and note, for each order."""
    null = F.lit(None).cast("string")
    md = filled(_RICH, p=F.col("o_orderpriority"), c=F.col("o_custkey").cast("string"), s=F.col("o_orderstatus"))
    body = F.struct(null.alias("id"), null.alias("title"), F.lit("body").alias("kind"), md.alias("markdown"), null.alias("source_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), null.alias("sheet_name"), F.lit(None).cast("int").alias("slide_number"), F.lit(None).cast("map<string,string>").alias("metadata"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("a & b").alias("title"), F.lit('An "author"').alias("author"), F.array(body).alias("sections"))
    parts = [quire.render(d, f).select("o_orderkey", F.lit(f).alias("format"), "output") for f in ("markdown", "html", "plaintext", "csv", "xml")]
    return functools.reduce(DataFrame.unionByName, parts)


# --- web pages ------------------------------------------------------------------------------


@query(r"""SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("r", quire.readable(F.col("html"))).select("page_id", "r.title", "r.lang")


@query(r"""SELECT page_id, CAST(1.0 AS DOUBLE) AS density, len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a ')) AS links FROM pages""")
def nav_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.kernels.html_dom import parse
    from quire.kernels.reader import link_density

    @F.arrow_udf("struct<density:double,links:bigint>")
    def density(column: pa.Array) -> pa.Array:
        out = []
        for h in column.to_pylist():
            nav = next((e for e in parse(h or "").body.descendants() if e.tag == "nav"), None)
            if nav is None:
                out.append((None, 0))
                continue
            letters = "".join(x.text() for x in nav.descendants() if x.tag == "a")
            whole = "".join(nav.text().split())
            out.append((link_density(nav) * len(nav.text()) / max(1, len(whole)) if letters == whole else -1.0, sum(e.tag == "a" for e in nav.descendants())))
        return pa.StructArray.from_arrays([pa.array([None if d is None else round(d, 9) for d, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())], names=["density", "links"])

    return table(spark, sf_dir, "pages").withColumn("d", density("html")).select("page_id", "d.density", "d.links")


_UNESCAPED = "regexp_replace(s, '&amp$', '&')"
for _name, _char in [("quot", "'\"'"), ("middot", "chr(183)"), ("copy", "chr(169)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")]:
    _UNESCAPED = f"replace({_UNESCAPED}, '&{_name};', {_char})"
#: The blocks of the tables' pages: an advert, a heading, paragraphs in which a bold element is
#: begun but never ended, so that it goes on in all later blocks, three at most of earlier ones.
_BLOCKS = f"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*') AS site, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav,
  string_split_regex(replace(replace(replace(regexp_replace(html, '^.*?</nav>', '', 's'), '<h1>', '<p>' || chr(1)), '<div class="ad">', '<p>' || chr(2)), '<footer>', '<p>' || chr(2)), '<(/?p|/h1|/?div[^>]*|/?article|/?footer|/body|/html|!--[^>]*)>') AS g FROM pages),
b AS (SELECT page_id, site, title, nav, unnest(g) AS p, unnest(range(1, len(g) + 1)) AS k FROM a),
c AS (SELECT *, contains(p, '<b>') AS opens, coalesce(sum(contains(p, '<b>')::INT) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  trim(regexp_replace([{_UNESCAPED} FOR s IN [regexp_replace(regexp_replace(p, '^[\x01\x02]', ''), '<[^>]*>', '', 'g')]][1], '[ \t\r\n\f]+', ' ', 'g')) AS t FROM b),
d AS (SELECT *, repeat('**', CAST(least(before, 3) + opens::INT AS INTEGER)) AS mark, NOT starts_with(p, chr(2)) OR length(t) >= 25 AS own FROM c WHERE t <> ''),
e AS (SELECT *, CASE WHEN starts_with(p, chr(1)) THEN '# ' || t ELSE mark || t || mark END AS m, [trim({_UNESCAPED}) FOR s IN [title]][1] AS name,
  regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>') AS links FROM d),
f AS (SELECT page_id, any_value(name) AS title, any_value(links) AS links, any_value(site) AS site, string_agg(t, ' ' ORDER BY k) FILTER (own) AS own_text, string_agg(t, ' ' ORDER BY k) AS text,
  string_agg(m, chr(10) || chr(10) ORDER BY k) FILTER (own) AS own_md, string_agg(m, chr(10) || chr(10) ORDER BY k) AS md FROM e GROUP BY page_id),
g AS (SELECT *, length(own_text) >= 140 AS article, array_to_string(['- [' || regexp_extract(s, '>([^<]*)<', 1) || '](' || site || regexp_extract(s, '"([^"]*)"', 1) || ')' FOR s IN links], chr(10)) || chr(10) || chr(10) || md AS body,
  array_to_string([regexp_extract(s, '>([^<]*)<', 1) FOR s IN links], ' ') || ' ' || text AS body_text FROM f)"""


@query(f"{_BLOCKS} SELECT page_id, title, 'parsed' AS status, CASE WHEN article THEN own_md ELSE body END AS output FROM g")
def reader_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quire.export(pages_input(spark, sf_dir), "markdown")
    return out.select(F.col("doc_key").cast("long").alias("page_id"), "title", "status", "output")


@query(f"{_BLOCKS} SELECT page_id, title, 'parsed' AS status, body AS output FROM g")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quire.export(pages_input(spark, sf_dir), "markdown", enhance_readability=False)
    return out.select(F.col("doc_key").cast("long").alias("page_id"), "title", "status", "output")


@query(f"{_BLOCKS} SELECT page_id, title, length(CASE WHEN article THEN own_text ELSE body_text END) AS length, CASE WHEN article THEN own_text ELSE body_text END AS text FROM g")
def readable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "pages").withColumn("r", quire.readable(F.col("html")))
    return r.select("page_id", "r.title", F.col("r.length").cast("long").alias("length"), F.col("r.text_content").alias("text"))


def web_input(df: DataFrame, key: Column, page: Column, url: Column | None = None) -> DataFrame:
    return df.select(key.cast("string").alias("doc_key"), (F.lit(None).cast("string") if url is None else url).alias("url"), F.concat(F.lit("<html><head><title>T</title></head><body>"), page).cast("binary").alias("content"))


def joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


@query("""SELECT o_orderkey, '## ' || o_orderpriority || chr(10) || chr(10) || 'Total **' || o_custkey || '** and *' || o_orderstatus || '* in `x y`  ' || chr(10) || 'next [link ' || o_custkey || '](http://h.example/d/p/' || o_custkey || '?q#f) ![alt](http://h.example/d/i.png)' || chr(10) || chr(10) ||
'- one' || chr(10) || '- two' || chr(10) || '  ' || chr(10) || '  1. ' || o_custkey || chr(10) || '  2. last' || chr(10) || chr(10) || '> quoted ' || o_orderstatus || chr(10) || '>' || chr(10) || '> more' || chr(10) || chr(10) ||
'```' || chr(10) || 'a  b' || chr(10) || ' ' || o_custkey || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '| key | v\\|al |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' |  |' AS markdown FROM orders""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of headings, marks, links, images, nested lists, quotes, code and tables."""
    c, s = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    page = joined("<h2> ", F.col("o_orderpriority"), "\n</h2><script>no()</script><p>Total\n <strong>", c, "</strong> and <i> ", s, " </i> in <code>x  y</code><br>next <a href='p/", c, "?q#f'>link\t", c, "</a> <img alt=alt src=i.png><img src=''></p><b></b>")
    page = joined(page, "<ul><li>one<li>two<ol><li>", c, "</li><li></li><li>last</ol></ul><blockquote><p>quoted ", s, "</p><div>more</div></blockquote><pre><code>a  b\n ", c, "</code></pre><hr>")
    page = joined(page, "<table><thead><tr><th>key<th>v|al</thead><tr><td>", F.col("o_orderkey").cast("string"), "</table><h3> </h3>")
    d = web_input(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey"), F.col("o_orderkey"), page, F.lit("http://h.example/d/x.html"))
    return converted_as(d, enhance_readability=False).select(F.col("doc_key").cast("long").alias("o_orderkey"), "markdown")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Side note with more than enough characters ' || doc_id || chr(10) || chr(10) ELSE '' END || '# Heading' || CASE WHEN doc_id % 3 = 2 AND length(t) < 25 THEN '' ELSE chr(10) || chr(10) || t END || chr(10) || chr(10) || 'Second, part, of, it, with, commas, and, more, than, enough, text, to, be, kept, in, any, case, as, a, paragraph, of, one, hundred, and, forty, characters.' AS markdown,
 'Author ' || doc_id AS author FROM (SELECT doc_id, {_PLAIN_SQL} AS t FROM documents)""")
def reader_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all documents among what readers don't want: elements by tag and by name,
    links, short blocks; every third page has no article but for its body."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N}.,;:@&<>]", " "), " +", " "))
    k = F.col("doc_id").cast("string")
    noise = joined("<nav><p>Some, words, of, navigation, that, are, long, enough, ", k, "</p></nav><div class='sidebar-box'><p>A side bar of many, many, many, many, words, that, is, out</p></div><form><p>Search, for, anything, you, would, like, to, find</p></form>")
    links = "<div><a href=1>First other story</a> <a href=2>Second other story</a></div>"
    article = joined("<h1>Heading</h1><p>Text ", X.escape_html(text), "</p><p>Second, part, of, it, with, commas, and, more, than, enough, text, to, be, kept, in, any, case, as, a, paragraph, of, one, hundred, and, forty, characters.</p>")
    mode = F.col("doc_id") % 3
    page = F.when(mode == 2, joined(noise, "<p>Side note with more than enough characters ", k, "</p>", article)).otherwise(joined(noise, links, "<div class=", F.when(mode == 0, "post").otherwise("'comment content'"), ">", article, "</div><p>short</p><aside>", k, "</aside>"))
    head = joined("<meta name=author content='Author ", k, "'>")
    d = web_input(table(spark, sf_dir, "documents"), F.col("doc_id"), joined(head, page))
    return quire.convert(d).select(F.col("doc_key").cast("long").alias("doc_id"), quire.markdown_of(F.col("sections")).alias("markdown"), "author")


# --- states and relations -------------------------------------------------------------------


@query("""SELECT coalesce(code, 'none') AS code, status, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 1 THEN 'fileCorrupted' WHEN 2 THEN 'documentTypeNotSupported' WHEN 3 THEN 'emptyDocument' WHEN 4 THEN 'fileCorrupted' END AS code,
CASE WHEN doc_id % 6 IN (0, 5) THEN 'parsed' ELSE 'failed' END AS status FROM documents) GROUP BY 1, 2""")
def status_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    name = F.when(k == 1, "a.docx").when(k == 2, "a.bin").when(k == 4, "a.rtf").otherwise("a.txt")
    text = F.when(k == 3, " \n ").when(k == 2, F.concat(F.lit("\0"), "text")).otherwise(F.concat(F.lit("x"), "text"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), name.alias("filename"), text.cast("binary").alias("content"))
    out = quire.convert(d).select(F.coalesce("error_code", F.lit("none")).alias("code"), "status")
    return out.groupBy("code", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS deck, CAST(n_nationkey AS BIGINT) AS slide, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS INTEGER) AS slide_number FROM nation""")
def deck_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("deck"), F.col("n_nationkey").cast("long").alias("slide"), "n_name")
    place = F.row_number().over(Window.partitionBy("deck").orderBy(F.desc("n_name")))
    nodes = n.select("deck", (F.col("slide") + 1000).alias("source"), F.lit(0).alias("position"), F.col("slide").alias("target"))
    listed = n.select("deck", F.lit(9999).cast("long").alias("source"), place.alias("position"), (F.col("slide") + 1000).alias("target"))
    return relational.deck_order(nodes.unionByName(listed), n.select("deck", "slide"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS s, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS t FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 7) % 25 AS BIGINT) FROM nation),
w AS (SELECT CAST(r_regionkey AS BIGINT) AS root, CAST(r_regionkey AS BIGINT) AS node, 0 AS d FROM region UNION SELECT root, t, d + 1 FROM w JOIN e ON node = s WHERE d < 12)
SELECT root, node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY root, node""")
def tile_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.select(F.col("k").alias("source"), ((F.col("k") * 3 + 1) % 25).alias("target")).union(n.select("k", (F.col("k") + 7) % 25)).distinct()
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("root"))
    return relational.reachable(edges, roots, 12)


@query("""WITH r AS (SELECT user_id, epoch_us(ts) * 1024 + event_id % 1024 AS at, CASE WHEN value > 50 THEN 'high' END AS style FROM events WHERE event_id % 5 = 0)
SELECT e.event_id, r.style FROM (SELECT event_id, user_id, epoch_us(ts) * 1024 + event_id % 1024 AS at FROM events) e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.at >= r.at""")
def asof_style_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the style that the last style change of its user set; every fifth event
    is such a change, and some end a style."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1024 + F.col("event_id") % 1024
    events = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"), "value")
    runs = events.where("event_id % 5 = 0").select("user_id", "at", F.when(F.col("value") > 50, "high").alias("style"))
    return relational.asof_runs(events.drop("value"), runs, ["user_id"], "at", "style").select("event_id", "style")


@query("""SELECT l_orderkey, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY p, id) AS INTEGER) AS number FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS id, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)""")
def footnote_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("id"), F.col("l_linenumber").alias("position"))
    return relational.number_notes(refs, "l_orderkey")


@query("""SELECT l_orderkey, 'word/' || l_returnflag || '/' || l_linestatus || l_linenumber % 3 || '.png' AS source_path, l_linenumber FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linestatus, l_linenumber % 3) = 1""")
def unique_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("word/"), "l_returnflag", F.lit("/"), "l_linestatus", (F.col("l_linenumber") % 3).cast("string"), F.lit(".png"))
    images = table(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("source_path"), "l_linenumber")
    return relational.unique_names(images, "l_orderkey").select("l_orderkey", "source_path", "l_linenumber")


@query(f"""SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY floor(l_quantity / 50 / {ROW_HEIGHT}) DESC, l_extendedprice, l_linenumber) AS text FROM lineitem GROUP BY l_orderkey""")
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linenumber").alias("text"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") / 50).alias("y"), F.col("l_linenumber").alias("n"))
    return relational.reading_order(boxes, "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(sum(l_quantity) OVER w - l_quantity AS BIGINT) AS a, CAST(sum(l_quantity) OVER w AS BIGINT) AS b, l_shipdate FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
o AS (SELECT k, a, least(b, 60) - greatest(a, 30) AS part, n FROM r WHERE a < 60 AND b > 30)
SELECT o_orderkey AS k, arg_max('s' || n, part * 1000000 - a) AS style FROM orders LEFT JOIN o ON o_orderkey = k GROUP BY o_orderkey""")
def majority_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style that covers most of characters 30 to 60 of each order, whose lines are runs as
    long as their quantities."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("l_quantity").over(w).cast("long")
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (end - F.col("l_quantity").cast("long")).alias("start"), end.alias("end"), F.concat(F.lit("s"), "l_linenumber").alias("style"))
    paragraphs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(30).cast("long").alias("start"), F.lit(60).cast("long").alias("end"))
    return relational.majority_style(paragraphs, runs, "k").select("k", "style")
