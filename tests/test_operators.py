"""DataFrame operators: detection, conversion, clean-up, sources, streams, relations."""

import glob
import os

import pytest

import quire
from quire import fixtures as fx
from quire.functions.unicode import sanitize, sanitize_text
from quire.kernels.model import ConvertError, Info, NotAccepted, Result, Section

INPUT = "doc_key string, filename string, mime_type string, url string, content binary"


def inputs(spark, rows):
    return spark.createDataFrame([(str(k), f, m, u, None if c is None else bytearray(c)) for k, (f, m, u, c) in enumerate(rows)], INPUT)


CASES = [
    ((None, None, None, b"%PDF-1.4"), ("pdf", 1.0)),
    (("a.docx", None, None, fx.docx_of_lines(["x"])), ("docx", 0.9)),
    (("a.bin", None, None, fx.xlsx({"S": [["x"]]})), ("xlsx", 0.9)),
    ((None, None, None, fx.epub("b", "a", [])), ("epub", 0.9)),
    ((None, None, None, fx.zipped({"ppt/presentation.xml": "x"})), ("pptx", 0.9)),
    ((None, None, None, fx.zipped({"word.txt": "x"})), ("zip", 0.9)),
    (("r.docx", None, None, b"PK\x03\x04 cut off"), ("docx", 0.5)),
    (("d.pages", None, None, fx.pages_of_lines(["x"])), ("pages", 0.95)),
    ((None, "application/vnd.apple.keynote", None, fx.keynote_of_slides(["x"])), ("keynote", 0.95)),
    (("k.key", None, None, fx.zipped({"a": "b"})), ("keynote", 0.5)),
    (("server.key", None, None, b"-----BEGIN PRIVATE KEY-----"), ("plainText", 0.4)),
    ((None, "application/vnd.apple.keynote", None, b"cut off"), ("keynote", 0.4)),
    (("server.key", "application/vnd.apple.keynote", None, b"-----BEGIN"), ("plainText", 0.4)),
    ((None, None, None, b"{\\rtf1 x}"), ("rtf", 0.95)),
    (("x.docx", None, None, b"prose"), ("docx", 0.4)),
    (("x.png", None, None, b"\x89PNG\0"), ("image", 0.6)),
    ((None, "audio/mpeg", None, b"ID3"), ("audio", 0.6)),
    (("x.txt", None, None, b"a\0b"), ("unknown", 0.0)),
    (("x.txt", None, None, "é".encode("utf-16")), ("plainText", 0.5)),
    ((None, "text/plain; charset=utf-16le", None, "<html>".encode("utf-16-le")), ("plainText", 0.5)),
    ((None, None, None, "<!DOCTYPE HTML><p>".encode("utf-16")), ("html", 0.7)),
    (("x.csv", "text/plain", None, b"<html>,b"), ("csv", 0.5)),
    ((None, None, "http://h/a/p.XHTML?x=1", b"x"), ("html", 0.5)),
    ((None, "application/json", None, b"{}"), ("json", 0.5)),
    (("feed", "application/rss+xml", None, b"<rss/>"), ("xml", 0.5)),
    ((None, None, None, b"\n <HTML><body>"), ("html", 0.7)),
    ((None, None, None, b"just prose"), ("plainText", 0.4)),
    ((None, None, None, b""), ("plainText", 0.4)),
]


def test_detection(spark):
    out = quire.classify(inputs(spark, [c for c, _ in CASES])).collect()
    got = {int(r.doc_key): (r.detected_format, r.confidence) for r in out}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_detection_sends_no_more_than_archives_to_python(spark):
    plan = quire.classify(inputs(spark, [CASES[0][0]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_conversion_is_one_python_stage_without_shuffle(spark):
    plan = quire.convert(inputs(spark, [CASES[0][0]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_hints(spark):
    rows = [("A.Tar.GZ", "Text/HTML; Charset=\"latin1\"", None, b"x"), (None, None, "https://h.org/a/b.txt?x=.y#z", b"x"), (None, None, "https://h.org", b"x"), (".hidden", None, None, b"\xef\xbb\xbfx")]
    out = [(r.filename, r.file_extension, r.charset) for r in quire.classify(inputs(spark, rows)).orderBy("doc_key").collect()]
    assert out == [("A.Tar.GZ", "gz", "iso-8859-1"), ("b.txt", "txt", None), (None, None, None), (".hidden", None, "utf-8")]


def test_errors_are_columns(spark):
    rows = [("a.docx", None, None, b"junk"), ("b.zip", None, None, fx.zipped({"a": "b"})), ("c.txt", None, None, b" "), ("d.txt", None, None, b"ok"), ("e.txt", None, None, b"x" * 50), (None, None, None, None), ("f.html", None, None, b"<p>\xff")]
    out = {int(r.doc_key): (r.status, r.error_code) for r in quire.convert(inputs(spark, rows), largest=40).collect()}
    assert out == {0: ("failed", "fileCorrupted"), 1: ("failed", "tooLarge"), 2: ("failed", "emptyDocument"), 3: ("parsed", None), 4: ("failed", "tooLarge"), 5: ("failed", "documentTypeNotSupported"), 6: ("failed", "decodingFailed")}


def test_sections_have_stable_ids(spark):
    df = inputs(spark, [("b.epub", None, None, fx.epub("B", "A", [("1", "<p>x"), ("2", "<p>y")]))])
    one, two = ([tuple(r) for r in quire.sections_of(quire.convert(df)).orderBy("ordinal").collect()] for _ in range(2))
    assert one == two and len({r[2] for r in one}) == 2 and [r[1] for r in one] == [0, 1]


def test_registry_order_and_fall_through(spark):
    def refuse(data, info):
        raise NotAccepted

    def shout(data, info):
        return Result([Section("body", data.decode().upper())])

    base = quire.default_registry()
    custom = base.registering(quire.Converter(frozenset({"plainText"}), shout, 5)).registering(quire.Converter(frozenset({"plainText"}), refuse, -1))
    assert len(base.converters) + 2 == len(custom.converters)
    df = inputs(spark, [("a.txt", None, None, b"hi")])
    assert quire.export(df, "markdown", custom).first().output == "HI"
    assert quire.export(df, "markdown").first().output == "hi"
    ties = quire.Registry().registering(quire.Converter(frozenset({"x"}), shout)).registering(quire.Converter(frozenset({"x"}), refuse))
    assert [c.kernel for c in ties.converters] == [shout, refuse]
    with pytest.raises(ConvertError):
        quire.Registry().convert(b"", Info())


CLEAN = [
    ("a\r\nb\rc\nd", "a\nb\nc\nd"),
    ("a\u0085b c d\x0be\x0cf", "a b c d e f"),
    ("a\u0000\u0007\u007f\u009fb\tc", "ab\tc"),
    ("a­​⁠⁤﻿b", "ab"),
    ("a؜‎‪⁩b", "ab"),
    ("a    　b", "a     b"),
    ("a�b", "ab"),
    ("é", "é"),
    ("‍‌", "‍‌"),
    ("", ""),
    (None, None),
]


def test_sanitizing(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(CLEAN)], "k int, t string")
    assert {r.k: r.c for r in df.select("k", sanitize(df.t).alias("c")).collect()} == {k: b for k, (_, b) in enumerate(CLEAN)}
    assert all(sanitize_text(a) == b == sanitize_text(b) for a, b in CLEAN if a is not None)


def test_sanitized_documents(spark):
    rows = [("a.txt", None, None, "x​y".encode()), ("b.txt", None, None, "​".encode()), ("c.csv", None, None, "a​,b".encode())]
    out = {int(r.doc_key): r for r in quire.convert(inputs(spark, rows), sanitize_unicode=True).collect()}
    assert out[0].sections[0].markdown == "xy" and out[1].error_code == "emptyDocument" and out[2].sections[0].metadata["csv"] == "a,b"
    raw = {int(r.doc_key): r for r in quire.convert(inputs(spark, rows)).collect()}
    assert raw[0].sections[0].markdown == "x​y" and raw[1].status == "parsed"
    later = {int(r.doc_key): r for r in quire.sanitize_sections(quire.convert(inputs(spark, rows))).collect()}
    assert later[0].sections[0].markdown == "xy" and later[2].sections[0].metadata["csv"] == "a,b"


def test_exported_content(spark):
    df = quire.convert(inputs(spark, [("b.epub", None, None, fx.epub("B", "A", [("1", "<p>x"), ("2", "<p>y")]))]))
    assert quire.exported_content(df).first().exported_content == ["x", "y"]
    assert quire.exported_content(df, "plaintext").first().exported_content == ["x\n\ny"]
    with pytest.raises(ValueError):
        quire.render(df, "json")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"text")
    (tmp_path / "sub" / "b.csv").write_bytes(b"x,y")
    (tmp_path / ".hidden.txt").write_bytes(b"no")
    (tmp_path / "bad.docx").write_bytes(b"junk")
    return tmp_path


def test_folder(spark, folder):
    out = {r.filename: (r.status, r.output) for r in quire.convert_folder(spark, str(folder), "plaintext").collect()}
    assert out == {"a.txt": ("parsed", "text"), "b.csv": ("parsed", "x\ty"), "bad.docx": ("failed", None)}
    assert quire.read_files(spark, str(folder), recursive=False).count() == 2
    quire.write_exports(quire.convert_folder(spark, str(folder), "xml"), str(folder / "out"))
    assert glob.glob(str(folder / "out" / "format=xml" / "*.parquet"))


def test_document_tree(spark):
    rows = [("/d", None, None, None), ("/d/a.txt", "/d", b"x", None), ("/d/b.docx", "/d", b"junk", None), ("/e", None, None, None), ("/d/c.txt", "/d", None, "noAccess")]
    df = spark.createDataFrame([(k, p, None if c is None else bytearray(c), k.rpartition("/")[2], e) for k, p, c, e in rows], "doc_key string, parent_key string, content binary, filename string, error_code string")
    out = {r.doc_key: (r.status, r.error_code, r.exported_content) for r in quire.parse_documents(df).collect()}
    assert out == {"/d": ("parsed", None, []), "/d/a.txt": ("parsed", None, ["x"]), "/d/b.docx": ("failed", "fileCorrupted", []), "/e": ("failed", "emptyDocument", []), "/d/c.txt": ("failed", "noAccess", [])}


def test_new_documents(spark):
    df = spark.createDataFrame([("http://h/a.pdf",), ("http://h/a.exe",), ("file:///d/folder",), (" ",), (None,)], "url string")
    out = {r.url: (r.status, r.error_code) for r in quire.new_documents(df).collect()}
    assert out == {"http://h/a.pdf": ("awaitingFetch", None), "http://h/a.exe": ("failed", "documentTypeNotSupported"), "file:///d/folder": ("awaitingFetch", None), " ": ("failed", "invalidURL"), None: ("failed", "invalidURL")}


def test_fetch_from_a_local_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path == "/ok.html"
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>hello</p>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(u, u) for u in (f"{base}/ok.html", f"{base}/no.html", "ftp://x/y", "http://127.0.0.1:1/x")], "doc_key string, url string")
    fetched = quire.fetch_urls(df)
    out = {r.url.rpartition("/")[2]: (r.status, r.error_code) for r in fetched.collect()}
    assert out == {"ok.html": ("downloaded", None), "no.html": ("failed", "badServerResponse"), "y": ("failed", "invalidURL"), "x": ("failed", "noAccess")}
    assert quire.export(fetched.where("error_code is null").drop("status", "error_code")).first().output == "hello"
    server.shutdown()


def test_documents_by_scheme(spark, folder):
    asked = [str(folder), f"file://{folder}/a.txt", str(folder / "none.txt"), "nosuch://h/x.txt", "http://127.0.0.1:1/x.html", str(folder)]
    rows = quire.documents(spark, asked, "plaintext").collect()
    out = {(r.doc_key.removeprefix("file:").rstrip("/").removeprefix("//").removeprefix(str(folder)), r.parent_key): (r.status, r.error_code, r.exported_content) for r in rows}
    assert len(rows) == 9 - 1 and out[("", None)] == ("parsed", None, [])
    assert out[("/a.txt", str(folder))] == ("parsed", None, ["text"]) and out[("/sub/b.csv", str(folder))] == ("parsed", None, ["x\ty"])
    assert out[("/bad.docx", str(folder))][:2] == ("failed", "fileCorrupted") and out[("/none.txt", None)][:2] == ("failed", "noAccess")
    assert out[("nosuch://h/x.txt", None)][:2] == ("failed", "invalidURL") and out[("http://127.0.0.1:1/x.html", "http://127.0.0.1:1")][:2] == ("failed", "noAccess")


def test_reachable_within_many_steps(spark):
    from quire.operators.relational import reachable

    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(5, 2), (5, 2), (3, 9)], "source int, target int")
    out = {r.node: r.distance for r in reachable(edges, spark.createDataFrame([(0,)], "root int"), 12).collect()}
    assert out == {**{k: k for k in range(9)}, 9: 4, 10: 5, 11: 6, 12: 7, 13: 8, 14: 9, 15: 10, 16: 11, 17: 12}


def test_majority_style_over_blocks(spark):
    """Long and short runs and paragraphs, cut into small blocks, against plain Python."""
    import random

    from quire.operators.relational import majority_style

    rng = random.Random(3)
    paragraphs, runs = [], []
    for d in range(6):
        cuts = sorted(rng.sample(range(400), 12))
        paragraphs += [(d, a, b) for a, b in zip(cuts, cuts[1:])]
        cuts = sorted(rng.sample(range(400), 25))
        runs += [(d, a, b, rng.choice("xyz")) for a, b in zip(cuts, cuts[1:])]
    out = majority_style(spark.createDataFrame(paragraphs, "doc_key int, start int, end int"), spark.createDataFrame(runs, "doc_key int, start int, end int, style string"), block=16)
    got = {(r.doc_key, r.start): r.style for r in out.collect()}
    for d, a, b in paragraphs:
        best = max(((min(b, y) - max(a, x), -x, s) for k, x, y, s in runs if k == d and x < b and y > a), default=(0, 0, None))
        assert got[d, a] == best[2]


def test_stream_gives_what_a_batch_gives(spark, folder, tmp_path_factory):
    from quire.streaming.stream import export_stream, read_file_stream

    out, mark = (str(tmp_path_factory.mktemp(n)) for n in ("out", "mark"))
    for _ in range(2):
        export_stream(read_file_stream(spark, str(folder)), out, mark, "xml").awaitTermination(120)
        (folder / "late.txt").write_bytes(b"late")
    export_stream(read_file_stream(spark, str(folder)), out, mark, "xml").awaitTermination(120)
    rows = lambda df: sorted((os.path.basename(r.doc_key), r.status, r.output) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(quire.convert_folder(spark, str(folder), "xml"))


def test_majority_style(spark):
    from quire.operators.relational import majority_style

    p = spark.createDataFrame([("d", 0, 10), ("d", 10, 12), ("d", 50, 60)], "doc_key string, start int, end int")
    r = spark.createDataFrame([("d", 0, 4, "a"), ("d", 4, 11, "b"), ("d", 11, 40, "c")], "doc_key string, start int, end int, style string")
    assert {x.start: x.style for x in majority_style(p, r).collect()} == {0: "b", 10: "b", 50: None}


def test_functions_in_sql(spark):
    assert "readable" in quire.register(spark)
    row = spark.sql("SELECT csv_rows('a,\"b\"\"\"\\nc') AS r, csv_text(array(array('x,', null))) AS t, sanitize_unicode(concat('a', chr(160))) AS u, html_markdown('<b>x</b> <a href=y>z</a>', 'http://h/') AS m, readable('<title>T</title>few').title AS h, readable(null) AS n").first()
    assert (row.r, row.t, row.u, row.m, row.h, row.n) == ([["a", 'b"'], ["c"]], '"x,",', "a ", "**x** [z](http://h/y)", "T", None)


def test_end_record_is_looked_for_once(spark):
    """The directory is cut out right with and without a comment, also one that looks like a
    record; and the search, on all of a file's end, stands once in the plan's expression."""
    import io
    import zipfile

    from pyspark.sql import functions as F

    from quire.operators.detect import zip_part

    rows, want = [], []
    for k, comment in enumerate((b"", b"a comment", b"PK\5\6", b"PK\5\6" + b"x" * 17)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", "x" * 50)
            z.comment = comment
        rows.append((k, bytearray(out.getvalue())))
        at, end = out.getvalue().index(b"PK\1\2"), out.getvalue().index(b"PK\5\6")
        want.append(out.getvalue()[at:end])
    column = zip_part(F.col("content"))
    found = spark.createDataFrame(rows, "k int, content binary").select("k", column.alias("d")).orderBy("k").collect()
    assert [bytes(r.d) for r in found] == want
    assert str(column).count("regexp_extract") == 1


def test_sections_are_put_together_by_columns():
    """As Arrow makes them of rows, and with lone surrogates replaced."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from quire.kernels.model import Section
    from quire.operators.convert import column, section_row, sections_column
    from quire.plans.schema import CONVERTED

    kind = to_arrow_type(CONVERTED["sections"].dataType)
    lists = [[], [section_row("k", 0, Section("body", "text", page_start=3)), section_row("k", 1, Section("image", "i", "t", metadata={"a": "1", "b": "2"}))], [section_row("l", 0, Section("body", "x"))], []]
    got = sections_column(lists, kind)
    got.validate(full=True)
    assert got.type == kind and got.to_pylist() == pa.array(lists, kind).to_pylist()
    assert sections_column([], kind).to_pylist() == []
    assert column(["a\ud800b", None], pa.string()).to_pylist() == ["a?b", None]
    assert sections_column([[section_row("k", 0, Section("body", "\ud800"))]], kind).to_pylist()[0][0]["markdown"] == "?"
