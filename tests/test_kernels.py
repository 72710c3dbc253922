"""Parsers, each on small documents made here."""

import base64
import struct

import pytest

from quire import fixtures as fx
from quire.kernels import delimited, docx, epub, html_page, iwork, iwork_tables, ocr, pdf, rtf, snappy, xlsx
from quire.kernels.html_dom import parse
from quire.kernels.html_markdown import element_markdown, page_markdown
from quire.kernels.model import ConvertError, Info, NotAccepted
from quire.kernels.reader import article, readable

INFO = Info(filename="name")


def fails(code, f, *args):
    with pytest.raises(ConvertError) as e:
        f(*args)
    assert e.value.code == code


def body(result):
    return result.sections[0].markdown


# --- text and CSV ---------------------------------------------------------------------------


def test_plain_text():
    assert body(delimited.convert_text("é * # x".encode(), INFO)) == "é * # x"
    assert body(delimited.convert_text("é".encode("utf-16"), Info(charset="utf-16"))) == "é"
    assert body(delimited.convert_text("é".encode(), Info(charset="us-ascii"))) == "é"
    fails("emptyDocument", delimited.convert_text, b" \n\t", INFO)
    with pytest.raises(NotAccepted):
        delimited.convert_text(b"\xff\xfe\xfa", INFO)


@pytest.mark.parametrize(
    "text,rows",
    [
        ("", []),
        ("a,b\nc", [["a", "b"], ["c"]]),
        ("a\r\nb\rc\n", [["a"], ["b"], ["c"]]),
        ('"x, y","a ""q"""\n', [["x, y", 'a "q"']]),
        ('"line1\nline2",z', [["line1\nline2", "z"]]),
        ("a\n\nb", [["a"], [""], ["b"]]),
        ('a\n""', [["a"], [""]]),
        ("a,", [["a", ""]]),
        ('pre"quo,ted"post', [["prequo,tedpost"]]),
        ('"open', [["open"]]),
        ("\n", [[""]]),
    ],
)
def test_csv_records(text, rows):
    assert delimited.parse_csv(text) == rows


def test_csv_round_trip_and_table():
    rows = [[" edge", "a,b", 'q"'], ["x\ny", "\\|", ""], ["", "", ""]]
    assert delimited.parse_csv(delimited.serialize_csv(rows)) == rows
    r = delimited.convert_csv(b'h,i\n"a|b\\",\n', INFO)
    assert body(r) == "| h | i |\n| --- | --- |\n| a\\|b\\\\ |  |" and r.sections[0].kind == "table"
    assert r.sections[0].metadata["csv"] == "h,i\na|b\\,"
    fails("emptyDocument", delimited.convert_csv, b"", INFO)
    fails("decodingFailed", delimited.convert_csv, b"\xff\xff", INFO)


# --- HTML -----------------------------------------------------------------------------------


def test_markdown_of_elements():
    page = """<h2>T <em>i</em></h2><p>a <b>b</b>  <a href="/x?q=1">l</a><br>c</p><ul><li>one<li>two<ul><li>in</ul></ul><ol start=5><li>x</ol><blockquote><p>q1<p>q2</blockquote><pre>  code
 x</pre><p>k <code>c  d</code><img src=i.png alt=A><hr><script>no</script>"""
    assert page_markdown(page, "http://h.org/d/")[1] == (
        "## T *i*\n\na **b** [l](http://h.org/x?q=1)  \nc\n\n- one\n- two\n  \n  - in\n\n1. x\n\n> q1\n>\n> q2\n\n```\n  code\n x\n```\n\nk `c d`![A](http://h.org/d/i.png)\n\n---"
    )


def test_markdown_tables_and_relative_links():
    t = "<table><tr><th>a|b<td>c<tr><td>1</table>"
    assert element_markdown(next(e for e in parse(t).body.descendants() if e.tag == "table")) == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"
    assert page_markdown("<a href='rel'>x</a>")[1] == "[x](rel)"


def test_tree_reopens_formatting_and_fosters():
    assert page_markdown("<p><b>one<p>two</b> three")[1] == "**one**\n\n**two** three"
    assert page_markdown("<b>1<i>2</b>3</i>")[1] == "**1*2****3*"
    assert page_markdown("<table>out<tr><td>in</table>")[1] == "out\n\n| in |\n| --- |"
    assert page_markdown("<p>a<div>b</p>c")[1].split() == ["a", "b", "c"]
    doc = parse("<title>T &amp; U</title><p>x")
    assert doc.title() == "T & U" and [e.tag for e in doc.body.elements()] == ["p"]


def test_deep_and_broken_pages():
    deep = "<div>" * 20000 + "x" + "<b><i>" * 3000 + "y</div>" + "</i><table><tr><td>" * 500 + "z"
    assert {"xy", "z"} <= set(page_markdown(deep)[1].replace("*", " ").replace("|", " ").split())
    assert "y" in readable(deep).text_content
    for bad in ("<", "<a", "<a href='x", "<!--", "<p <b>>", "</", "<title>", "<script>", "&#xD800;&#0;&bogus;", "\x00<p>\x00", "<table><td></table></td>", "</p></b>", "<select><option>a<option>b"):
        page_markdown(bad)
        readable(bad)


STORY = "<p>This is the first sentence of a story, which has commas, and goes on for quite some time so that it counts.</p>" * 3
PAGE = f'<html lang=en><head><title>Tab</title><meta property="og:title" content="Title"><meta name=author content="Ann"></head><body><nav>menu</nav><div id=main><h1>Head</h1>{STORY}<p class=promo>Buy</p></div><div class="site-footer">foot</div></body></html>'


def test_reader_mode():
    r = html_page.convert_html(PAGE.encode(), Info())
    assert r.title == "Title" and r.author == "Ann"
    assert body(r).startswith("# Head\n\nThis is") and "menu" not in body(r) and "foot" not in body(r) and "Buy" not in body(r)
    whole = html_page.convert_html(PAGE.encode(), Info(reader_mode=False))
    assert whole.title == "Tab" and "menu" in body(whole) and "foot" in body(whole)
    assert html_page.convert_html(b"<p>short", Info()).sections[0].markdown == "short"
    fails("emptyDocument", html_page.convert_html, b"<html></html>", INFO)


def test_readable_values():
    r = readable(PAGE)
    assert (r.title, r.byline, r.lang, r.length) == ("Title", "Ann", "en", len(r.text_content))
    short = readable("<head><meta name=description content=d1><meta name=description content=d2><title>t</title></head><style>x</style><p>few")
    assert (short.text_content, short.excerpt, short.title) == ("few", "d1", "t")
    tie = article(parse(f"<div id=a>{STORY}</div><div id=b>{STORY}</div>"))
    assert tie is not None


def test_html_charsets():
    page = '<meta charset="windows-1252"><p>caf\xe9'.encode("cp1252")
    assert body(html_page.convert_html(page, Info())) == "café"
    assert html_page.declared_charset(b"<meta http-equiv=x content='text/html; charset=Shift_JIS'>") == "shift_jis"
    assert html_page.declared_charset(b"<meta charset=nope>") is None
    fails("decodingFailed", html_page.convert_html, b"<p>\xff\xfe\xfd", INFO)
    assert html_page.readable_bytes(b"<p>\xff\xe9").text_content == "\xff\xe9"


# --- packages -------------------------------------------------------------------------------


def test_epub():
    r = epub.convert_epub(fx.epub("Book", "Ann", [("One", "<h1>H</h1><p>text</p>"), ("Two", " "), ("Three", "<p>z")], b"png"), INFO)
    assert (r.title, r.author, r.cover) == ("Book", "Ann", b"png")
    assert [(s.kind, s.title, s.markdown, s.source_path) for s in r.sections] == [("chapter", "One", "# H\n\ntext", "OEBPS/text/ch 0.xhtml"), ("chapter", "Three", "z", "OEBPS/text/ch 2.xhtml")]
    fails("fileCorrupted", epub.convert_epub, b"PK", INFO)
    fails("fileCorrupted", epub.convert_epub, fx.zipped({"a": "b"}), INFO)
    fails("emptyDocument", epub.convert_epub, fx.epub("B", "A", []), INFO)


def test_xlsx():
    r = xlsx.convert_xlsx(fx.xlsx({"S": [["Name", "Score"], ["Al|ice"]], "Empty": [], "T": [["x\ny"]]}), INFO)
    assert r.title == "S, T" and [s.sheet_name for s in r.sections] == ["S", "T"]
    assert body(r) == "## S\n\n| Name | Score |\n| --- | --- |\n| Al\\|ice |  |\n"
    raw = {"xl/workbook.xml": '<workbook><sheets><sheet name="N" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": fx.relationships([("r1", "t", "s.xml")]), "xl/s.xml": '<worksheet><row><c><v>1.5</v></c><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c/></row></worksheet>'}
    assert body(xlsx.convert_xlsx(fx.zipped(raw), INFO)) == "## N\n\n| 1.5 | inline |  |\n| --- | --- | --- |\n"
    fails("fileCorrupted", xlsx.convert_xlsx, b"junk", INFO)
    fails("emptyDocument", xlsx.convert_xlsx, fx.xlsx({"S": []}), INFO)


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_docx_blocks():
    p = fx.docx_paragraph
    xml = p("Title", "Title") + p("Sub", "Heading9") + f"<w:p>{run('b', '<w:b/>')}{run(' n ')}{run('bi', '<w:b/><w:i/>')}{run('off', '<w:b w:val=\"0\"/>')}</w:p>"
    xml += '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:br/><w:t>next</w:t></w:r></w:p><w:sdt><w:sdtContent>' + p("inside") + "</w:sdtContent></w:sdt>"
    xml += f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("a|")}{p("b")}</w:tc></w:tr><w:tr><w:tc>{p("1")}</w:tc><w:tc>{p("2")}</w:tc></w:tr></w:tbl>'
    xml += '<w:p><w:hyperlink r:id="h">' + run("li[n]k") + "</w:hyperlink></w:p>"
    r = docx.convert_docx(fx.docx(xml, [("h", "x/hyperlink", "http://a/(b)")]), INFO)
    assert body(r) == "# Title\n\n###### Sub\n\n**b** n ***bi***off\n\n- item  \nnext\n\ninside\n\n| a\\|<br>b |  |\n| --- | --- |\n| 1 | 2 |\n\n[li\\[n\\]k](<http://a/(b)>)"
    fails("fileCorrupted", docx.convert_docx, b"not a zip", INFO)
    fails("fileCorrupted", docx.convert_docx, fx.zipped({"a": "b"}), INFO)
    fails("emptyDocument", docx.convert_docx, fx.docx(""), INFO)


def test_docx_notes_and_images():
    drawing = '<w:r><w:drawing><wp:docPr descr="A red dot"/><a:blip r:embed="i"/></w:drawing></w:r>'
    xml = f'<w:p>{run("see")}<w:r><w:footnoteReference w:id="2"/></w:r>{drawing}</w:p><w:p><w:hyperlink r:id="h">{drawing}</w:hyperlink></w:p>'
    notes = f'<w:footnotes {fx.W}><w:footnote w:id="0" w:type="separator"><w:p>{run("x")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("note")}<w:r><w:br/></w:r>{run("two")}</w:p></w:footnote></w:footnotes>'
    r = docx.convert_docx(fx.docx(xml, [("i", "x/image", "media/image1.png"), ("h", "x/hyperlink", "http://a")], {"word/footnotes.xml": notes, "word/media/image1.png": b"PNG"}), INFO)
    assert body(r) == "see[^fn2]![A red dot](image1.png)\n\n![A red dot](image1.png)\n\n[^fn2]: note  \n    two"
    (image,) = r.sections[1:]
    assert (image.kind, image.source_path, image.metadata["mimeType"]) == ("image", "word/media/image1.png", "image/png") and base64.b64decode(image.metadata["base64"]) == b"PNG"


def test_docx_text_boxes():
    p = fx.docx_paragraph
    box = lambda t: f"<w:r><w:drawing><w:txbxContent>{t}</w:txbxContent></w:drawing></w:r>"
    both = f"<w:p><mc:AlternateContent><mc:Choice>{box(p('boxed'))}</mc:Choice><mc:Choice>{box(p('other'))}</mc:Choice><mc:Fallback>{box(p('boxed'))}</mc:Fallback></mc:AlternateContent></w:p>"
    assert body(docx.convert_docx(fx.docx(p("text") + both), INFO)) == "text\n\nboxed"
    fallback = f"<w:p><mc:AlternateContent><mc:Choice/><mc:Fallback>{box(p('only'))}</mc:Fallback></mc:AlternateContent></w:p>"
    assert body(docx.convert_docx(fx.docx(fallback), INFO)) == "only"
    cell = f"<w:tbl><w:tr><w:tc><w:p>{run('cell')}{box(p('inner'))}</w:p></w:tc></w:tr></w:tbl>"
    assert body(docx.convert_docx(fx.docx(cell), INFO)) == "| cell |\n| --- |\n\ninner"
    table = box(f"<w:tbl><w:tr><w:tc>{p('t')}</w:tc></w:tr></w:tbl>")
    assert body(docx.convert_docx(fx.docx(f"<w:p>{table}</w:p>"), INFO)) == "| t |\n| --- |"


def test_xml_entities_are_not_expanded():
    evil = '<!DOCTYPE x [<!ENTITY a "aaaaaaaaaa">]><w:document><w:body/></w:document>'
    fails("emptyDocument", docx.convert_docx, fx.zipped({"word/document.xml": evil}), INFO)


# --- RTF ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source,want",
    [
        (r"{\rtf1 Hello {\b bold } x\par next}", "Hello **bold**  x\n\nnext"),
        (r"{\rtf1 \i it\i0  \b\i both\plain  end}", "*it* ***both*** end"),
        ("{\\rtf1 \\u8217?s \\'93q\\'94 \\uc2\\u8364ab!}", "’s “q” €!"),
        (r"{\rtf1\ansicpg1251 \'cf\'f0}", "Пр"),
        (r"{\rtf1\ansicpg932 \'93\'fa\'96\'7b}", "日本"),
        (r"{\rtf1 \u-10179?\u-8704?}", "\U0001f600"),
        (r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}{\footnote no\par}text}", "text"),
        (r"{\rtf1 a\line b\tab c\emdash\~d\_e\-f\{\}}", "a  \nb\tc—\xa0d-ef{}"),
        (r"{\rtf1 a\page b\sect c\row d}", "a\n\nb\n\nc\n\nd"),
        (r"{\rtf1 x\bin4 {}}{y}", "xy"),
        ("{\\rtf1 a\r\nb\\\nc}", "ab\n\nc"),
    ],
)
def test_rtf(source, want):
    assert body(rtf.convert_rtf(source.encode("latin-1"), INFO)) == want


def test_rtf_errors():
    fails("fileCorrupted", rtf.convert_rtf, b"plain", INFO)
    fails("emptyDocument", rtf.convert_rtf, b"{\\rtf1 }", INFO)
    fails("decodingFailed", rtf.convert_rtf, b"", INFO)


# --- iWork ----------------------------------------------------------------------------------


def test_snappy():
    assert snappy.unpack_block(bytes([5, 4 << 2]) + b"hello") == b"hello"
    assert snappy.unpack_block(bytes([10, 0, ord("a"), 1 | 5 << 2, 1])) == b"a" * 10
    data = bytes(range(256)) * 700
    assert snappy.unpack_stream(snappy.pack_stream(data)) == data
    for bad in (b"", bytes([5, 4 << 2]) + b"hi", bytes([9, 0, 97, 1, 9]), bytes([1, 4 << 2]) + b"hello"):
        with pytest.raises(snappy.Malformed):
            snappy.unpack_block(bad)
    with pytest.raises(snappy.Malformed):
        snappy.unpack_stream(b"\x01\x02\x00\x00ab")


def test_objects_in_either_field_order():
    from quire.kernels.iwa import objects

    for first in (False, True):
        (o,) = objects(fx.iwa_object(4242, 2001, b"xy", [7, 300], info_first=first))
        assert (o.id, o.type, o.payload, o.references) == (4242, 2001, b"xy", [7, 300])
    assert objects(fx.iwa_object(1, 2, b"abc")[:-1]) == []


@pytest.mark.parametrize("value,exponent,want", [(12345, -2, "123.45"), (0, 5, "0"), (-5, 0, "-5"), (5, 3, "5000"), (1200, -2, "12"), (1, -6, "0.000001"), (1, -7, "1E-7"), (-7, 30, "-7E30"), (1234, 20, "1.234E23"), (10**33, -33, "1")])
def test_decimals(value, exponent, want):
    assert iwork_tables.decimal_text(fx.decimal_cell(value, exponent)) == want


def test_dates():
    assert iwork_tables.iso_date(0) == "2001-01-01" and iwork_tables.iso_date(-1) == "2000-12-31" and iwork_tables.iso_date(86400 * 365.0 * 3 + 86400 * 59) == "2004-02-29"
    assert iwork_tables.iso_date(float("nan")) == iwork_tables.iso_date(4e11) == "" and iwork_tables.decimal_text(b"\0" * 15 + b"\x60") == ""


def styled():
    text = "Big Title\nSome bold text ￼\nafter link￼ end"
    runs = fx.run_table(5, [(0, 20), (10, 22)]) + fx.run_table(8, [(15, 21), (19, None)]) + fx.run_table(9, [(25, 30), (37, 31)]) + fx.run_table(11, [(33, 40), (37, None)])
    objects = fx.iwa_object(1, 2001, fx.storage(text, 0, runs)) + fx.iwa_object(2, 2001, fx.storage("header", 1))
    objects += fx.iwa_object(20, 2025, fx.style(None, parent=23)) + fx.iwa_object(23, 2025, fx.style("Heading 2")) + fx.iwa_object(22, 2025, fx.style("Body"))
    objects += fx.iwa_object(21, 2021, fx.style(None, parent=24, italic=False)) + fx.iwa_object(24, 2021, fx.style(None, None, True, True))
    objects += fx.iwa_object(40, 2032, fx.bytes_field(2, b"http://x/(y)")) + fx.iwa_object(30, 2003, b"", [50]) + fx.iwa_object(31, 2003, b"", [])
    return objects


def grid():
    rows = [[fx.cell(3, (0).to_bytes(4, "little")), fx.cell(2, fx.decimal_cell(15, -1)), None], [fx.cell(5, struct.pack("<d", 86400.0)), None, fx.cell(7, b"")]]
    return fx.table_objects(50, 51, 52, rows, ["h|"])


def test_pages_inline_tables_styles_links():
    r = iwork.convert_pages(fx.iwork({"Index/Document.iwa": styled(), "Index/Tables/T.iwa": grid()}), INFO)
    assert [(s.kind, s.markdown) for s in r.sections] == [
        ("body", "### Big Title\n\nSome **bold** text"),
        ("table", "| h\\| | 1.5 |  |\n| --- | --- | --- |\n| 2001-01-02 |  |  |"),
        ("body", "after [link](<http://x/(y)>) end"),
    ]


def test_pages_fallbacks():
    loose = fx.iwork({"Index/Document.iwa": fx.iwa_object(1, 2001, fx.storage("text", None)), "Index/T.iwa": grid()}, nested=False)
    assert [s.kind for s in iwork.convert_pages(loose, INFO).sections] == ["body", "table"]
    nested = fx.iwork({"Document.iwa": fx.iwa_object(1, 2001, fx.storage("in zip"))}, nested=True)
    assert body(iwork.convert_pages(nested, INFO)) == "in zip"
    assert body(iwork.convert_pages(fx.zipped({"Index/Document.iwa": snappy.pack_stream(fx.iwa_object(1, 2001, fx.storage("a")) + b"\xff"), "Index/Bad.iwa": b"xx"}), INFO)) == "a"
    fails("fileCorrupted", iwork.convert_pages, fx.zipped({"Index/Document.iwa": b"xx"}), INFO)
    fails("documentTypeNotSupported", iwork.convert_pages, fx.zipped({"a": "b"}), INFO)
    fails("emptyDocument", iwork.convert_pages, fx.pages_of_lines([""]), INFO)


def test_keynote_order_masters_and_tables():
    r = iwork.convert_keynote(fx.keynote_of_slides(["one", "", "three"]), INFO)
    assert [(s.slide_number, s.markdown) for s in r.sections] == [(1, "one"), (3, "three")]
    slide = lambda i, t, refs=(): fx.iwa_object(i, 5, b"", refs) + fx.iwa_object(i + 500, 2001, fx.storage(t, 0)) + fx.iwa_object(i + 600, 2001, fx.storage("notes", 4))
    deck = fx.iwork({"Index/Slide-10.iwa": slide(10, "b", [50]), "Index/Slide-2.iwa": slide(2, "a", [90]), "Index/MasterSlide-1.iwa": fx.iwa_object(90, 5, b"", [50]) + fx.iwa_object(91, 2001, fx.storage("master")), "Index/T.iwa": grid()})
    r = iwork.convert_keynote(deck, INFO)
    assert [(s.kind, s.slide_number, s.markdown[:3]) for s in r.sections] == [("slide", 1, "a"), ("slide", 2, "b"), ("table", 2, "| h")]
    fails("fileCorrupted", iwork.convert_keynote, fx.zipped({"Index/Slide1.iwa": b"xx"}), INFO)
    fails("documentTypeNotSupported", iwork.convert_keynote, fx.zipped({"a": "b"}), INFO)
    text = fx.iwork({"Index/Document.iwa": fx.iwa_object(1, 2001, fx.storage("only text"))})
    assert [(s.kind, s.markdown) for s in iwork.convert_keynote(text, INFO).sections] == [("body", "only text")]


# --- PDF and OCR ----------------------------------------------------------------------------


def test_pdf():
    data = fx.pdf([["Quarterly (Q1) report", "second"], [], ["page 3"]], "The title")
    r = pdf.convert_pdf(data, INFO)
    assert r.title == "The title" and [(s.page_start, s.markdown) for s in r.sections] == [(1, "Quarterly (Q1) report\nsecond"), (3, "page 3")]
    seen = pdf.convert_pdf(data, INFO, lambda file, page: f" scanned {page} ")
    assert [s.metadata["extractionMethod"] for s in seen.sections] == ["text-operators", "ocr", "text-operators"]
    fails("fileCorrupted", pdf.convert_pdf, b"%PDF-1.4", INFO)
    fails("noAccess", pdf.convert_pdf, data.replace(b"/Info", b"/Encrypt"), INFO)
    fails("emptyDocument", pdf.convert_pdf, fx.pdf([[]]), INFO)


def test_pdf_unicode_maps():
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <03B1> endbfrange"
    assert pdf.decoded(b"\x01\x02\x04\x09", pdf.unicode_map(cmap)) == "Aαγ"


def test_ocr():
    boxes = [ocr.Box(" right ", 0.6, 0.901), ocr.Box("low", 0.1, 0.2), ocr.Box("left", 0.1, 0.905), ocr.Box(" ", 0, 0)]
    one = ocr.convert_image(b"x", INFO, lambda data: [boxes])
    assert body(one) == "left\nright\nlow" and one.sections[0].title == "name"
    many = ocr.convert_image(b"x", INFO, lambda data: [boxes[1:2], [], boxes[:1]])
    assert [(s.page_start, s.markdown) for s in many.sections] == [(1, "low"), (3, "right")]
    fails("emptyDocument", ocr.convert_image, b"x", INFO, lambda data: [[]])
    for info, engine in ((Info(ocr=False), lambda data: [boxes]), (INFO, None)):
        with pytest.raises(NotAccepted):
            ocr.convert_image(b"x", info, engine)


def test_hard_pages_take_linear_time():
    import time

    from quire.kernels.html_dom import parse
    from quire.kernels.html_markdown import page_markdown

    n = 40_000
    pages = ["<a " * n, "<a " * n + ">", "</a " * n, '<a ">"' * n, "<a '" * n, "<! " * n, "a<!---->" * n, "<" * n, "<script>" + "</script " * n]
    pages += ["<div>" * 100_000 + "x", "<blockquote>" * n, "<ul><li>" * n, "<b>x" * n, "<table>" + "<i>x</i>" * n, "<table><tr><td>" * 2000]
    pages.append("".join(f"<p><font a={k}>x" for k in range(n // 4)))
    for page in pages:
        start = time.process_time()
        parse(page)
        assert time.process_time() - start < 20, page[:20]
    start = time.process_time()
    parse("<a " * 350_000)
    assert time.process_time() - start < 3
    assert page_markdown("<table><tr><td>a" * 12)[1]


def test_scanner_keeps_quotes_and_loose_tags():
    from quire.kernels.html_tokens import END, START, TEXT, Scanner

    assert list(Scanner('a <b x="1>2" y=\'<\'>c</b >d')) == [(TEXT, "a ", ""), (START, "b", ' x="1>2" y=\'<\''), (TEXT, "c", ""), (END, "b", ""), (TEXT, "d", "")]
    assert list(Scanner('<a title="x>y')) == [(START, "a", ' title="x'), (TEXT, "y", "")]
    assert list(Scanner("1 < 2 <!-- <b> --> 3 <x")) == [(TEXT, "1 < 2 ", ""), (TEXT, " 3 <x", "")]
    assert list(Scanner('<a x=">"<p>"')) == [(START, "a", ' x=">"<p'), (TEXT, '"', "")]


def test_faulty_xml_keeps_what_follows():
    from quire.kernels.package import parse_xml

    text = lambda xml: parse_xml(xml.encode()).text()
    assert text("<a><p>one</p><p>two&nbsp;x</p><p>three</p></a>").replace("\xa0", " ") == "onetwo xthree"
    assert text("<a><p>one<p>two</a> <b>three") == "onetwo three"
    assert text("<a><p>1 &unknown; 2 & 3</q></p><![CDATA[<x>]]></a>") == "1 &unknown; 2 & 3<x>"
    root = parse_xml(b'<w:a r:id="7" x=\'<\' y=bare><w:b/>&zip;<c k="&lt;"/></w:a>')
    assert root.first("w:a").attrs == {"r:id": "7", "x": "<", "y": "bare"} and root.first("c").get("k") == "<"
    assert [e.name for e in root.first("w:a").elements()] == ["w:b", "c"]
    assert text("<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>") == ""
    assert len(text("<a>" + "<b>x&nope;" * 50_000)) == 350_000


def test_rows_of_a_sheet_without_its_tree():
    """A sheet's memory is that of its texts, not of a tree; faults and nesting read as before."""
    import tracemalloc

    from quire.kernels.package import each_of, parse_xml
    from quire.kernels.xlsx import convert_xlsx

    odd = [b"<a><row x='1'>t<v>1</v></row><b><ROW/><row>u<row>v</row>w</row></b></a>", b"<a><row>1</row><row>&nbsp;2<v>", b"<!DOCTYPE a [<!ENTITY e 'x'>]><a><row>&e;</row></a>", b"", b"<row/>"]
    for part in odd:
        assert each_of(part, "row", lambda e: (e.name, e.attrs, e.text())) == [(e.name, e.attrs, e.text()) for e in parse_xml(part).all("row")]
    book = fx.xlsx({"s": [[f"name {k}", "kind"] for k in range(4000)]})
    tracemalloc.start()
    try:
        (s,) = convert_xlsx(book, Info()).sections
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert s.markdown.count("\n") == 4003 and peak < 5e6


def test_cut_references_and_pages_without_paragraphs():
    """What differs from SQL in F6 to F8: references without a semicolon are decoded, and an
    article needs a paragraph of 25 characters."""
    from quire.kernels.reader import readable

    assert [readable(f"<title>a{cut}</title><p>x").title for cut in ("&amp", "&quot")] == ["a&", 'a"']
    long = "More than enough characters of a footer. " * 5
    assert readable(f"<nav>menu</nav><article><h1>Short</h1><p>Short<br></article><footer>{long}</footer>").text_content.startswith("menu")


def test_a_sound_docx_needs_no_python_nodes(monkeypatch):
    """Its archive is read without zipfile's objects, and its parts without nodes of Python."""
    from quire.kernels import package

    xml = fx.docx_paragraph("a", "Title") + "<W:P><W:R><w:T>b</w:T></W:R></W:P>"
    monkeypatch.setattr(package, "XmlNode", None)
    monkeypatch.setattr(package.zipfile, "ZipFile", None)
    assert body(docx.convert_docx(fx.docx(xml), INFO)) == "# a\n\nb"


def test_native_elements_are_as_parse_xml_reads_them():
    from quire.kernels.package import XmlNode, parse_elements, parse_xml

    def of_node(e):
        return (e.low, e.attrs, [c if isinstance(c, str) else of_node(c) for c in e.children])

    def of_element(e):
        inner = [x for c in e for x in (of_element(c), c.tail or "")]
        return (e.tag.lower(), e.attrib, [x for x in (e.text or "", *inner) if x])

    cases = [b"<a>x<B c='1'>y</B>z<b/></a>", b"<a><b>x</a>", b"&no;<a>&no;<![CDATA[<q>]]></a><c/>", b"", b"<a><!-- c -->t<?p i?>u</a>", b'<!DOCTYPE a [<!ENTITY e "v">]><a>&e;</a>', "<a>\u00e9</a>".encode("utf-16")]
    for data in cases:
        tree, native = parse_xml(data), parse_elements(data, {"b": "b"})
        top = [c for c in tree.children if isinstance(c, XmlNode)]
        assert of_element(native) == (of_node(top[0]) if native.tag else of_node(tree)), data
    assert [e.tag for e in parse_elements(b"<A><B/><b/></A>", {"b": "b"}).iter()] == ["A", "b", "b"]


def test_plain_directories_are_as_zipfile_reads_them():
    import io
    import zipfile

    from quire.kernels.package import Package, plain_directory

    data = fx.docx(fx.docx_paragraph("a"), [], {"word/x.png": b"P"})
    fields = ("filename", "flag_bits", "compress_type", "CRC", "compress_size", "file_size", "header_offset")
    assert [tuple(m) for m in plain_directory(data)] == [tuple(getattr(i, f) for f in fields) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()]
    late = data[:-22].replace(b"PK\1\2\x14\3\x14", b"PK\1\2\x14\3\xff") + data[-22:]
    for odd in (b"", b"PK", data[:-1], b"x" + data, data[:-2] + b"\1\0c", data.replace(b"PK\1\2", b"PK\1\3"), late, fx.zipped({"\u00e9": "1"})):
        assert plain_directory(odd) is None
    assert Package(b"x" + data).read("word/x.png") == b"P"
    assert Package(fx.zipped({"\u00e9": "1"})).read("\u00e9") == b"1"
