"""Blocks, inline marks, notes and the five formats."""

import pytest

from quire.kernels.model import ConvertError, Result, Section
from quire.rendering.blocks import is_separator, parse_blocks, table_cells
from quire.rendering.formats import render
from quire.rendering.inline import inline_html, inline_plain, references
from quire.rendering.notes import split_notes


def result(markdown, **more):
    return Result([Section("body", markdown)], **more)


def html(markdown):
    return render(result(markdown), "html").split("<body>\n")[1].removesuffix("\n</body>\n</html>")


@pytest.mark.parametrize(
    "markdown,kinds",
    [
        ("# a\n###### b\n####### c\n#d", ["heading", "heading", "paragraph"]),
        ("---\n***\n___\nx\n___", ["rule", "rule", "rule", "paragraph"]),
        ("a\n---\nb", ["paragraph", "rule", "paragraph"]),
        ("```\n# x\n| y\n", ["code"]),
        ("- a\n* b\n+ c\n1. d\n2. e", ["list", "list"]),
        ("- a\n\n- b", ["list", "list"]),
        ("> a\n>b\n\n> c", ["quote", "quote"]),
        ("| a |\n| --- |\n| b |\nx", ["table", "paragraph"]),
        ("", []),
    ],
)
def test_block_kinds(markdown, kinds):
    assert [b.kind for b in parse_blocks(markdown)] == kinds


def test_block_parts():
    (lst,) = parse_blocks("- a\n  more\n  - nested\n- b")
    assert lst.parts == ["a\nmore", "nested", "b"]
    (table,) = parse_blocks("| a\\|b | c\\\\ |\n|:-:|---|\n| --- | --- |\n| x \\|")
    assert table.rows == [["a|b", "c\\"], ["---", "---"], ["x |"]]
    assert table_cells("| a \\| b") == ["a \\| b"] and table_cells("a|b\\\\|") == ["a", "b\\\\"]
    assert is_separator(["--", ":-:"]) and not is_separator(["--", ""]) and not is_separator([])
    (quote,) = parse_blocks(">  x\n> y")
    assert quote.parts == [" x", "y"]


def test_inline_html():
    assert inline_html("a **b *c* d** & `x*y<` [l*m*](u&v) ![i](<a b>)") == 'a <strong>b <em>c</em> d</strong> &amp; <code>x*y&lt;</code> <a href="u&amp;v">l<em>m</em></a> <img src="a b" alt="i">'
    assert inline_html("***x***") == "<strong><em>x</em></strong>"
    assert inline_plain("**b** [l](u) `c`") == "b l c"
    assert references("[^a] `[^b]` [x[^c](u) [^d]") == ["a", "d"]


def test_notes():
    body, notes = split_notes("text[^1]\n\n[^1]: first\n    more\n\n    para\n\nend\n```\n[^2]: code\n```\n    [^3]: no\n   [^4]: yes")
    assert body == "text[^1]\n\n\nend\n```\n[^2]: code\n```\n    [^3]: no"
    assert [(n.id, n.text) for n in notes] == [("1", "first\nmore\n\npara"), ("4", "yes")]


def test_notes_are_numbered_by_reference():
    md = "b[^b] a[^a] again[^b] `[^c]` gone[^x]\n\n[^a]: A [^d]\n[^b]: B\n[^c]: C\n[^d]: D\n[^a]: second"
    assert render(result(md), "plaintext") == "b[1] a[2] again[1] [^c] gone[^x]\n\n[1] B\n[2] A [3]\n[3] D"
    page = html(md)
    assert '<sup class="footnote-ref"><a href="#fn-b">1</a></sup>' in page and page.count("<li id=") == 3 and 'id="fn-c"' not in page
    assert html("no notes") == "<p>no notes</p>"


def test_html_blocks():
    assert html("# A <b>\n\nx\ny\n\n1. a\n1. b\n\n| h |\n| --- |\n| c |\n\n> q\n> r\n\n```\n<&\n```\n---") == (
        "<h1>A &lt;b&gt;</h1>\n<p>x<br>\ny</p>\n<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n<table>\n<thead>\n<tr><th>h</th></tr>\n</thead>\n<tbody>\n<tr><td>c</td></tr>\n</tbody>\n</table>\n<blockquote>q<br>\nr</blockquote>\n<pre><code>&lt;&amp;</code></pre>\n<hr>"
    )
    assert "<title>a &amp; b</title>" in render(result("x", title="a & b"), "html")


def test_images_become_data_urls():
    image = lambda path, data: Section("image", "![n](n.png)", title="n.png", source_path=path, metadata={"mimeType": "image/png", "base64": data})
    one = Result([Section("body", "![n](n.png)"), image("word/media/n.png", "QUJD")])
    assert 'src="data:image/png;base64,QUJD"' in render(one, "html")
    two = Result([*one.sections, image("word/sub/n.png", "REVG")])
    assert 'src="n.png"' in render(two, "html") and "base64" not in render(two, "html")
    assert render(one, "markdown") == "![n](n.png)" and render(one, "csv") == "n"


def test_xml_and_csv():
    r = Result([Section("table", "| a |\n| --- |\n| b,c |", title='t"', metadata={}), Section("image", "![i](i)"), Section("body", "# h\n\n```\na|b\n```\n*x*")], title="T", author="A")
    assert render(r, "xml") == '<?xml version="1.0" encoding="UTF-8"?>\n<document title="T" author="A">\n  <section kind="table" title="t&quot;">\n    | a |\n| --- |\n| b,c |\n  </section>\n  <section kind="image">\n    ![i](i)\n  </section>\n  <section kind="body">\n    # h\n\n```\na|b\n```\n*x*\n  </section>\n</document>'
    assert render(r, "csv") == 'a\n"b,c"\n# h\na|b\nx'
    assert render(Result([Section("table", "| x |", metadata={"csv": 'a,"b"'})]), "csv") == 'a,"b"'
    with pytest.raises(ConvertError):
        render(r, "json")
