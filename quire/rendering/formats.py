"""The five export formats."""

from __future__ import annotations

from collections import Counter

from quire.kernels.model import BLANK, BLANK_LINES, UNABLE_TO_EXPORT, ConvertError, Result, Section
from quire.kernels.package import basename
from quire.rendering.blocks import Block, parse_blocks, table_run
from quire.rendering.inline import escape_html, inline_html, inline_plain
from quire.rendering.notes import number_notes, numbered, split_notes

FORMATS = ("plaintext", "html", "xml", "markdown", "csv")


def csv_field(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


def plaintext(result: Result) -> str:
    body, notes = split_notes(result.markdown())
    blocks = parse_blocks(body)
    numbers = number_notes(blocks, notes)
    show = lambda t: inline_plain(t, numbers)

    def one(b: Block) -> str:
        if b.kind == "code":
            return b.text
        if b.kind == "rule":
            return "---"
        if b.kind == "table":
            return "\n".join("\t".join(map(show, r)) for r in b.rows)
        if b.kind == "list":
            return "\n".join((f"{k}. " if b.ordered else "- ") + show(x).replace("\n", " ") for k, x in enumerate(b.parts, 1))
        return "\n".join(map(show, b.parts))

    text = "\n\n".join(map(one, blocks)).strip(BLANK_LINES)
    defined = [f"[{n}] " + show(t.replace("\n", " ")) for n, _, t in numbered(notes, numbers)]
    return text + "\n\n" + "\n".join(defined) if defined else text


def html_table(rows: list[list[str]], numbers: dict[str, int]) -> str:
    cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{inline_html(c, numbers)}</{tag}>" for c in r) + "</tr>\n"
    return f"<table>\n<thead>\n{cells(rows[0], 'th')}</thead>\n<tbody>\n{''.join(cells(r, 'td') for r in rows[1:])}</tbody>\n</table>"


def html_block(b: Block, numbers: dict[str, int]) -> str:
    show = lambda t: inline_html(t, numbers)
    match b.kind:
        case "heading":
            return f"<h{b.level}>{show(b.text)}</h{b.level}>"
        case "paragraph":
            return "<p>" + show(b.text).replace("\n", "<br>\n") + "</p>"
        case "code":
            return f"<pre><code>{escape_html(b.text)}</code></pre>"
        case "rule":
            return "<hr>"
        case "quote":
            return "<blockquote>" + "<br>\n".join(map(show, b.parts)) + "</blockquote>"
        case "list":
            tag = "ol" if b.ordered else "ul"
            return f"<{tag}>\n" + "\n".join("<li>" + show(x).replace("\n", " ") + "</li>" for x in b.parts) + f"\n</{tag}>"
    return html_table(b.rows, numbers)


def image_name(s: Section) -> str | None:
    return (basename(s.source_path) if s.source_path is not None else s.title) or None


def with_data_urls(page: str, sections: list[Section]) -> str:
    """Image addresses that name just one embedded image become data URLs."""
    images = [(image_name(s), s) for s in sections if s.kind == "image" and s.metadata.get("base64")]
    count = Counter(name for name, _ in images if name)
    for name, s in images:
        if count[name] == 1:
            page = page.replace(f'src="{name}"', f'src="data:{s.metadata.get("mimeType", "application/octet-stream")};base64,{s.metadata["base64"]}"')
    return page


def html(result: Result) -> str:
    body, notes = split_notes(result.markdown())
    blocks = parse_blocks(body)
    numbers = number_notes(blocks, notes)
    parts = [html_block(b, numbers) for b in blocks]
    inner = "\n".join(parts)
    if found := numbered(notes, numbers):
        items = "\n".join(f'<li id="fn-{escape_html(key)}">' + inline_html(t.replace("\n", " "), numbers) + "</li>" for _, key, t in found)
        inner += f'\n<section class="footnotes">\n<hr>\n<ol>\n{items}\n</ol>\n</section>'
    title = f"<title>{escape_html(result.title)}</title>\n" if result.title is not None else ""
    page = f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n{title}</head>\n<body>\n{inner}\n</body>\n</html>'
    return with_data_urls(page, result.sections)


def xml(result: Result) -> str:
    attr = lambda name, v: f' {name}="{escape_html(v)}"' if v is not None else ""
    sections = "".join(f'  <section kind="{s.kind}"{attr("title", s.title)}>\n    {escape_html(s.markdown)}\n  </section>\n' for s in result.sections)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<document{attr("title", result.title)}{attr("author", result.author)}>\n{sections}</document>'


def csv_lines(markdown: str) -> list[str]:
    """Tables as records, fenced code as it is, and every other line as a field."""
    lines, out, fenced, at = markdown.split("\n"), [], False, 0
    while at < len(lines):
        bare = lines[at].strip(BLANK)
        if bare.startswith("```"):
            fenced = not fenced
        elif fenced:
            out.append(csv_field(lines[at]))
        elif bare.startswith("|"):
            rows, at = table_run(lines, at)
            out += [",".join(map(csv_field, r)) for r in rows]
            continue
        elif bare:
            out.append(csv_field(inline_plain(bare)))
        at += 1
    return out


def csv(result: Result) -> str:
    shown = (s for s in result.sections if s.kind != "image")
    parts = (s.metadata.get("csv") or "\n".join(csv_lines(s.markdown)) for s in shown)
    return "\n".join(p for p in parts if p)


def render(result: Result, format: str) -> str:
    kinds = {"plaintext": plaintext, "html": html, "xml": xml, "csv": csv, "markdown": Result.markdown}
    if format not in kinds:
        raise ConvertError(UNABLE_TO_EXPORT, format)
    return kinds[format](result)
