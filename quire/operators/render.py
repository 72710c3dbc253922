"""Converted documents as text in one of five formats. Markdown and XML are built-in
expressions; the formats that read Markdown back go through Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_html
from quire.kernels.model import Result, Section
from quire.operators.convert import markdown_of, safe, section_texts
from quire.rendering.formats import FORMATS, render as render_one


def xml_of(title: Column, author: Column, sections: Column) -> Column:
    def attribute(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escape_html(value), F.lit('"'))).otherwise("")

    def section(s: Column) -> Column:
        return F.concat(F.lit('  <section kind="'), s["kind"], F.lit('"'), attribute("title", s["title"]), F.lit(">\n    "), escape_html(s["markdown"]), F.lit("\n  </section>\n"))

    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<document'), attribute("title", title), attribute("author", author), F.lit(">\n"))
    return F.concat(head, F.array_join(F.transform(sections, section), ""), F.lit("</document>"))


def _through_markdown(format: str, title: Column, author: Column, sections: Column) -> Column:
    @F.arrow_udf("string")
    def out(titles: pa.Array, authors: pa.Array, sections: pa.Array) -> pa.Array:
        found = []
        for t, a, own in zip(titles.to_pylist(), authors.to_pylist(), sections.to_pylist()):
            if own is None:
                found.append(None)
                continue
            parts = [Section(s["kind"], s["markdown"] or "", s["title"], s["source_path"], metadata=dict(s["metadata"] or ())) for s in own]
            found.append(safe(render_one(Result(parts, t, a), format)))
        return pa.array(found, pa.string())

    # HTML embeds images, so their metadata counts; the others need just text and CSV.
    return out(title, author, sections)


def render(df: DataFrame, format: str = "markdown") -> DataFrame:
    """df (title, author, sections) with format and output; null where conversion failed."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(FORMATS)}")
    title, author, sections = F.col("title"), F.col("author"), F.col("sections")
    if format == "markdown":
        out = markdown_of(sections)
    elif format == "xml":
        out = xml_of(title, author, sections)
    else:
        out = _through_markdown(format, title, author, sections)
    ok = F.col("error_code").isNull() if "error_code" in df.columns else F.lit(True)
    return df.withColumn("format", F.lit(format)).withColumn("output", F.when(ok, out))


def exported_content(df: DataFrame, format: str = "markdown") -> DataFrame:
    """df with exported_content (array of strings): for Markdown one for each section that
    isn't an image, for other formats one, or none where there's nothing to render."""
    if format == "markdown":
        return df.withColumn("exported_content", section_texts(F.col("sections")))
    return render(df, format).withColumn("exported_content", F.array_compact(F.array("output"))).drop("format", "output")
