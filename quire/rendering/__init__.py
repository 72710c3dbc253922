"""Sections as Markdown, plain text, HTML, XML or CSV."""
