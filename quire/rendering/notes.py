"""Footnotes: definitions taken out of the text, and numbers by first reference."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quire.kernels.model import BLANK, BLANK_LINES
from quire.rendering.blocks import Block
from quire.rendering.inline import references

_DEFINITION = re.compile(r" {0,3}\[\^([^\]]+)\]: ?(.*)", re.S)


@dataclass
class Note:
    id: str
    text: str


def continuation(line: str) -> str | None:
    """What of a line goes on with a note: indented by four blanks or a tab."""
    for indent in ("    ", "\t"):
        if line.startswith(indent):
            return line.removeprefix(indent)
    return None


def split_notes(markdown: str) -> tuple[str, list[Note]]:
    """The text without definitions, and these; fenced code is left alone. A blank line goes
    on with a note only before an indented one."""
    lines, body, notes = markdown.split("\n"), [], []
    fenced, at = False, 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.strip(BLANK).startswith("```"):
            fenced = not fenced
        m = None if fenced else _DEFINITION.fullmatch(line)
        if m is None:
            body.append(line)
            continue
        own = [m[2]]
        while at < len(lines):
            more, ahead = continuation(lines[at]), at
            while more is None and ahead < len(lines) and not lines[ahead].strip(BLANK):
                ahead += 1
            if more is None and (ahead == at or ahead == len(lines) or continuation(lines[ahead]) is None):
                break
            own.append(more or "")
            at += 1
        notes.append(Note(m[1], "\n".join(own)))
    return "\n".join(body).strip(BLANK_LINES), notes


def first_definitions(notes: list[Note]) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in notes:
        out.setdefault(n.id, n.text)
    return out


def number_notes(blocks: list[Block], notes: list[Note]) -> dict[str, int]:
    """Numbers in the order of references in the text, then of those in numbered notes."""
    defined = first_definitions(notes)
    numbers: dict[str, int] = {}
    open_ = [t for b in blocks for t in b.inline()]
    for text in open_:  # grows by the texts of notes that get a number
        for key in references(text):
            if key in defined and key not in numbers:
                numbers[key] = len(numbers) + 1
                open_.append(defined[key])
    return numbers


def numbered(notes: list[Note], numbers: dict[str, int]) -> list[tuple[int, str, str]]:
    defined = first_definitions(notes)
    return sorted((n, key, defined[key]) for key, n in numbers.items())
