"""The Markdown subset of sections as blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.kernels.model import BLANK

_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_BULLET = re.compile(r"[-*+] (.*)", re.S)
_CELL = re.compile(r"((?:[^\\|]|\\.|\\\Z)*)(\||\Z)", re.S)
RULES = ("---", "***", "___")


@dataclass
class Block:
    """kind is heading, paragraph, code, quote, list, table or rule; parts are its lines,
    items, or the one text that it has."""

    kind: str
    parts: list[str] = field(default_factory=list)
    level: int = 0
    ordered: bool = False
    rows: list[list[str]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return self.parts[0] if self.parts else ""

    def inline(self) -> list[str]:
        """The texts in which inline marks count, in order."""
        if self.kind in ("code", "rule"):
            return []
        return [c for r in self.rows for c in r] if self.kind == "table" else self.parts


def heading(line: str) -> tuple[int, str] | None:
    m = _HEADING.fullmatch(line)
    return (len(m[1]), m[2].strip(BLANK)) if m else None


def item(line: str) -> tuple[bool, str] | None:
    """Whether an item's list is ordered, and the item's text."""
    if m := _BULLET.fullmatch(line):
        return False, m[1]
    digits = 0
    while digits < len(line) and line[digits].isnumeric():
        digits += 1
    if digits and line.startswith(". ", digits):
        return True, line[digits + 1 :].strip(BLANK)
    return None


def unescaped(cell: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", cell)


def table_cells(line: str) -> list[str]:
    """The cells of a row, still escaped; pipes after a backslash don't part them."""
    line = line.strip(BLANK).removeprefix("|")
    if line.endswith("|"):
        before = line[:-1]
        if (len(before) - len(before.rstrip("\\"))) % 2 == 0:
            line = before
    cells, at = [], 0
    while True:
        m = _CELL.match(line, at)
        cells.append(m[1].strip(BLANK))
        at = m.end()
        if not m[2]:
            return cells


def is_separator(cells: list[str]) -> bool:
    return bool(cells) and all(c.strip(BLANK) and not c.strip(BLANK).strip("-:") for c in cells)


def table_run(lines: list[str], at: int) -> tuple[list[list[str]], int]:
    """The rows of the table that begins at a line, without the separator in second place."""
    rows, n = [], 0
    while at < len(lines) and lines[at].strip(BLANK).startswith("|"):
        cells = [unescaped(c) for c in table_cells(lines[at])]
        if n != 1 or not is_separator(cells):
            rows.append(cells)
        n += 1
        at += 1
    return rows, at


def ends_paragraph(bare: str) -> bool:
    return not bare or bare.startswith(("```", "|", ">")) or bare in RULES[:2] or heading(bare) is not None or item(bare) is not None


def parse_blocks(markdown: str) -> list[Block]:
    lines = markdown.split("\n")
    out: list[Block] = []
    at = 0
    while at < len(lines):
        bare = lines[at].strip(BLANK)
        begin = at
        if not bare:
            at += 1
        elif bare.startswith("```"):
            at += 1
            while at < len(lines) and not lines[at].strip(BLANK).startswith("```"):
                at += 1
            out.append(Block("code", ["\n".join(lines[begin + 1 : at])]))
            at += 1
        elif bare in RULES:
            out.append(Block("rule"))
            at += 1
        elif found := heading(bare):
            out.append(Block("heading", [found[1]], level=found[0]))
            at += 1
        elif bare.startswith("|"):
            rows, at = table_run(lines, at)
            if rows:
                out.append(Block("table", rows=rows))
        elif bare.startswith(">"):
            while at < len(lines) and lines[at].strip(BLANK).startswith(">"):
                at += 1
            out.append(Block("quote", [x.strip(BLANK)[1:].removeprefix(" ") for x in lines[begin:at]]))
        elif first := item(bare):
            block = Block("list", ordered=first[0])
            while at < len(lines):
                line, own = lines[at].strip(BLANK), item(lines[at].strip(BLANK))
                if own and own[0] == first[0]:
                    block.parts.append(own[1])
                elif line and lines[at].startswith("  "):
                    block.parts[-1] += "\n" + line
                else:
                    break
                at += 1
            out.append(block)
        else:
            while at < len(lines) and not ends_paragraph(lines[at].strip(BLANK)):
                at += 1
            out.append(Block("paragraph", ["\n".join(lines[begin:at])]))
    return out
