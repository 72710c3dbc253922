"""Pages documents and Keynote decks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np

from quire.kernels import iwork_tables as grid
from quire.kernels.docx import destination, label
from quire.kernels.iwa import HYPERLINK, SLIDE, STORAGE, Object, body_text, fields, graph, messages, objects, reference, stream_text, utf8
from quire.kernels.model import BLANK_LINES, DOCUMENT_TYPE_NOT_SUPPORTED, EMPTY_DOCUMENT, FILE_CORRUPTED, ConvertError, Info, Result, Section
from quire.kernels.package import Package, basename
from quire.kernels.rtf import emphasized
from quire.kernels.snappy import Malformed, unpack_stream

_LINES = re.compile("\r\n|[\r\u2028\u2029\x0b\x0c]")
_DROPPED = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffc]")
PLACEHOLDER = 0xFFFC
BEGIN = itemgetter(0)
_STRIPPED = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffc]")
DOCUMENT, INDEX = "Document.iwa", "Index.zip"
#: Fields of a storage that hold runs: styles, attachments, smart fields.
PARAGRAPH_STYLES, CHARACTER_STYLES, ATTACHMENTS, SMART_FIELDS = 5, 8, 9, 11


def tidy_lines(text: str) -> str:
    """Trimmed lines without control characters; runs of empty ones become one."""
    out: list[str] = []
    gap = False
    for raw in _DROPPED.sub("", _LINES.sub("\n", text)).split("\n"):
        line = raw.strip(" \t")
        if line:
            if gap and out:
                out.append("")
            out.append(line)
        gap = not line
    return "\n".join(out)


def components(data: bytes, vital: re.Pattern) -> list[tuple[str, list[Object]]]:
    """Names and objects of a package's streams. A damaged stream is left out, unless its name
    is vital."""
    package = Package(data)
    names = [n for n in package.names() if n.startswith("Index/") and n.endswith(".iwa")]
    if not names and INDEX in package.members:
        package = Package(package.read(INDEX) or b"")
        names = [n for n in package.names() if n.endswith(".iwa")]
    if not names:
        raise ConvertError(DOCUMENT_TYPE_NOT_SUPPORTED)
    out = []
    for n in names:
        try:
            raw = package.read(n)
            if raw is None:
                raise Malformed("member")
            out.append((n, objects(unpack_stream(raw))))
        except Malformed as e:
            if vital.search(n):
                raise ConvertError(FILE_CORRUPTED, n) from e
    return out


# --- styled text ----------------------------------------------------------------------------


def runs(storage: bytes, number: int) -> list[tuple[int, int | None]]:
    """Offsets, in UTF-16 units, with the object that holds from there on (None: none)."""
    out = []
    for wrapper in messages(storage, number):
        for run in messages(wrapper, 1):
            at, who = None, None
            for n, v in fields(run):
                if n == 1 and isinstance(v, int):
                    at = v
                elif n == 2 and isinstance(v, bytes):
                    who = reference(v)
            if at is not None and at < 1 << 63:
                out.append((at, who))
    return sorted(out, key=lambda r: r[0])


def style_of(o: Object) -> tuple[str | None, list[int]]:
    """Name and parents of a style."""
    archive = next(messages(o.payload, 1), b"")
    name, parents = None, []
    for n, v in fields(archive):
        if n == 1 and isinstance(v, bytes):
            name = utf8(v)
        elif n in (3, 5) and isinstance(v, bytes) and (r := reference(v)) is not None:
            parents.append(r)
    return name, parents


def style_name(style: int | None, by_id: dict[int, Object], seen: frozenset[int] = frozenset()) -> str | None:
    if style is None or style in seen or style not in by_id:
        return None
    name, parents = style_of(by_id[style])
    if name is not None:
        return name
    return next((n for p in parents if (n := style_name(p, by_id, seen | {style})) is not None), None)


def traits(style: int, by_id: dict[int, Object], seen: frozenset[int] = frozenset()) -> tuple[bool, bool]:
    """Bold and italic of a character style; what it doesn't say comes from its parents."""
    if style in seen or style not in by_id:
        return False, False
    own = next(messages(by_id[style].payload, 11), b"")
    said: list[bool | None] = [None, None]
    for n, v in fields(own):
        if n in (1, 2) and isinstance(v, int):
            said[n - 1] = bool(v)
    if None in said:
        above = [traits(p, by_id, seen | {style}) for p in style_of(by_id[style])[1]]
        said = [any(a[k] for a in above) if s is None else s for k, s in enumerate(said)]
    return bool(said[0]), bool(said[1])


def heading_level(name: str | None) -> int | None:
    low = (name or "").lower()
    if low.startswith("title"):
        return 1
    if low.startswith("subtitle"):
        return 2
    digits = "".join(c for c in low if c.isdigit())
    return min((int(digits) if digits else 1) + 1, 6) if low.startswith("heading") else None


@dataclass
class Body:
    """A body storage: its UTF-16 units and what holds over them."""

    units: np.ndarray
    by_id: dict[int, Object]
    paragraphs: list[tuple[int, int | None]]
    characters: list[tuple[int, int | None]]
    fields: list[tuple[int, int | None]]
    known: dict[int, tuple[bool, bool]] = field(default_factory=dict)
    urls: dict[int, str | None] = field(default_factory=dict)
    #: How many visible units come before each unit.
    seen: np.ndarray | None = None

    @classmethod
    def of(cls, o: Object, by_id: dict[int, Object]) -> Body | None:
        text = body_text(o.payload)
        if text is None:
            return None
        units = np.frombuffer(text.encode("utf-16-le"), "<u2")
        return cls(units, by_id, *(runs(o.payload, n) for n in (PARAGRAPH_STYLES, CHARACTER_STYLES, SMART_FIELDS)))

    def text(self, lo: int, hi: int) -> str:
        """Units as text, without placeholders and controls; half pairs stay for a neighbour."""
        return _STRIPPED.sub("", self.units[lo:hi].tobytes().decode("utf-16-le", "surrogatepass"))

    @staticmethod
    def holding(found: list[tuple[int, int | None]], at: int) -> int | None:
        """What holds at a unit: the last run that begins at or before it."""
        k = bisect_right(found, at, key=BEGIN)
        return found[k - 1][1] if k else None

    def look(self, at: int, emphasis: bool) -> tuple[str | None, bool, bool]:
        """Link, bold and italic of a unit."""
        style, smart = self.holding(self.characters, at) if emphasis else None, self.holding(self.fields, at)
        if style is not None and style not in self.known:
            self.known[style] = traits(style, self.by_id)
        if smart is not None and smart not in self.urls:
            o = self.by_id.get(smart)
            raw = next(messages(o.payload, 2), None) if o is not None and o.type == HYPERLINK else None
            self.urls[smart] = utf8(raw) if raw is not None else None
        return (self.urls[smart] if smart is not None else None, *(self.known[style] if style is not None else (False, False)))

    def inline(self, lo: int, hi: int, emphasis: bool = True) -> str:
        begins = {at for found in (self.characters, self.fields) for at, _ in found[bisect_right(found, lo, key=BEGIN) : bisect_left(found, hi, key=BEGIN)]}
        cuts = [lo, *sorted(begins), hi]
        pieces: list[list] = []  # link, bold, italic, text
        for a, b in zip(cuts, cuts[1:]):
            if text := self.text(a, b):
                own = self.look(a, emphasis)
                if pieces and tuple(pieces[-1][:3]) == own:
                    pieces[-1][3] += text
                else:
                    pieces.append([*own, text])
        out: list[list] = []  # link, text
        for url, bold, italic, text in pieces:
            text = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            text = emphasized(text, bold, italic) if text.strip(" \t") else text
            if out and out[-1][0] == url:
                out[-1][1] += text
            else:
                out.append([url, text])
        return "".join(f"[{label(t)}]({destination(url)})" if url is not None and t else t for url, t in out).strip(BLANK_LINES)

    def paragraph_style(self, lo: int, hi: int) -> int | None:
        """The style of most visible units; of equal ones the first."""
        best, most, size = None, 0, len(self.units)
        if self.seen is None:
            u = self.units
            hidden = (u < 0x20) & (u != 0x09) & (u != 0x0A) | (u >= 0x7F) & (u <= 0x9F) | (u == PLACEHOLDER)
            self.seen = np.concatenate([[0], np.cumsum(~hidden)])
        for k in range(max(0, bisect_right(self.paragraphs, lo, key=BEGIN) - 1), len(self.paragraphs)):
            begin, who = self.paragraphs[k]
            if begin >= hi:
                break
            end = min(hi, self.paragraphs[k + 1][0] if k + 1 < len(self.paragraphs) else size, size)
            if who is not None and end > max(lo, begin) and (seen := int(self.seen[end] - self.seen[max(lo, begin)])) > most:
                best, most = who, seen
        return best

    def paragraph(self, lo: int, hi: int) -> str:
        level = heading_level(style_name(self.paragraph_style(lo, hi), self.by_id)) if self.paragraphs else None
        text = self.inline(lo, hi, emphasis=level is None)
        return "#" * level + " " + " ".join(text.split()) if level and text else text

    def markdown(self, lo: int, hi: int) -> str:
        u = self.units[lo:hi]
        cuts = (lo + np.flatnonzero((u == 0x0A) | (u == 0x0D) | (u == 0x2029))).tolist() + [hi]
        parts = (self.paragraph(a, b) for a, b in zip([lo, *(c + 1 for c in cuts)], cuts))
        return "\n\n".join(p for p in parts if p)


def bodies(stream: list[Object], by_id: dict[int, Object]) -> list[tuple[Object, Body]]:
    return [(o, b) for o in stream if o.type == STORAGE and (b := Body.of(o, by_id)) is not None]


def inline_blocks(stream: list[Object], by_id: dict[int, Object]) -> list[tuple[str, str]] | None:
    """Text and tables in reading order; None where tables can't all be placed, as when
    placeholders and attachments don't match one to one."""
    found = grid.tables(by_id)
    out: list[tuple[str, str]] = []
    placed: set[int] = set()
    for o, body in bodies(stream, by_id):
        attached = [(at, who) for at, who in runs(o.payload, ATTACHMENTS) if who is not None]
        marks = np.flatnonzero(body.units == PLACEHOLDER).tolist()
        if len(marks) != len(attached):
            return None
        begin = 0
        for mark, (_, who) in zip(marks, attached):
            near = grid.reachable(who, by_id, found, grid.ATTACHMENT_STEPS)
            if near:
                out += [("body", body.markdown(begin, mark)), ("table", found[near[0]])]
                placed.add(near[0])
                begin = mark + 1
        out.append(("body", body.markdown(begin, len(body.units))))
    return [x for x in out if x[1]] if placed == set(found) else None


def convert_pages(data: bytes, info: Info) -> Result:
    streams = components(data, re.compile(f"{re.escape(DOCUMENT)}$"))
    by_id = graph(s for _, s in streams)
    main = next((s for n, s in reversed(streams) if n.endswith(DOCUMENT)), None)
    blocks = inline_blocks(main, by_id) if main is not None else None
    if blocks is None:
        if main is not None:
            text = "\n\n".join(t for _, b in bodies(main, by_id) if (t := b.markdown(0, len(b.units)))) or stream_text(main)
        else:
            text = next((t for _, s in sorted(streams, key=lambda x: x[0]) if (t := stream_text(s))), "")
        blocks = [("body", text), *(("table", t) for _, t in sorted(grid.tables(by_id).items()))]
    sections = []
    for kind, text in blocks:
        text = tidy_lines(text) if kind == "body" else text
        if text:
            sections.append(Section(kind, text, source_path="Index/Document.iwa" if kind == "body" else "Index/Tables"))
    if not sections:
        raise ConvertError(EMPTY_DOCUMENT)
    return Result(sections, title=info.filename or None)


# --- Keynote --------------------------------------------------------------------------------


def is_slide(path: str) -> bool:
    name = basename(path)
    return name.startswith("Slide") and name.endswith(".iwa")


def is_master(path: str) -> bool:
    return basename(path).startswith(("MasterSlide", "TemplateSlide"))


def slide_number(path: str) -> int:
    m = re.search("[0-9]+", basename(path))
    return int(m[0]) if m else 1 << 63


def deck_order(document: list[Object] | None, slides: set[int]) -> list[int]:
    """Slides in the order in which the object that refers to most slide nodes lists them."""
    found = document or []
    node: dict[int, int] = {}
    for o in found:
        first = next((r for r in o.references if r in slides), None)
        if first is not None:
            node[o.id] = first
    lists = ([r for r in o.references if r in node] for o in found)
    return [node[r] for r in max(lists, key=len, default=[])]


def convert_keynote(data: bytes, info: Info) -> Result:
    streams = components(data, re.compile(r"(?:^|/)Slide[^/]*\.iwa$"))
    decks = [(n, s) for n, s in streams if is_slide(n)]
    slides = [(n, next((o.id for o in found if o.type == SLIDE), 0), tidy_lines(stream_text(found))) for n, found in decks]
    document = next((s for n, s in streams if n.endswith(DOCUMENT)), None)
    rank: dict[int, int] = {}
    for k, i in enumerate(deck_order(document, {i for _, i, _ in slides})):
        rank.setdefault(i, k)
    slides.sort(key=lambda s: (rank.get(s[1], 1 << 63), s[1], slide_number(s[0]), s[0]))
    masters = {o.id for n, s in streams if is_master(n) for o in s}
    owned = grid.tables_by_slide([i for _, i, _ in slides], graph(s for _, s in streams), masters)
    sections = []
    for k, (name, i, text) in enumerate(slides, 1):
        if text:
            sections.append(Section("slide", text, source_path=name, slide_number=k))
        sections += [Section("table", t, source_path=name, slide_number=k) for t in owned.get(i, ())]
    if not any(s.kind == "slide" for s in sections):
        rest = sorted(((n, s) for n, s in streams if not is_master(n)), key=lambda x: x[0])
        text = tidy_lines("\n\n".join(t for _, s in rest if (t := stream_text(s))))
        if text:
            sections.insert(0, Section("body", text))
    if not sections:
        raise ConvertError(EMPTY_DOCUMENT)
    return Result(sections, title=info.filename or None)
