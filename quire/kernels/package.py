"""Zip packages and their XML parts."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape, unescape
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.parsers import expat

from quire.kernels.html_tokens import END, START, TEXT, Scanner
from quire.kernels.model import FILE_CORRUPTED, LARGEST_MEMBER, ConvertError


class XmlNode:
    """An element with its prefixed name; children in order, text among them."""

    __slots__ = ("name", "low", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: XmlNode | None) -> None:
        self.name, self.low, self.attrs, self.parent = name, name.lower(), attrs, parent
        self.children: list[XmlNode | str] = []

    def elements(self) -> list[XmlNode]:
        return [c for c in self.children if type(c) is XmlNode]

    def all(self, name: str) -> Iterator[XmlNode]:
        """This element and those below it that have the name, in document order; names are
        compared without regard to case."""
        want, open_ = name.lower(), [self]
        while open_:
            e = open_.pop()
            if e.low == want:
                yield e
            if e.children:
                open_ += [c for c in reversed(e.children) if type(c) is XmlNode]

    def first(self, name: str) -> XmlNode | None:
        for e in self.all(name):
            return e
        return None

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def above(self) -> Iterator[XmlNode]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def text(self) -> str:
        """All text below, with white space made single."""
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                open_ += x.children[::-1]
        return " ".join("".join(out).split())


def decode_part(data: bytes) -> str:
    for name in ("utf-8", "utf-16"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\]\s*)?>", re.I)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")


class TreeBuilder:
    """Makes a tree below a nameless root from events."""

    def __init__(self) -> None:
        self.root = XmlNode("", {}, None)
        self.open = [self.root]
        self.run: list[str] = []

    def settle(self) -> None:
        if self.run:
            self.open[-1].children.append("".join(self.run))
            self.run.clear()

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self.settle()
        e = XmlNode(name, attrs, self.open[-1])
        self.open[-1].children.append(e)
        self.open.append(e)

    def end(self, name: str) -> None:
        """Closes the innermost open element of the name, with those inside it, if there's one."""
        self.settle()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                del self.open[k:]
                return


def lenient_xml(text: str) -> XmlNode:
    """The tree of XML that isn't well-formed: unknown entities stay as they are, stray end tags
    are left out, unclosed elements end with their parents. Names are as written."""
    text = _CDATA.sub(lambda m: escape(m[1]), _DOCTYPE.sub("", text))
    made = TreeBuilder()
    for kind, value, raw in Scanner(text):
        if kind == TEXT:
            made.run.append(unescape(value))
        elif kind == END:
            made.end(value)
        elif kind == START:
            attrs: dict[str, str] = {}
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                attrs.setdefault(name, unescape(a or b or c))
            closed = raw.endswith("/") or value.endswith("/")
            made.start(value.rstrip("/"), attrs)
            if closed:
                made.open.pop()
    made.settle()
    return made.root


def parse_xml(data: bytes) -> XmlNode:
    """The tree below a nameless root. XML with a fault is read again leniently, so that what
    comes after the fault isn't lost. A document that declares entities isn't read: its tree is
    empty, which its converter reports."""
    made = TreeBuilder()

    def refuse(*_: object) -> None:
        raise ValueError("entities are declared")

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = made.start, made.end, made.run.append
    p.EntityDeclHandler = refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        return lenient_xml(decode_part(data))
    except ValueError:
        return XmlNode("", {}, None)
    return made.root


def as_elements(root: XmlNode) -> ElementTree.Element:
    """A tree in native elements."""
    made, open_ = ElementTree.TreeBuilder(), [root]
    while open_:
        x = open_.pop()
        if type(x) is XmlNode:
            made.start(x.name, x.attrs)
            open_.append(None)
            open_ += x.children[::-1]
        elif x is None:
            made.end("")
        else:
            made.data(x)
    return made.close()


def parse_elements(data: bytes, names: dict[str, str]) -> ElementTree.Element:
    """What parse_xml reads, as native elements, which are built and searched without Python
    code. Names are compared without regard to case: any that ``names`` has by its lower case
    becomes the value there. The root is the part's own, or a nameless one above it where the
    part has a fault or declares entities."""
    made = ElementTree.TreeBuilder()

    def refuse(*_: object) -> None:
        raise ValueError("entities are declared")

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = made.start, made.end, made.data
    p.EntityDeclHandler = refuse
    try:
        p.Parse(data, True)
        root, found = made.close(), p.intern
    except expat.ExpatError:
        root = as_elements(lenient_xml(decode_part(data)))
        found = {e.tag for e in root.iter()}
    except ValueError:
        return ElementTree.Element("")
    for n in found:
        if (name := names.get(n.lower(), n)) != n:
            for e in list(root.iter(n)):
                e.tag = name
    return root


class LeafReader:
    """Gives each element of a name, with all below it, as soon as it ends, and keeps none: a
    part of many rows takes the memory of one. An element inside another of the name comes with
    that one."""

    def __init__(self, name: str, give: Callable[[XmlNode], None]) -> None:
        self.name, self.give = name, give
        self.made: TreeBuilder | None = None
        self.depth = 0

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if self.made is None:
            if name.lower() != self.name:
                return
            self.made = TreeBuilder()
        self.depth += 1
        self.made.start(name, attrs)

    def end(self, name: str) -> None:
        if self.made is not None:
            self.made.end(name)
            self.depth -= 1
            if not self.depth:
                own, self.made = self.made.root.elements()[0], None
                self.give(own)

    def text(self, text: str) -> None:
        if self.made is not None:
            self.made.run.append(text)


def each_of(data: bytes, name: str, take: Callable[[XmlNode], object]) -> list:
    """What ``take`` makes of each element of the name (lower case), in document order, as
    parse_xml(data).all(name) has them, without a tree of the whole part."""
    out: list = []
    reader = LeafReader(name, lambda e: out.extend(map(take, e.all(name))))

    def refuse(*_: object) -> None:
        raise ValueError("entities are declared")

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = reader.start, reader.end, reader.text
    p.EntityDeclHandler = refuse
    try:
        p.Parse(data, True)
    except expat.ExpatError:
        return [take(e) for e in lenient_xml(decode_part(data)).all(name)]
    except ValueError:
        return []
    return out


class Member(NamedTuple):
    """What a directory says of a member, under the names of zipfile.ZipInfo."""

    filename: str
    flag_bits: int
    compress_type: int
    CRC: int
    compress_size: int
    file_size: int
    header_offset: int

    @property
    def orig_filename(self) -> str:
        return self.filename

    def is_dir(self) -> bool:
        return self.filename.endswith("/")


#: A directory's entry, and the record that ends the directory.
_ENTRY, _END = struct.Struct("<4s2xBx2H4x3L3H8xL"), struct.Struct("<4s4H2LH")
#: The latest version of the format that zipfile reads.
_LATEST = 63


def plain_directory(data: bytes) -> list[Member] | None:
    """The members of an ordinary archive, which ends in its directory and that in its end
    record; None for any other, or one that zipfile may refuse, which is left to zipfile."""
    end = len(data) - _END.size
    if end < 0:
        return None
    mark, *_, size, at, comment = _END.unpack_from(data, end)
    if mark != b"PK\5\6" or comment or at + size != end or data[end - 20 : end - 16] == b"PK\6\7":
        return None
    out = []
    while at < end:
        if end - at < _ENTRY.size:
            return None
        mark, version, flags, method, crc, packed, unpacked, n_name, n_extra, n_comment, header = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        name = data[at : at + n_name]
        at += n_name
        if mark != b"PK\1\2" or version > _LATEST or n_extra or n_comment or at > end or not name.isascii() or b"\0" in name:
            return None
        out.append(Member(name.decode(), flags, method, crc, packed, unpacked, header))
    return out


class Package:
    """A zip archive of which damaged or oversized members count as absent."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.zip: zipfile.ZipFile | None = None
        self.listed = plain_directory(data)
        if self.listed is None:
            try:
                self.zip = zipfile.ZipFile(io.BytesIO(data))
            except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, UnicodeDecodeError) as e:
                raise ConvertError(FILE_CORRUPTED, str(e)) from e
            self.listed = self.zip.infolist()
        self.members = {i.filename: i for i in self.listed}

    def names(self) -> list[str]:
        return [i.filename for i in self.listed if not i.is_dir()]

    def read(self, path: str) -> bytes | None:
        member = self.members.get(path.removeprefix("/"))
        if member is None or member.file_size > LARGEST_MEMBER:
            return None
        if (plain := self.plain(member)) is not None:
            return plain
        try:
            if self.zip is None:
                self.zip = zipfile.ZipFile(io.BytesIO(self.data))
            return self.zip.read(member.filename)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError, KeyError):
            return None

    def plain(self, member: zipfile.ZipInfo | Member) -> bytes | None:
        """An ordinary member, read without zipfile's stream; None for any that isn't ordinary
        or isn't sound, which is left to zipfile."""
        at = member.header_offset
        head = self.data[at : at + 30]
        if len(head) < 30 or head[:4] != b"PK\3\4" or member.flag_bits & 0x61 or member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return None
        begin = at + 30 + int.from_bytes(head[26:28], "little")
        if self.data[at + 30 : begin] != member.orig_filename.encode("utf-8" if member.flag_bits & 0x800 else "cp437", "replace"):
            return None
        begin += int.from_bytes(head[28:30], "little")
        out = self.data[begin : begin + member.compress_size]
        if member.compress_type == zipfile.ZIP_DEFLATED:
            inflate = zlib.decompressobj(-15)
            try:
                out = inflate.decompress(out, member.file_size + 1)
            except zlib.error:
                return None
            if not inflate.eof:
                return None
        return out if len(out) == member.file_size and zlib.crc32(out) == member.CRC else None

    def xml(self, path: str) -> XmlNode | None:
        data = self.read(path)
        return None if data is None else parse_xml(data)

    def elements(self, path: str, names: dict[str, str]) -> ElementTree.Element | None:
        data = self.read(path)
        return None if data is None else parse_elements(data, names)


def folder(path: str) -> str:
    return path.rpartition("/")[0]


def basename(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def resolved(target: str, base: str, percent: bool = False) -> str:
    """A path within a package: absolute with a leading slash, else from a folder."""
    if percent:
        try:
            target = unquote(target, errors="strict")
        except UnicodeDecodeError:
            pass
    out = [] if target.startswith("/") else [p for p in base.split("/") if p]
    for part in target.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)
