"""Walking the bytes of a Part-10 file, with the standard library alone: elements, nesting, and the lengths that headers declare.

Parsing is lenient: a value cut off by the end of the file is what remains of it; without ``DICM`` at byte 128 the
data set is taken to start at byte 0 in Implicit VR Little Endian; ``error`` is set only where nothing can
be read (no bytes, or a deflated body that doesn't inflate). Nothing is ever allocated from a declared length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile
from typing import NamedTuple

from scanlake.dims import DEFLATED_LE, DEPTH_CAP, EXPLICIT_BE, FREE_TEXT_TAGS, IMPLICIT_LE, LONG_VRS, MAX_ELEMENTS, PROFILE_TAGS, UNDEFINED_LENGTH, VALID_VRS

#: Inflated bytes of a deflated data set that are read at most; a data set that holds more is a parse error.
INFLATE_CAP = 256 * 1024**2

# --- fixed values: attributes that rules read besides the profile and free-text tags: tag, keyword, VR ---
ATTRIBUTES: list[tuple[int, int, str, str]] = [
    (0x0008, 0x0016, "SOPClassUID", "UI"),
    (0x0008, 0x0018, "SOPInstanceUID", "UI"),
    (0x0008, 0x0020, "StudyDate", "DA"),
    (0x0008, 0x0021, "SeriesDate", "DA"),
    (0x0008, 0x0022, "AcquisitionDate", "DA"),
    (0x0008, 0x0023, "ContentDate", "DA"),
    (0x0008, 0x0060, "Modality", "CS"),
    (0x0008, 0x0070, "Manufacturer", "LO"),
    (0x0008, 0x1090, "ManufacturerModelName", "LO"),
    (0x0018, 0x0015, "BodyPartExamined", "CS"),
    (0x0018, 0x0050, "SliceThickness", "DS"),
    (0x0020, 0x000D, "StudyInstanceUID", "UI"),
    (0x0020, 0x000E, "SeriesInstanceUID", "UI"),
    (0x0020, 0x0032, "ImagePositionPatient", "DS"),
    (0x0028, 0x0002, "SamplesPerPixel", "US"),
    (0x0028, 0x0004, "PhotometricInterpretation", "CS"),
    (0x0028, 0x0006, "PlanarConfiguration", "US"),
    (0x0028, 0x0008, "NumberOfFrames", "IS"),
    (0x0028, 0x0010, "Rows", "US"),
    (0x0028, 0x0011, "Columns", "US"),
    (0x0028, 0x0100, "BitsAllocated", "US"),
    (0x0028, 0x0101, "BitsStored", "US"),
    (0x0028, 0x0103, "PixelRepresentation", "US"),
    (0x0028, 0x0301, "BurnedInAnnotation", "CS"),
]
KEYWORDS = {(g, e): k for g, e, k, *_ in (*PROFILE_TAGS, *FREE_TEXT_TAGS, *ATTRIBUTES)}
TAGS = {k: t for t, k in KEYWORDS.items()}
IMPLICIT_VR = {(g, e): "LO" for g, e, *_ in (*PROFILE_TAGS, *FREE_TEXT_TAGS)} | {(g, e): vr for g, e, _, vr in ATTRIBUTES} | {(0x0040, 0xA730): "SQ", (0x7FE0, 0x0010): "OW"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
_TEXT_VRS = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
_LONG = {v.encode() for v in LONG_VRS}
_VALID = {v.encode() for v in VALID_VRS}
PIXELS = (0x7FE0, 0x0010)


@dataclass(slots=True)
class Element:
    """One element; ``value`` is its bytes, or the fragments of encapsulated pixels; ``items`` those of a sequence."""

    tag: tuple[int, int]
    vr: str
    value: bytes | list[bytes]
    path: tuple[str, ...] = ()
    items: list[list["Element"]] | None = None
    le: bool = True

    def text(self) -> str | None:
        """The value as text: numbers joined by backslashes, strings without padding; null for opaque bytes."""
        if self.items is not None or isinstance(self.value, list):
            return None
        if self.vr in NUMBERS:
            size = struct.calcsize(NUMBERS[self.vr])
            n = len(self.value) // size
            return "\\".join(map(str, struct.unpack(("<" if self.le else ">") + NUMBERS[self.vr] * n, self.value[: n * size])))
        if self.vr in _TEXT_VRS:
            raw = self.value.rstrip(b"\0 ") if self.vr != "UI" else self.value.strip(b"\0 ")
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                return raw.decode("latin-1")
        return None


@dataclass
class Parsed:
    """A data set: transfer syntax (null without one), meta and top-level elements, nesting depth, error."""

    syntax: str | None = None
    meta: list[Element] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    depth: int = 0
    error: str | None = None

    def get(self, keyword: str) -> Element | None:
        """The top-level element with this keyword."""
        tag = TAGS[keyword]
        return next((x for x in self.elements if x.tag == tag), None)

    def number(self, keyword: str, default: int) -> int:
        """An integer attribute, or ``default`` where it is missing or no integer."""
        try:
            return int((x.text() if (x := self.get(keyword)) else None).split("\\")[0])
        except (AttributeError, ValueError):
            return default


def _header(data: bytes, off: int, implicit: bool, le: bool) -> tuple[tuple[int, int], str | None, int, int] | None:
    """(tag, VR or null if implicit, length, value's offset) at ``off``; null where it doesn't fit."""
    e = "<" if le else ">"
    if off + 8 > len(data):
        return None
    tag = struct.unpack_from(e + "HH", data, off)
    if implicit or tag[0] == 0xFFFE:
        return tag, None, struct.unpack_from(e + "I", data, off + 4)[0], off + 8
    vr = data[off + 4 : off + 6]
    if vr in _LONG:
        return (tag, vr.decode("latin-1"), struct.unpack_from(e + "I", data, off + 8)[0], off + 12) if off + 12 <= len(data) else None
    return tag, vr.decode("latin-1"), struct.unpack_from(e + "H", data, off + 6)[0], off + 8


class Header(NamedTuple):
    """What stands before a value: where, tag, VR (null if implicit), declared length, and where the value starts."""

    offset: int
    tag: tuple[int, int]
    vr: str | None
    length: int
    value: int

    @property
    def end(self) -> int:
        """Where the next header is looked for; a value of undefined length counts as empty."""
        return self.value + (0 if self.length == UNDEFINED_LENGTH else self.length)


def headers(data: bytes, off: int, implicit: bool, le: bool) -> Iterator[Header]:
    """Headers one behind the other from ``off``, until one doesn't fit into the file."""
    while read := _header(data, off, implicit, le):
        yield (here := Header(off, *read))
        off = here.end


def file_meta(data: bytes) -> list[Header]:
    """Headers of the file meta group behind ``DICM``; it is always Explicit VR Little Endian."""
    return list(takewhile(lambda h: h.tag[0] == 0x0002, headers(data, 132, False, True)))


def _syntax(data: bytes, meta: list[Header]) -> str | None:
    named = [data[h.value : h.end] for h in meta if h.tag == (0x0002, 0x0010)]
    return named[-1].rstrip(b"\0 ").decode("ascii", "ignore") if named else None


class _Walk:
    """Reads nested elements, all that there are; counts depth and stops at its cap."""

    def __init__(self, data: bytes, implicit: bool, le: bool) -> None:
        self.data, self.implicit, self.le, self.depth = data, implicit, le, 0

    def elements(self, off: int, end: int, depth: int, path: tuple[str, ...], until: int | None = None) -> tuple[list[Element], int]:
        """Elements from ``off`` up to ``end``, or to the delimiter ``until``; and where they stop."""
        out: list[Element] = []
        self.depth = max(self.depth, depth)
        while off < end:
            head = _header(self.data, off, self.implicit, self.le)
            if head is None:
                return out, end
            tag, vr, length, at = head
            if tag[0] == 0xFFFE:
                if tag[1] == until:
                    return out, at
                off = at
                continue
            if vr is None:
                # without a VR, an unknown value that begins with an item is taken for a sequence
                item = length == UNDEFINED_LENGTH or (length >= 8 and self.data[at : at + 4] == (b"\xfe\xff\x00\xe0" if self.le else b"\xff\xfe\xe0\x00"))
                vr = IMPLICIT_VR.get(tag, "SQ" if item else "UN")
            elif vr.encode("latin-1") not in _VALID:
                return out, end  # the walk has lost its place
            name = f"({tag[0]:04X},{tag[1]:04X})"
            if tag == PIXELS and length == UNDEFINED_LENGTH:
                fragments, off = self.fragments(at, end)
                out.append(Element(tag, vr, fragments, path, le=self.le))
            elif vr == "SQ" or length == UNDEFINED_LENGTH:
                items, off = self.items(at, end if length == UNDEFINED_LENGTH else min(end, at + length), depth, (*path, name), length == UNDEFINED_LENGTH)
                out.append(Element(tag, "SQ", b"", path, items, self.le))
            else:
                out.append(Element(tag, vr, self.data[at : min(end, at + length)], path, le=self.le))
                off = at + length
        return out, off

    def items(self, off: int, end: int, depth: int, path: tuple[str, ...], delimited: bool) -> tuple[list[list[Element]], int]:
        """Items of a sequence."""
        out: list[list[Element]] = []
        while off < end:
            head = _header(self.data, off, self.implicit, self.le)
            if head is None:
                return out, end
            tag, _, length, at = head
            if tag != (0xFFFE, 0xE000):
                return out, at if delimited and tag == (0xFFFE, 0xE0DD) else (end if not delimited else off)
            if depth + 1 > DEPTH_CAP:
                self.depth = max(self.depth, depth + 1)
                return out, end
            stop = end if length == UNDEFINED_LENGTH else min(end, at + length)
            item, after = self.elements(at, stop, depth + 1, path, 0xE00D if length == UNDEFINED_LENGTH else None)
            out.append(item)
            off = after if length == UNDEFINED_LENGTH else stop
        return out, off

    def fragments(self, off: int, end: int) -> tuple[list[bytes], int]:
        """Fragments of encapsulated pixels; the first is the offset table."""
        out: list[bytes] = []
        while head := _header(self.data, off, True, self.le):
            tag, _, length, at = head
            if tag != (0xFFFE, 0xE000):
                return out, at
            out.append(self.data[at : min(end, at + length)])
            off = at + length
        return out, end


def parse(data: bytes) -> Parsed:
    """A file's bytes to its elements."""
    if not data:
        return Parsed(error="no bytes")
    out, off, body = Parsed(), 0, data
    if data[128:132] == b"DICM":
        meta = file_meta(data)
        out.meta = [Element(h.tag, h.vr, data[h.value : h.end]) for h in meta]
        out.syntax, off = _syntax(data, meta), meta[-1].end if meta else 132
    if out.syntax == DEFLATED_LE:
        try:
            inflate = zlib.decompressobj(-15)
            body, off = inflate.decompress(data[off:], INFLATE_CAP), 0
            if inflate.unconsumed_tail:
                raise zlib.error("it inflates beyond the cap")
        except zlib.error as e:
            out.error = f"deflated data set: {e}"
            return out
    walk = _Walk(body, out.syntax in (None, IMPLICIT_LE), out.syntax != EXPLICIT_BE)
    out.elements, _ = walk.elements(off, len(body), 0, ())
    out.depth = walk.depth
    return out


def length_walk(data: bytes) -> tuple[str, int, int, int]:
    """(state, offset, declared, remaining): what the declared lengths of the outer elements come to.

    ``absent``: no Part-10 file; ``meta_bomb``, ``bomb``: an element of the meta group, of the data set declares more than there is;
    ``unresolved``: the meta group breaks off within a header; ``deflated``: the lengths can't be seen; ``mismatch``: no VR where
    one must be; ``ok``: none of these up to the first undefined length, a header cut off, or the cap on elements.
    """
    if data[128:132] != b"DICM":
        return "absent", 0, 0, 0


    def beyond(state: str, hs: Iterable[Header]) -> tuple[str, int, int, int] | None:
        return next(((state, h.offset, h.length, len(data) - h.value) for h in hs if h.end > len(data)), None)

    meta = file_meta(data)
    if bomb := beyond("meta_bomb", meta):
        return bomb
    start = meta[-1].end if meta else 132
    if data[start : start + 2] == b"\2\0" and start + 8 <= len(data):
        return "unresolved", start, 0, 0
    syntax = _syntax(data, meta)
    if syntax == DEFLATED_LE:
        return "deflated", start, 0, 0
    implicit = not meta or syntax == IMPLICIT_LE
    named = lambda h: implicit or (h.vr or "").encode("latin-1") in _VALID
    outer = list(islice(headers(data, start, implicit, syntax != EXPLICIT_BE), MAX_ELEMENTS))
    # what comes first decides: an element without a VR, or one of undefined length, ends what can be checked
    checked = list(takewhile(lambda h: named(h) and h.length != UNDEFINED_LENGTH, outer))
    if bomb := beyond("bomb", checked):
        return bomb
    if len(checked) < len(outer) and not named(outer[len(checked)]):
        return "mismatch", outer[len(checked)].offset, 0, 0
    return "ok", checked[-1].end if checked else start, 0, 0
