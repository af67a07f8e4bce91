"""Writing Part-10 files: elements to bytes, for rebuilt copies and for fixtures."""

from __future__ import annotations

import struct
import zlib

from scanlake.dims import DEFLATED_LE, EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE, LONG_VRS, UNDEFINED_LENGTH
from scanlake.sources.walker import ATTRIBUTES, NUMBERS, TAGS, Element

_VR_OF = {k: vr for _, _, k, vr in ATTRIBUTES} | {
    "PatientName": "PN", "ReferringPhysicianName": "PN", "OperatorsName": "PN", "PatientBirthDate": "DA", "PatientSex": "CS", "PatientAge": "AS", "AccessionNumber": "SH", "StationName": "SH",
    "PatientComments": "LT", "ImageComments": "LT", "AdditionalPatientHistory": "LT", "StudyID": "SH",
}


def element(key: str | tuple[int, int], value, vr: str | None = None, le: bool = True) -> Element:
    """An element from a keyword or a tag and a Python value: text, number(s), bytes, or items (lists of elements)."""
    tag = TAGS[key] if isinstance(key, str) else key
    vr = vr or (_VR_OF.get(key, "LO") if isinstance(key, str) else "LO")
    if vr == "SQ":
        return Element(tag, vr, b"", (), list(value), le)
    if isinstance(value, list) and value and isinstance(value[0], bytes):
        return Element(tag, vr, value, (), None, le)  # fragments
    if vr in NUMBERS:
        values = value if isinstance(value, (list, tuple)) else [value]
        raw = struct.pack(("<" if le else ">") + NUMBERS[vr] * len(values), *values)
    elif isinstance(value, bytes):
        raw = value
    else:
        raw = ("\\".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)).encode()
    if len(raw) % 2:
        raw += b"\0" if vr in ("UI", "OB", "UN") else b" "
    return Element(tag, vr, raw, (), None, le)


def encode(x: Element, implicit: bool = False, le: bool = True, declared: int | None = None) -> bytes:
    """One element as bytes; ``declared`` writes another length than the true one."""
    e = "<" if le else ">"
    head = struct.pack(e + "HH", *x.tag)
    if x.items is not None:
        body = b"".join(struct.pack(e + "HHI", 0xFFFE, 0xE000, len(i)) + i for i in (b"".join(encode(y, implicit, le) for y in item) for item in x.items))
    elif isinstance(x.value, list):
        fragments = b"".join(struct.pack(e + "HHI", 0xFFFE, 0xE000, len(f)) + f for f in x.value)
        body, declared = fragments + struct.pack(e + "HHI", 0xFFFE, 0xE0DD, 0), UNDEFINED_LENGTH
    else:
        body = x.value
    length = len(body) if declared is None else declared
    if implicit:
        return head + struct.pack(e + "I", length) + body
    if x.vr in LONG_VRS:
        return head + x.vr.encode() + b"\0\0" + struct.pack(e + "I", length) + body
    if length > 0xFFFF:  # a short form can't state it
        return head + b"UN\0\0" + struct.pack(e + "I", length) + body
    return head + x.vr.encode() + struct.pack(e + "H", length) + body


def data_set(elements: list[Element], syntax: str = EXPLICIT_LE) -> bytes:
    """Elements in tag order as the body of a file."""
    body = b"".join(encode(x, syntax == IMPLICIT_LE, syntax != EXPLICIT_BE) for x in sorted(elements, key=lambda x: x.tag))
    if syntax == DEFLATED_LE:
        squeeze = zlib.compressobj(wbits=-15)
        body = squeeze.compress(body) + squeeze.flush()
    return body


def part10(body: bytes, syntax: str | None = EXPLICIT_LE, preamble: bytes = b"", magic: bytes = b"DICM", sop_class: str = "1.2.840.10008.5.1.4.1.1.2", sop_instance: str = "1.2.3.4") -> bytes:
    """A file from its body; without a syntax there is no file meta group."""
    meta = b""
    if syntax is not None:
        xs = [element((2, 2), sop_class, "UI"), element((2, 3), sop_instance, "UI"), element((2, 0x10), syntax, "UI")]
        meta = b"".join(map(encode, xs))
        meta = encode(element((2, 0), len(meta), "UL")) + meta
    return preamble.ljust(128, b"\0")[:128] + magic + meta + body
