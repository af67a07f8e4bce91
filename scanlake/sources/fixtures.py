"""Labelled files built from bytes: boundary sweeps of every rule. All are inert: magic bytes and padding."""

from __future__ import annotations

import random
import struct
from collections.abc import Callable
from dataclasses import dataclass

from scanlake.dims import DEFLATED_LE, EXPLICIT_LE, FRAME_CAP, IMPLICIT_LE, SIGNATURES
from scanlake.sources.walker import TAGS, Element
from scanlake.sources.writer import data_set, element, encode, part10

JPEG2000, H264, HEVC, HTJ2K, JPIP = (IMPLICIT_LE + s for s in (".4.90", ".4.102", ".4.107", ".4.201", ".4.94"))


@dataclass
class Fixture:
    """A file with its label: ``verdict`` is block, warn or clean; ``check`` names the rule that it is about."""

    name: str
    attack_class: str
    verdict: str
    data: bytes
    check: str = ""


def header(**change) -> dict:
    """Attributes of a plain, complete CT slice; ``change`` replaces or, with None, removes."""
    base = {
        "SOPClassUID": "1.2.840.10008.5.1.4.1.1.2", "SOPInstanceUID": "1.2.3.4.7", "StudyDate": "20200102", "SeriesDate": "20200102", "AcquisitionDate": "20200102", "ContentDate": "20200102", "Modality": "CT",
        "Manufacturer": "ACME", "InstitutionName": "General", "StationName": "CT1", "PatientName": "Doe^Jane", "PatientID": "P1", "StudyInstanceUID": "1.2.3.4.5", "SeriesInstanceUID": "1.2.3.4.6",
        "BodyPartExamined": "CHEST", "SamplesPerPixel": 1, "PhotometricInterpretation": "MONOCHROME2", "Rows": 64, "Columns": 64, "BitsAllocated": 16, "BitsStored": 12, "PixelRepresentation": 0,
    }
    return {k: v for k, v in (base | change).items() if v is not None}


def slice_pixels(rows: int = 64, cols: int = 64, seed: int = 0) -> bytes:
    """A smooth image with noise, 12 of 16 bits."""
    rng = random.Random(seed)
    return b"".join(struct.pack("<H", int(1000 + 800 * ((r - rows / 2) ** 2 + (c - cols / 2) ** 2) / (rows * cols) + rng.randrange(200))) for r in range(rows) for c in range(cols))


def plain(syntax: str | None = EXPLICIT_LE, pixels: bytes | list[bytes] | None = b"", more: list[Element] = (), preamble: bytes = b"", **change) -> bytes:
    """A whole file; empty ``pixels`` are those of ``slice_pixels``, None is none."""
    xs = [element(k, v) for k, v in header(**change).items()] + list(more)
    if pixels is not None:
        xs.append(element((0x7FE0, 0x0010), pixels if pixels != b"" else slice_pixels(), "OW"))
    return part10(data_set(xs, syntax or IMPLICIT_LE), syntax, preamble)


def pack_bits(data: bytes) -> bytes:
    """Run-length bytes as literal runs."""
    out = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
    return out + b"\0" * (len(out) % 2)


def rle_frame(pixels: bytes, width: int = 2) -> bytes:
    """Little-endian samples of one channel as an RLE frame."""
    segments = [pack_bits(pixels[width - 1 - i :: width]) for i in range(width)]
    offsets, at = [], 64
    for s in segments:
        offsets.append(at)
        at += len(s)
    return struct.pack("<16I", width, *offsets, *[0] * (15 - width)) + b"".join(segments)


def nested(levels: int) -> Element:
    """Sequences within sequences, ``levels`` + 1 deep."""
    inner: list[Element] = [element((0x0008, 0x0104), "leaf", "LO")]
    for _ in range(levels + 1):
        inner = [element((0x0008, 0x1140), [inner], "SQ")]
    return inner[0]


def private(value: bytes, creator: str = "UNKNOWN VENDOR", group: int = 0x0009) -> list[Element]:
    """A private block with one opaque element."""
    return [element((group, 0x0010), creator, "LO"), element((group, 0x1001), value, "OB")]


def low_entropy(size: int, distinct: int = 8) -> bytes:
    """Bytes of ``distinct`` values."""
    return bytes(i % distinct for i in range(size))


def opaque(size: int, seed: int = 1) -> bytes:
    """Bytes of high entropy that begin with no signature."""
    return b"\x01" + random.Random(seed).randbytes(size - 1)


def _distinct(n: int) -> bytes:
    return bytes(1 + i % n for i in range(128))


def all_fixtures() -> list[Fixture]:
    """Every family, in a fixed order."""
    out: list[Fixture] = []
    add: Callable[..., None] = lambda *a: out.append(Fixture(*a))
    for i, (sig, _) in enumerate(SIGNATURES):
        add(f"polyglot_{i:02d}.dcm", "polyglot", "block", plain(preamble=sig.ljust(128, b"\0")), "file_preamble")
    for shift in (1, 2, 4):
        add(f"shifted_{shift}.dcm", "preamble_anomaly", "clean", plain(preamble=b"\1" * shift + b"\x7fELF"), "file_preamble")
    for n in (2, 4, 8, 16, 17, 32, 64, 128):
        add(f"high_entropy_{n:03d}.dcm", "preamble_anomaly", "warn" if n > 16 else "clean", plain(preamble=_distinct(n)), "file_preamble")
    add("bad_magic.dcm", "malformed_header", "block", plain()[:128] + b"XXXX" + plain()[132:], "file_preamble")
    body = b"".join(encode(element(k, v)) for k, v in header().items())
    for declared in (66, 80, 4096, 0xFFFFFFF0):
        add(f"length_bomb_{declared}.dcm", "length_bomb", "block", part10(body + encode(element((0x7FE0, 0x0010), b"\0" * 64, "OW"), declared=declared)), "length_amplification")
    add("length_bomb_implicit.dcm", "length_bomb", "block", b"\0" * 128 + b"DICM" + struct.pack("<HHI", 0x7FE0, 0x0010, 0xFFFFFFF0), "length_amplification")
    for declared in (0xFFFFFFF0, 0x00100000):
        bomb = struct.pack("<HH2sHI", 2, 1, b"OB", 0, declared) + b"\0\1"
        add(f"length_bomb_meta_{declared}.dcm", "length_bomb", "block", b"\0" * 128 + b"DICM" + bomb + body, "length_amplification")
    for levels in (3, 8, 9, 10, 12, 20, 50):
        add(f"{'deep_nesting' if levels >= 10 else 'nesting'}_{levels}.dcm", "nesting_bomb", "block" if levels >= 10 else "clean", plain(more=[nested(levels)]), "sequence_depth")
    payloads = [
        ("elf", b"\x7fELF" + b"\0" * 2048, "X", "block"), ("mz", b"MZ" + b"\0" * 30, "X", "block"), ("padded", b"\0" * 100 + b"%PDF" + b"\0" * 60, "X", "block"), ("allowed_elf", b"\x7fELF" + b"\0" * 60, "GEMS_ACQU_01", "block"),
        ("opaque", opaque(4096), "GEMS_ACQU_01", "warn"), ("low", low_entropy(4096), "X", "clean"), ("allowed_small", low_entropy(32), "GEMS_ACQU_01", "clean"), ("allowed_large", low_entropy(3072), "GEMS_ACQU_01", "clean"), ("short", b"MZ\0\0\0\0", "X", "clean"),
    ]
    for name, value, creator, verdict in payloads:
        add(f"{'private_payload' if verdict == 'block' else 'private'}_{name}.dcm", "private_payload", verdict, plain(more=private(value, creator)), "private_tag_payload")
    for side in (4096, 16000, 60000):
        add(f"pixel_dimension_{side}.dcm", "dimension_bomb", "block", plain(pixels=b"\0" * 256, Rows=side, Columns=side), "pixel_dimension_bomb" if side * side * 2 > FRAME_CAP else "pixel_dimensions")
    for side, frames, stored, verdict in ((512, 200_000, 64, "block"), (12_000, 1, 16 * 1024, "block"), (12_000, 1, 512 * 1024, "warn"), (8_000, 3, 1024 * 1024, "warn")):
        name = f"{'pixel_decompress' if verdict == 'block' else 'amplified'}_{side}_{frames}_{stored}.dcm"
        add(name, "decompression_bomb", verdict, plain(JPEG2000, [b"", b"\0" * stored], Rows=side, Columns=side, NumberOfFrames=frames), "pixel_dimension_bomb")
    as_text = lambda **kv: dict(more=[element(TAGS[k], v, "IS") for k, v in kv.items()], **dict.fromkeys(kv))
    for name, change in (("rows", as_text(Rows="9999999999", Columns="9999999999")), ("bits", as_text(BitsAllocated="9" * 18)), ("frames", as_text(NumberOfFrames="99999999999")), ("frames_long", as_text(NumberOfFrames="9" * 400))):
        add(f"header_overflow_{name}.dcm", "dimension_bomb", "block", plain(pixels=b"\0" * 256, **change), "pixel_dimension_bomb")
    add("header_text_frames.dcm", "malformed_header", "warn", plain(**as_text(NumberOfFrames="many")), "check_pixel_dimensions")
    for name, syntax in (("video_h264", H264), ("video_hevc", HEVC), ("htj2k", HTJ2K)):
        add(f"{name}.dcm", "codec_exposure", "warn", plain(syntax, [b"", b"\0" * 64]), "codec_cve")
    add("jpip.dcm", "codec_exposure", "warn", plain(JPIP, None), "codec_cve")
    add("deflated.dcm", "codec_exposure", "warn", plain(DEFLATED_LE), "codec_cve")
    add("plain_explicit.dcm", "benign", "clean", plain())
    add("plain_implicit.dcm", "benign", "clean", plain(IMPLICIT_LE))
    add("plain_big_endian.dcm", "benign", "clean", _big_endian())
    add("plain_rle.dcm", "benign", "clean", plain(IMPLICIT_LE + ".5", [b"", rle_frame(slice_pixels())]))
    add("frames.dcm", "benign", "clean", plain(pixels=slice_pixels() * 3, NumberOfFrames=3))
    add("packed_bits.dcm", "benign", "clean", plain(pixels=b"\x5a" * 512, BitsAllocated=1, BitsStored=1))
    add("private_text.dcm", "benign", "clean", plain(more=[element((0x0009, 0x0010), "GEMS_ACQU_01", "LO"), element((0x0009, 0x1002), "note", "LO")]))
    add("combination_polyglot_bomb.dcm", "combination", "block", plain(preamble=b"MZ", pixels=b"\0" * 256, Rows=60000, Columns=60000))
    add("combination_nested_private.dcm", "combination", "block", plain(more=[nested(12), *private(b"\x7fELF" + b"\0" * 64)]))
    return out


def _big_endian() -> bytes:
    syntax = IMPLICIT_LE + ".2"
    pixels = slice_pixels()
    swapped = bytes(b for i in range(0, len(pixels), 2) for b in (pixels[i + 1], pixels[i]))
    xs = [element(k, v, le=False) for k, v in header().items()] + [element((0x7FE0, 0x0010), swapped, "OW")]
    return part10(data_set(xs, syntax), syntax)


