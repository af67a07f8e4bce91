"""Decoding of native and run-length pixels, and the process in which files that nobody trusts are decoded.

Nothing here needs Spark: a decoder process loads the standard library and numpy alone.
"""

from __future__ import annotations

import os
import resource
import sys
from typing import BinaryIO

import numpy as np

from scanlake.dims import DEFLATED_LE, NATIVE_FOR_REBUILD, RLE
from scanlake.sources.walker import PIXELS, Parsed, parse

#: Bytes of pixels that are unpacked at most.
PIXELS_MOST = 1 << 30
#: Limits of a decoder process: address space, and seconds of processor for each file.
MEMORY, CPU = 2 * 1024**3, 30


def unrle(segment: bytes, size: int) -> bytes:
    """A run-length segment (PackBits) to at most ``size`` bytes."""
    out, at = bytearray(), 0
    while at < len(segment) and len(out) < size:
        n = segment[at]
        if n < 128:
            out += segment[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += segment[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def rle_frame(data: bytes, pixels: int, samples: int, width: int) -> bytes:
    """A frame of RLE pixels, colour by plane, as little-endian samples of ``width`` bytes, colour by pixel."""
    n = int.from_bytes(data[:4], "little")
    if n != samples * width:
        raise ValueError("number of segments")
    offsets = [int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "little") for i in range(n)] + [len(data)]
    planes = [np.frombuffer(unrle(data[a:b], pixels), np.uint8) for a, b in zip(offsets, offsets[1:], strict=False)]
    if any(len(p) < pixels for p in planes):
        raise ValueError("a segment is too short")
    out = np.empty((pixels, samples, width), np.uint8)
    for i, p in enumerate(planes):  # the most significant byte comes first
        out[:, i // width, width - 1 - i % width] = p
    return out.tobytes()


def native_pixels(p: Parsed) -> bytes | None:
    """Uncompressed little-endian pixel bytes of a parsed file; null where no decoder here reads them."""
    value = next((x.value for x in p.elements if x.tag == PIXELS), None)
    syntax = p.syntax or NATIVE_FOR_REBUILD[0]
    if isinstance(value, bytes) and syntax in (*NATIVE_FOR_REBUILD, DEFLATED_LE):
        if syntax == NATIVE_FOR_REBUILD[2] and p.number("BitsAllocated", 8) == 16:
            return np.frombuffer(value[: len(value) // 2 * 2], ">u2").astype("<u2").tobytes()
        return value
    if isinstance(value, list) and syntax == RLE:
        rows, cols, samples, width = p.number("Rows", 0), p.number("Columns", 0), max(1, p.number("SamplesPerPixel", 1)), (p.number("BitsAllocated", 8) + 7) // 8
        if rows * cols * samples * width * max(1, len(value) - 1) > PIXELS_MOST:
            return None
        try:
            return b"".join(rle_frame(f, rows * cols, samples, width) for f in value[1:])
        except (ValueError, IndexError):
            return None
    return None


def read_exactly(source: BinaryIO, n: int) -> bytes:
    """``n`` bytes, or fewer at the end."""
    out = bytearray()
    while len(out) < n and (more := source.read(n - len(out))):
        out += more
    return bytes(out)


def serve(source: BinaryIO, target: BinaryIO) -> None:
    """In the decoder process: files come as their length (8 bytes) and bytes, pixels go back alike; none where they can't be decoded."""
    while len(head := read_exactly(source, 8)) == 8:
        data = read_exactly(source, int.from_bytes(head, "little"))
        spent = resource.getrusage(resource.RUSAGE_SELF)
        resource.setrlimit(resource.RLIMIT_CPU, (int(spent.ru_utime + spent.ru_stime) + CPU, resource.RLIM_INFINITY))
        raw = native_pixels(parse(data)) or b""
        target.write(len(raw).to_bytes(8, "little"))
        target.write(raw)
        target.flush()


def main() -> None:
    """The decoder process: limits first, then ``serve``; what a decoder prints goes to the error stream."""
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    target = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    serve(sys.stdin.buffer, target)
