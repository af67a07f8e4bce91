"""What the bytes of one value tell: entropy, signatures, text. Without Spark, so decoder processes can use it."""

from __future__ import annotations

import numpy as np

from scanlake.dims import PAYLOAD_ENTROPY, PAYLOAD_OPAQUE_MIN, SIGNATURES, WINDOW


def entropy_of(data: bytes) -> float:
    """Shannon entropy of bytes, base 2; 0 for none."""
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def match_signature(data: bytes) -> tuple[str, int] | None:
    """(name, offset) by the same rule for one value in Python."""
    for sig, name in SIGNATURES:
        if data.startswith(sig):
            return name, 0
    for sig, name in SIGNATURES:
        if len(sig) >= 4 and (at := data.find(sig, 1, WINDOW)) > 0:
            return name, at
    return None


def payload_threat(data: bytes) -> tuple[str, str] | None:
    """(severity, description) of a smuggled payload, else None: a signature is critical, long opaque data a warning."""
    if found := match_signature(data):
        return "critical", f"{found[0]} at offset {found[1]}"
    if len(data) >= PAYLOAD_OPAQUE_MIN and (e := entropy_of(data[:WINDOW])) > PAYLOAD_ENTROPY:
        return "warn", f"opaque data of entropy {e:.1f}"
    return None


def element_text(value: bytes | str | None) -> str | None:
    """Bytes as text if over 0.7 of their characters are printable or white space; UTF-8 first, then Latin-1."""
    if value is None or isinstance(value, str):
        return value
    for encoding in ("utf-8", "latin-1"):
        try:
            text = value.decode(encoding)
        except UnicodeDecodeError:
            continue
        if sum(c.isprintable() or c.isspace() for c in text) > 0.7 * max(len(text), 1):
            return text
    return None
