"""Functions over byte columns: entropy and signatures; those over single values are in ``payloads``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.dims import SIGNATURES, WINDOW


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: what stands inside a lambda is otherwise computed for every element."""
    return F.transform(F.array(value), body)[0]


def shannon_entropy(symbols: Column) -> Column:
    """Entropy, base 2, of an array of symbols: sorted, then run lengths; O(n log n), no user function."""

    def of_runs(ordered: Column) -> Column:
        n = F.size(ordered)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(ordered, i - 1) != F.get(ordered, i)))

        def bits(e: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))))
            return F.aggregate(F.zip_with(e, starts, lambda x, y: (x - y).cast("double")), F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))

        return F.when(n > 0, let(ends, bits) + 0.0).otherwise(0.0)

    return let(F.array_sort(symbols), of_runs)


def byte_symbols(data: Column) -> Column:
    """Bytes as an array of two-digit hex strings."""
    return F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != "")


def signature_at_start(data: Column, signatures: Iterable[tuple[bytes, str]] = SIGNATURES) -> Column:
    """Name of the first signature with which the bytes begin, else null."""
    out = None
    for sig, name in signatures:
        hit = F.startswith(data, F.lit(sig))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def signature_in_window(data: Column, window: int = WINDOW, signatures: Iterable[tuple[bytes, str]] = SIGNATURES) -> Column:
    """``struct<name, offset>``: any signature at 0, else one of at least 4 bytes inside the first ``window`` bytes, else null.

    Offsets are byte offsets: bytes are compared as Latin-1 characters, one for each.
    """
    head = F.decode(F.substring(data, 1, window), "ISO-8859-1")
    at_start = signature_at_start(data, signatures)
    out = F.when(at_start.isNotNull(), F.struct(at_start.alias("name"), F.lit(0).alias("offset")))
    for sig, name in signatures:
        if len(sig) >= 4:
            at = F.instr(head, F.lit(sig.decode("latin-1")))
            out = out.when(at > 1, F.struct(F.lit(name).alias("name"), (at - 1).alias("offset")))
    return out
