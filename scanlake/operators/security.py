"""Security rules over parsed files: preamble, lengths, nesting, dimensions, private payloads, codecs.

Each rule is a Column ``array<finding>`` over the columns of ``sources.dicom.parsed``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.dims import AMPLIFICATION_BLOCK, AMPLIFICATION_FLOOR, AMPLIFICATION_WARN, CODEC_CVES, FRAME_CAP, JPIP, MAX_DEPTH, PREAMBLE_ENTROPY, SAFE_DECODERS, TRANSFER_SYNTAXES
from scanlake.findings import finding, findings, first_of
from scanlake.functions.binary import byte_symbols, let, shannon_entropy, signature_at_start

#: Numbers of a header count as this at most: a product of five of them is still a finite double.
NUMBER_MOST = 1e60


def attr(name: str) -> Column:
    """A top-level attribute as text; null if missing, empty if present without a value."""
    return F.element_at("attrs", name)


def first_value(name: str) -> Column:
    """The first value of an attribute, without blanks around it."""
    return F.trim(F.split(attr(name), r"\\")[0])


def number(name: str, default: int | None) -> Column:
    """An attribute as a whole number; the default where it is missing or isn't one.

    It is a double, limited to ``NUMBER_MOST``: no header can make the arithmetic of a rule overflow, and up to 2**53 it is exact.
    """
    text = first_value(name)
    n = F.when(text.rlike("^[+-]?[0-9]+$"), F.greatest(F.least(text.try_cast("double"), F.lit(NUMBER_MOST)), F.lit(-NUMBER_MOST)))
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def preamble() -> Column:
    """Magic, polyglot signature, then the entropy of the 128 bytes."""
    head = F.substring("preamble", 1, 128)
    magic, sig = F.substring("preamble", 129, 4), signature_at_start(head)
    c = "file_preamble"
    told = let(shannon_entropy(byte_symbols(head)), lambda e: finding(c, F.when(e > PREAMBLE_ENTROPY, "warn").otherwise("info"), F.format_string("Non-zero preamble of entropy %.1f of 8", e), "Rebuilding zeroes it."))
    return first_of(
        (F.coalesce(magic, F.lit(b"")) != F.lit(b"DICM"), finding(c, "critical", "No DICM magic at byte 128", F.concat(F.lit("found 0x"), F.hex(magic)))),
        (head == F.lit(b"\0" * 128), finding(c, "pass", "The preamble is all zeros")),
        (sig.isNotNull(), finding(c, "critical", F.concat(F.lit("Polyglot: the preamble is that of a "), sig), "The same bytes open as another kind of file; rebuilding zeroes them.")),
        (None, told),
    )


def length_amplification() -> Column:
    """The state of the length walk; files that aren't Part-10 give no finding."""
    w, c = F.col("walk"), "length_amplification"
    told = F.format_string("Element at byte %d declares %d bytes, %d remain", w["at"], w["declared"], w["remaining"])
    return first_of(
        (w["state"] == "meta_bomb", finding(c, "critical", F.concat(F.lit("File meta: "), told), "Every parser reads this group first.")),
        (w["state"] == "unresolved", finding(c, "info", "Lengths not checked: the transfer syntax can't be found")),
        (w["state"] == "deflated", finding(c, "info", "Lengths not checked: the data set is deflated")),
        (w["state"] == "mismatch", finding(c, "info", "Lengths checked in part: the encoding doesn't match the transfer syntax")),
        (w["state"] == "bomb", finding(c, "critical", told, "A parser that allocates what is declared runs out of memory.")),
        (w["state"] == "ok", finding(c, "pass", "All lengths lie within the file")),
    )


def sequence_depth(limit: int = MAX_DEPTH) -> Column:
    """Nesting of sequences against a limit."""
    d, c = F.col("seq_depth"), "sequence_depth"
    return first_of((d > limit, finding(c, "fail", F.format_string(f"Sequences nest %d deep, the limit is {limit}", d))), (None, finding(c, "pass", F.format_string("Sequences nest %d deep", d))))


def pixel_dimension_bomb() -> Column:
    """Declared buffer against a cap, then against what is stored."""
    one = F.lit(1.0)
    size = F.struct(
        number("Rows", 0).alias("rows"), number("Columns", 0).alias("cols"), F.greatest(number("SamplesPerPixel", 1), one).alias("samples"), F.greatest(number("NumberOfFrames", 1), one).alias("frames"),
        F.ceil(F.greatest(number("BitsAllocated", 8), one) / 8).alias("width"), F.nullif(F.col("pixel_len"), F.lit(0)).alias("stored"),
    )
    c = "pixel_dimension_bomb"

    def judged(d: Column) -> Column:
        frame = d["rows"] * d["cols"] * d["samples"] * d["width"]
        declared = frame * d["frames"]
        ratio = declared / d["stored"]
        amplified = F.format_string("%d stored bytes declare an image of %.1f MiB (%.0f times)", d["stored"], declared / 1024**2, ratio)
        large = d["stored"].isNotNull() & (declared > AMPLIFICATION_FLOOR)
        return first_of(
            ((d["rows"] <= 0) | (d["cols"] <= 0), finding(c, "pass", "No image dimensions")),
            (frame > FRAME_CAP, finding(c, "critical", F.format_string("One frame declares %.1f GiB", frame / 1024**3), "A viewer that sizes its buffer from the header runs out of memory.")),
            (large & (ratio > AMPLIFICATION_BLOCK), finding(c, "critical", amplified, "No codec reaches this ratio.")),
            (large & (ratio > AMPLIFICATION_WARN), finding(c, "warn", amplified, "Well above real codecs; rebuilding decodes it with limits.")),
            (None, finding(c, "pass", F.format_string("The declared image has %.1f MiB", declared / 1024**2))),
        )

    return let(size, judged)


def private_tag_payloads() -> Column:
    """Payloads in top-level private elements; a pass where there are none."""
    c = "private_tag_payload"
    bad = F.filter("private", lambda p: p["severity"].isNotNull())
    told = F.transform(bad, lambda p: finding(c, p["severity"], F.format_string("Private element (%04X,%04X) of %d bytes: %s", p["grp"], p["elem"], p["len"], p["threat"])))
    return F.when(F.size(bad) > 0, told).otherwise(F.array(finding(c, "pass", "No payload in private elements")))


def _case(key: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def codec_exposure() -> Column:
    """The decoder behind the transfer syntax, looked up in the fixed tables; unlisted ones count as native."""
    ts, c = F.coalesce("syntax", F.lit("")), "codec_cve"
    name = _case(ts, {u: n for u, n, _ in TRANSFER_SYNTAXES}, "unlisted")
    decoder = _case(ts, {u: d for u, _, d in TRANSFER_SYNTAXES}, "native")
    cves = _case(decoder, {d: ", ".join(i for i, _ in ids[:3]) for d, ids in CODEC_CVES.items()}, "")
    remote, safe = ts.isin(JPIP), decoder.isin(SAFE_DECODERS)
    return findings(
        F.when(remote, finding(c, "warn", "Pixels are fetched from a URL (JPIP)", "The reference can point a viewer to any server.")),
        F.when(~safe, finding(c, "warn", F.format_string("Pixels are decoded by %s (%s)", decoder, name), F.when(cves != "", F.concat(F.lit("e.g. "), cves)).otherwise("third-party native code"))),
        F.when(safe & ~remote, finding(c, "pass", F.format_string("No third-party decoder (%s)", name))),
    )


def file_read() -> Column:
    """Files that can't be parsed."""
    return first_of((F.col("parse_error").isNotNull(), finding("file_read", "critical", F.concat(F.lit("Can't be parsed: "), F.col("parse_error")))))
