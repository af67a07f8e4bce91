"""Metadata-integrity rules over parsed files; each is a Column ``array<finding>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.dims import KNOWN_SYNTAXES, MODALITIES, NATIVE_FOR_SIZE
from scanlake.findings import finding, findings, first_of, none
from scanlake.functions.binary import let
from scanlake.operators.security import attr, first_value, number


def modality() -> Column:
    """Modality present and known."""
    m, c = attr("Modality"), "modality"
    return first_of((m.isNull(), finding(c, "warn", "No modality")), (m.isin(MODALITIES), finding(c, "pass", F.concat(F.lit("Modality "), m))), (None, finding(c, "warn", F.concat(F.lit("Unknown modality "), m))))


def transfer_syntax() -> Column:
    """Transfer syntax present and recognised."""
    ts, c = F.col("syntax"), "transfer_syntax"
    return first_of((ts.isNull(), finding(c, "warn", "No transfer syntax")), (ts.isin(KNOWN_SYNTAXES), finding(c, "pass", F.concat(F.lit("Transfer syntax "), ts))), (None, finding(c, "warn", F.concat(F.lit("Unknown transfer syntax "), ts))))


def sop_class() -> Column:
    """Class of the object, from the file meta group or the data set."""
    u, c = F.col("sop_class"), "sop_class"
    return first_of((u.isNull(), finding(c, "warn", "No SOP class")), (None, finding(c, "pass", F.concat(F.lit("SOP class "), u))))


def expected_pixel_bytes(rows: Column, cols: Column, bits: Column, samples: Column, frames: Column, photometric: Column) -> Column:
    """Bytes of the uncompressed image: single bits are packed, subsampled colour has fewer samples. A double: headers can't overflow it."""
    whole = lambda x: x.cast("double")
    px, n = whole(rows) * whole(cols) * whole(frames), whole(samples)
    wide = whole(F.floor((whole(bits) + 7) / 8))
    pi = F.upper(F.coalesce(photometric, F.lit("")))
    packed, two_planes = whole(F.floor((px * n + 7) / 8)), whole(F.floor(px * wide * 3 / 2))
    return F.when(bits == 1, packed).when(pi.isin("YBR_FULL_422", "YBR_PARTIAL_422"), px * wide * 2).when(pi == "YBR_PARTIAL_420", two_planes).otherwise(px * wide * n)


#: Attributes that the size of an image is computed from.
_SIZES = ("Rows", "Columns", "BitsAllocated", "SamplesPerPixel", "NumberOfFrames")


def pixel_dimensions() -> Column:
    """Stored against declared bytes for uncompressed pixels. An attribute with another value than one whole number makes the rule itself fail, which is a warning."""
    c = "pixel_dimensions"
    # present, but no whole number: text or several values; samples and frames also without a value
    odd = [F.when((attr(k) != "") & ~F.trim(attr(k)).rlike("^[+-]?[0-9]+$"), k) for k in _SIZES]
    odd += [F.when(first_value(k) == "", k) for k in _SIZES[3:]]
    expected = expected_pixel_bytes(number("Rows", None), number("Columns", None), number("BitsAllocated", None), number("SamplesPerPixel", 1), number("NumberOfFrames", 1), attr("PhotometricInterpretation"))
    facts = F.struct(F.col("pixel_len").alias("stored"), expected.alias("expected"), F.coalesce(*odd).alias("odd"), number("Rows", None).isNull().alias("no_rows"), number("Columns", None).isNull().alias("no_cols"), number("BitsAllocated", None).isNull().alias("no_bits"))
    native = F.coalesce("syntax", F.lit("")).isin(NATIVE_FOR_SIZE)

    def judged(d: Column) -> Column:
        stored, expected = d["stored"], d["expected"]
        excess = stored - expected
        told = F.format_string("%d bytes stored, %.0f declared", stored, expected)
        return first_of(
            (stored.isNull(), finding(c, "info", "No pixel data")),
            (d["odd"].isNotNull(), finding("check_pixel_dimensions", "warn", F.concat(F.lit("The rule can't be applied: not a whole number in "), d["odd"]))),
            (d["no_rows"] | d["no_cols"], finding(c, "fail", "Pixel data without rows or columns")),
            (d["no_bits"], finding(c, "fail", "Pixel data without allocated bits")),
            (~native, finding(c, "info", F.concat(F.lit("Compressed: "), told), "The size can't be checked without decoding.")),
            (stored + 2 < expected, finding(c, "fail", F.concat(F.lit("Too few bytes: "), told), "A viewer may read past the buffer.")),
            (excess <= 2, finding(c, "pass", told)),
            (excess <= F.greatest(expected, F.lit(4096.0)), finding(c, "pass", F.concat(F.lit("Padded: "), told))),
            (None, finding(c, "warn", F.concat(F.lit("Unexplained trailer: "), told))),
        )

    return let(facts, judged)


def parsed_date(value: Column) -> Column:
    """YYYYMMDD with one- or two-digit month and day, as lenient parsers read it; null where it is no date.

    Digits alone: the month takes two digits where that is a month, the day what remains (one or two digits).
    """
    v = F.trim(value)
    two = F.regexp_extract(v, r"^(\d{4})(0[1-9]|1[0-2])(0?[1-9]|[12]\d|3[01])$", 0) != ""
    month = F.when(two, F.substring(v, 5, 2)).otherwise(F.regexp_extract(v, r"^\d{4}([1-9])(0?[1-9]|[12]\d|3[01])$", 1))
    day = F.when(two, F.substring(v, 7, 2)).otherwise(F.substring(v, 6, 2))
    return F.when(month != "", F.try_to_date(F.concat_ws("-", F.substring(v, 1, 4), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))


def dates(as_of: Column) -> Column:
    """Format, future, placeholder and order of the four dates; ``as_of`` is the day that counts as today."""
    c, fields = "dates", ["StudyDate", "SeriesDate", "ContentDate", "AcquisitionDate"]
    raw = {f: F.nullif(F.coalesce(attr(f), F.lit("")), F.lit("")) for f in fields}
    read = F.struct(*[x for f in fields for x in (raw[f].alias(f), parsed_date(raw[f]).alias(f"{f}_day"))], as_of.alias("today"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")

    def judged(v: Column) -> Column:
        day = {f: v[f"{f}_day"] for f in fields}
        bad = [F.when(v[f].isNotNull() & day[f].isNull(), finding(c, "warn", F.concat(F.lit(f"{f} is no date: "), v[f]))) for f in fields]
        issues = [
            *bad,
            *[F.when(day[f] > v["today"], finding(c, "fail", F.concat(F.lit(f"{f} lies in the future: "), iso(day[f])))) for f in fields],
            *[F.when(F.year(day[f]) < 1950, finding(c, "warn", F.concat(F.lit(f"{f} is very old: "), iso(day[f])))) for f in fields],
            F.when(day["StudyDate"] > day["AcquisitionDate"], finding(c, "warn", "The study is dated after the acquisition")),
        ]
        known = F.array_compact(F.array(*day.values()))
        fine = finding(c, "pass", F.concat(F.lit("Dates from "), iso(F.array_min(known)), F.lit(" to "), iso(F.array_max(known))))
        none_read = F.coalesce(*day.values()).isNull()
        return let(findings(*issues), lambda found: F.when(none_read, F.concat(findings(*bad), F.array(finding(c, "info", "No dates")))).when(F.size(found) > 0, found).otherwise(F.array(fine)))

    return let(read, judged)


def _filled(name: str) -> Column:
    return F.coalesce(F.trim(attr(name)), F.lit("")) != ""


def patient_info() -> Column:
    """Patient's name and id."""
    c, name, pid = "patient_info", _filled("PatientName"), _filled("PatientID")
    neither = (F.coalesce(attr("PatientName"), F.lit("")) == "") & (F.coalesce(attr("PatientID"), F.lit("")) == "")
    return first_of(
        (neither, finding(c, "warn", "Neither name nor id of the patient")),
        (None, finding(c, F.when(name & pid, "pass").otherwise("info"), F.concat(F.lit("Name "), F.when(name, "present").otherwise("missing"), F.lit(", id "), F.when(pid, "present").otherwise("missing")))),
    )


def provenance() -> Column:
    """How many of four fields on the origin are filled."""
    c, fields = "provenance", ["InstitutionName", "Manufacturer", "StationName", "ManufacturerModelName"]
    n = sum(_filled(f).cast("int") for f in fields)
    return first_of((n >= 2, finding(c, "pass", F.format_string("%d of 4 fields on the origin", n))), (n == 1, finding(c, "info", "One of 4 fields on the origin")), (None, finding(c, "warn", "No field on the origin")))


def uids() -> Column:
    """Presence, length, characters and difference of the three ids."""
    c, fields = "uid_check", ["StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID"]
    each = [
        (
            F.when(attr(f).isNull(), finding(c, "warn", f"{f} is missing")),
            F.when(F.length(attr(f)) > 64, finding(c, "fail", F.format_string(f"{f} has %d characters, 64 are allowed", F.length(attr(f))))),
            F.when(~attr(f).rlike("^[0-9.]*$"), finding(c, "fail", f"{f} has other characters than digits and dots")),
        )
        for f in fields
    ]
    present = F.array_compact(F.array(*[attr(f) for f in fields]))
    issues = findings(*[x for xs in each for x in xs], F.when(F.size(F.array_distinct(present)) < F.size(present), finding(c, "fail", "Ids of different levels are equal")))
    return F.when(F.size(issues) > 0, issues).otherwise(F.array(finding(c, "pass", "All ids present, well formed and different")))


def all_checks(as_of: Column) -> Column:
    """The eight rules in order."""
    return F.concat(modality(), transfer_syntax(), sop_class(), pixel_dimensions(), dates(as_of), patient_info(), provenance(), uids(), none())
