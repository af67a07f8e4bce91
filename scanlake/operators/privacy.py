"""De-identification rules over parsed files and the re-identification score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanlake.dims import CRITICAL_TAGS, FREE_TEXT_TAGS, HEAD_PARTS, HEAD_WORDS, PROFILE_TAGS, VENDOR_PHI_TAGS, VOLUME_MODALITIES
from scanlake.findings import finding, findings, first_of
from scanlake.operators.corpus import phi_matches
from scanlake.operators.security import attr, number


def _populated(name: str) -> Column:
    return F.coalesce(F.trim(attr(name)), F.lit("")) != ""


def profile_counts() -> tuple[Column, Column]:
    """How many critical and how many other profile tags hold data."""
    critical = sum(_populated(k).cast("int") for k in CRITICAL_TAGS)
    other = sum(_populated(k).cast("int") for _, _, k, _ in PROFILE_TAGS if k not in CRITICAL_TAGS)
    return critical, other


def profile_completeness() -> Column:
    """Profile tags that still hold data."""
    c, (critical, other) = "deid_profile", profile_counts()
    names = lambda keep: F.array_join(F.array_compact(F.array(*[F.when(_populated(k), k) for _, _, k, _ in PROFILE_TAGS if (k in CRITICAL_TAGS) == keep])), "; ")
    return findings(
        F.when((critical == 0) & (other == 0), finding(c, "pass", "No profile tag holds data")),
        F.when(critical > 0, finding(c, "fail", F.format_string("%d critical tags hold data", critical), names(True))),
        F.when(other > 0, finding(c, F.when(other <= 5, "warn").otherwise("fail"), F.format_string("%d other profile tags hold data", other), names(False))),
    )


def private_hits() -> Column:
    """Private elements with identifying text: of a vendor's known tags, or with a pattern."""
    known = [(g, e) for g, e, _ in VENDOR_PHI_TAGS]
    vendor = lambda p: sum((((p["grp"] == g) & (p["elem"] == e)).cast("int") for g, e in known), F.lit(0)) > 0
    return F.filter("private", lambda p: (F.length(F.coalesce(p["text"], F.lit(""))) >= 3) & (vendor(p) | (F.size(phi_matches(p["text"])) > 0)))


def private_tags_phi() -> Column:
    """Identifiers in private elements; the first ten are named."""
    c, hits = "private_tags_phi", private_hits()
    named = F.array_join(F.slice(F.transform(hits, lambda p: F.format_string("(%04X,%04X)", p["grp"], p["elem"])), 1, 10), "; ")
    return first_of(
        (F.size("private") == 0, finding(c, "pass", "No private elements")),
        (F.size(hits) == 0, finding(c, "pass", F.format_string("%d private elements without identifiers", F.size("private")))),
        (None, finding(c, "warn", F.format_string("%d private elements may identify the patient", F.size(hits)), named)),
    )


def free_text_hits() -> Column:
    """Free-text tags with a pattern; names aren't looked for, clinical phrases look like them."""
    hits = []
    for _, _, k in FREE_TEXT_TAGS:
        text = F.coalesce(attr(k), F.lit(""))
        hits.append(F.when((F.length(F.trim(text)) >= 3) & (F.size(phi_matches(text, ("name",))) > 0), k))
    return F.array_compact(F.array(*hits))


def free_text_phi() -> Column:
    """Identifiers in descriptive fields; the first eight are named."""
    c, hits = "free_text_phi", free_text_hits()
    return first_of((F.size(hits) == 0, finding(c, "pass", "No identifiers in free text")), (None, finding(c, "warn", F.format_string("%d free-text fields hold identifiers", F.size(hits)), F.array_join(F.slice(hits, 1, 8), "; "))))


def burned_in_phi(regions: Column, pixels: Column) -> Column:
    """Text burned into the image: the header's flag, else regions found in the pixels.

    ``pixels`` is ``text`` (undecodable), ``small``, ``flat`` or ``ok``; ``regions`` names edge strips with text-like marks.
    """
    c, flag = "burned_in_phi", F.coalesce(attr("BurnedInAnnotation"), F.lit("")) == "YES"
    state = F.coalesce(pixels, F.lit("none"))
    return findings(
        F.when(flag, finding(c, "warn", "The header declares burned-in text")),
        F.when(state == "none", finding(c, "info", "Pixels can't be read")),
        F.when(state == "small", finding(c, "info", "Too small an image to look for burned-in text")),
        F.when(~flag & state.isin("flat", "ok") & (F.coalesce(F.size(regions), F.lit(0)) <= 0), finding(c, "pass", "No sign of burned-in text")),
        F.when(~flag & (state == "ok") & (F.coalesce(F.size(regions), F.lit(0)) > 0), finding(c, "warn", F.format_string("Text-like marks in %d edge strips", F.size(regions)), F.array_join(regions, ", "))),
    )


def facial_geometry() -> Column:
    """Whether the face can be rebuilt from a head volume."""
    c = "facial_geometry"
    mod = F.upper(F.coalesce(attr("Modality"), F.lit("")))
    part = F.replace(F.upper(F.coalesce(attr("BodyPartExamined"), F.lit(""))), F.lit(" "), F.lit(""))
    told = lambda name: sum(F.contains(F.upper(F.coalesce(attr(name), F.lit(""))), F.lit(w)).cast("int") for w in HEAD_WORDS) > 0
    head = part.isin(HEAD_PARTS) | told("StudyDescription") | told("SeriesDescription")
    thick = attr("SliceThickness").try_cast("double")
    volume = (number("NumberOfFrames", 1) > 1) | attr("ImagePositionPatient").isNotNull()
    severity = F.when(thick.isNull(), "warn").when(thick <= 1.5, "fail").when(thick <= 3.0, "warn").otherwise("info")
    return first_of(
        (~mod.isin(VOLUME_MODALITIES), finding(c, "pass", F.concat(F.lit("Doesn't apply to modality "), mod))),
        (~head, finding(c, "pass", "Not a head scan")),
        (~volume, finding(c, "info", "A single slice of the head")),
        (None, finding(c, severity, "A head volume from which the face may be rebuilt", F.concat(F.lit("slice thickness "), F.coalesce(thick.cast("string"), F.lit("unknown"))))),
    )


def score_points(critical: Column, other: Column, free_text: Column, private: Column, flag: Column, marks: Column, face: Column) -> Column:
    """``struct<score, band, struct_pts, text_pts, burned_pts, face_pts>`` from the channels; ``face`` is a severity."""
    structured = F.least(F.lit(45), 18 * critical + 3 * other).cast("int")
    text = F.least(F.lit(22), F.when(free_text, 14).otherwise(0) + F.when(private, 10).otherwise(0)).cast("int")
    burned = F.when(flag | marks, 18).otherwise(0)
    geometry = F.when(face == "fail", 30).when(face == "warn", 18).when(face == "info", 6).otherwise(0)
    total = F.least(F.lit(100), structured + text + burned + geometry).cast("int")
    band = F.when(total >= 60, "HIGH").when(total >= 25, "MODERATE").when(total >= 1, "LOW").otherwise("MINIMAL")
    return F.struct(total.alias("score"), band.alias("band"), structured.alias("struct_pts"), text.alias("text_pts"), burned.alias("burned_pts"), geometry.alias("face_pts"))


def reid_score(regions: Column) -> Column:
    """The score of a parsed file. Text recognition isn't available, so its points are none."""
    critical, other = profile_counts()
    flag = F.upper(F.coalesce(attr("BurnedInAnnotation"), F.lit(""))) == "YES"
    exact = F.coalesce(attr("BurnedInAnnotation"), F.lit("")) == "YES"
    marks = ~exact & (F.coalesce(F.size(regions), F.lit(0)) > 0)
    return score_points(critical, other, F.size(free_text_hits()) > 0, F.size(private_hits()) > 0, flag | exact, marks, facial_geometry()[0]["severity"])


def all_checks(regions: Column, pixels: Column) -> Column:
    """The five rules in order."""
    return F.concat(profile_completeness(), private_tags_phi(), free_text_phi(), burned_in_phi(regions, pixels), facial_geometry())
