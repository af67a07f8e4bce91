"""Corpus reports: audits of scores, fidelity by syntax, false-positive rates, throughput, and outcome classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.dims import ALLOCATION_MESSAGES, MEMORY_FAULTS, NATIVE_FOR_REBUILD
from scanlake.operators.disarm import fidelity_bucket

CHANNELS = ("struct_pts", "text_pts", "burned_pts", "face_pts")
BANDS = ("HIGH", "MODERATE", "LOW", "MINIMAL")
BUCKETS = ("skipped", "lossy_preserved", "lossy_changed", "lossless_bitexact", "lossless_BREAK")


def reid_audit(scored: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per data set and over all (null): files, mean score, bands, MODERATE and above, and per channel how often and how much.

    ``scored`` has the data set and ``reid``; files without a score count as errors.
    """
    s = lambda n: F.col(f"reid.{n}")
    known = F.col("reid").isNotNull()
    n = F.nullif(F.count_if(known), F.lit(0))
    out = scored.rollup(dataset).agg(
        F.count_if(known).alias("n"), F.count_if(~known).alias("errors"), F.mean(s("score")).alias("mean_score"),
        *[F.count_if(s("band") == b).alias(f"n_{b.lower()}") for b in BANDS], F.count_if(s("score") >= 25).alias("n_moderate_up"),
        *[x for c in CHANNELS for x in ((F.count_if(s(c) > 0) / n).alias(f"{c}_prevalence"), F.mean(s(c)).alias(f"{c}_mean"))],
        F.grouping(dataset).cast("int").alias("is_total"),
    )
    return out


def score_descriptors() -> dict[str, Column]:
    """A short text per channel of a report with ``reid``."""
    r = lambda n: F.col(f"reid.{n}")
    return {
        "structured": F.when(r("struct_pts") > 0, F.format_string("%d points from profile tags", r("struct_pts"))).otherwise("none populated"),
        "text": F.when(r("text_pts") >= 14, F.when(r("text_pts") > 14, "free text, private tags").otherwise("free text")).when(r("text_pts") > 0, "private tags").otherwise("none detected"),
        "burned_in": F.when(r("burned_pts") > 0, "text in the image").otherwise("none detected"),
        "face": F.when(r("face_pts") >= 30, "face can be rebuilt").when(r("face_pts") > 0, "head scan").otherwise("not a head scan"),
    }


def fidelity_report(made: DataFrame, by: list[str]) -> DataFrame:
    """Disarmed rows per group and over all: files in each fidelity bucket, most files first."""
    rows = made.select(*by, fidelity_bucket().alias("_b"))
    out = rows.rollup(*by).agg(*[F.count_if(F.col("_b") == b).alias(b) for b in BUCKETS], F.count("*").alias("total"), F.grouping_id().alias("gid"))
    return out.filter(F.col("gid").isin(0, 2 ** len(by) - 1)).withColumn("is_total", (F.col("gid") > 0).cast("int")).drop("gid").orderBy(F.desc("total"), *by)


def mixed_rates(rows: DataFrame) -> DataFrame:
    """Blocked and warned files: overall, of compressed files, of files with private elements.

    ``rows``: (verdict, syntax, n_private).
    """
    compressed = ~F.coalesce("syntax", F.lit("")).isin("", *NATIVE_FOR_REBUILD)
    groups = {"all": F.lit(True), "compressed": compressed, "private": F.coalesce("n_private", F.lit(0)) > 0}
    each = rows.select("verdict", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in groups.items()]))).alias("subset"))
    out = each.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "warn").alias("warned"))
    return out.select("*", (F.col("blocked") / F.col("n")).alias("block_rate"), (F.col("warned") / F.col("n")).alias("warn_rate"))


def before_after(pairs: DataFrame) -> DataFrame:
    """Paired scores ``before`` and ``after`` (structs like ``reid``): means per channel, pixels identical, identifiers changed.

    ``pairs`` also has ``same_pixels`` and ``changed`` (booleans).
    """
    means = [F.mean(F.col(f"{side}.{c}")).alias(f"{side}_{c}") for side in ("before", "after") for c in ("score", *CHANNELS)]
    return pairs.agg(F.count("*").alias("n"), *means, F.count_if("same_pixels").alias("pixels_identical"), F.count_if("changed").alias("identifiers_changed"))


def throughput(rows: DataFrame, seconds: str = "seconds", size: str = "file_size") -> DataFrame:
    """One row: files, bytes, mean, median and 95th percentile of the seconds per file, and rates over their sum."""
    t = F.col(seconds)
    out = rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(t).alias("total"), F.mean(t).alias("mean"), F.median(t).alias("median"), F.percentile(t, 0.95).alias("p95"))
    return out.select("*", F.try_divide("n", "total").alias("files_per_second"), F.try_divide(F.col("bytes") / 1024**2, F.col("total")).alias("mib_per_second"))


def decoder_outcome(code: Column, text: Column) -> Column:
    """Class of a decoder's end: hang, allocation, memory fault, kill, ok or rejected.

    ``code`` is the exit code, null for a timeout, negative for a signal; ``text`` is what it printed.
    """
    told = F.coalesce(text, F.lit(""))
    fault = F.regexp_extract(told, f"({'|'.join(MEMORY_FAULTS)})", 1)
    return (
        F.when(code.isNull(), "HANG")
        .when(told.rlike("|".join(ALLOCATION_MESSAGES)), "OOM/alloc")
        .when(F.contains(told, F.lit("AddressSanitizer")) | F.contains(told, F.lit("runtime error")), F.concat(F.lit("CRASH/ASan:"), F.when(fault != "", fault).otherwise("fault")))
        .when(code == -9, "OOM/kill")
        .when(code < 0, F.concat(F.lit("CRASH/sig"), (-code).cast("string")))
        .when(code == 0, "ok")
        .otherwise("rejected")
    )


def stack_hash(text: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the first four frames in a sanitizer's report; empty without frames."""
    frames = F.slice(F.regexp_extract_all(text, F.lit(r"#\d+ 0x[0-9a-f]+ in (\S+)"), F.lit(1)), 1, 4)
    return F.when(F.size(frames) > 0, F.left(F.sha1(F.array_join(frames, " ").cast("binary")), F.lit(12))).otherwise("")


def percent(k: Column, n: Column) -> Column:
    """``k/n (p%)`` with whole percents rounded down."""
    return F.when(n > 0, F.format_string("%d/%d (%d%%)", k, n, F.floor(100 * k / F.nullif(n, F.lit(0))))).otherwise(F.format_string("%d/%d", k, n))


def interval(lo: Column, hi: Column) -> Column:
    """A confidence interval in percent."""
    return F.format_string("%.1f to %.1f%%", 100 * lo, 100 * hi)
