"""The scan of a folder: files to findings, verdicts, scores, actions and corpus reports."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.findings import dangerous, none, severity_rank, summary
from scanlake.operators import corpus, disarm, metadata, pixels, privacy, security
from scanlake.sources.dicom import parsed

#: Columns of a report that a later step needs besides its findings.
_KEEP = ["file_id", "filename", "file_size", "sha256", "syntax", "attrs", "pixel_len", "pixel_sha256", "parse_error"]


def security_findings(as_of: Column, deid: bool = False) -> Column:
    """All rules in order: bytes first, then those of a parsed data set, then privacy."""
    header = F.concat(security.sequence_depth(), security.pixel_dimension_bomb(), security.private_tag_payloads(), security.codec_exposure(), metadata.all_checks(as_of), privacy.all_checks(F.col("text_regions"), F.col("pixel_state")) if deid else none())
    return F.concat(security.preamble(), security.length_amplification(), F.when(F.col("parse_error").isNotNull(), security.file_read()).otherwise(header))


@lru_cache(8)
def _rules(context: SparkContext, as_of: str | None, deid: bool) -> Column:
    """``security_findings``, built once for a context: some thousand expressions, each a call to the JVM."""
    return security_findings(F.current_date() if as_of is None else F.lit(as_of).cast("date"), deid)


def _judged(rows: DataFrame, as_of: str | None, deid: bool = False) -> DataFrame:
    """Parsed ``rows`` with ``findings``."""
    found = _rules(rows.sparkSession.sparkContext, as_of, deid)
    # one row comes out of the generator per file: rules aren't written out again for each use of the findings
    return rows.select("*", F.explode(F.array(F.struct(found.alias("findings")))).alias("_f")).withColumn("findings", F.col("_f.findings")).drop("_f")


def scan(files: DataFrame, deid: bool = False, as_of: str | None = None) -> DataFrame:
    """One report per file of ``files`` (with ``content``): findings, summary, and with ``deid`` the score ``reid``. ``as_of`` is the day (YYYY-MM-DD) that counts as today.

    Each file is parsed once. Pixels are looked at only with ``deid``, in the same pass.
    """
    rows = _judged(parsed(files, measure=pixels.Measure(features=False) if deid else None), as_of, deid)
    out = [*_KEEP, "findings", summary(F.col("findings")).alias("summary"), F.current_timestamp().alias("scan_time")]
    return rows.select(*out, *([privacy.reid_score(F.col("text_regions")).alias("reid")] if deid else []))


def finding_rows(reports: DataFrame) -> DataFrame:
    """One row per finding, in order: (file_id, ord, check, severity, message, details)."""
    return reports.select("file_id", F.posexplode("findings").alias("ord", "f")).select("file_id", "ord", "f.check", "f.severity", "f.message", "f.details")


def processed(files: DataFrame, every: bool = False, as_of: str | None = None) -> DataFrame:
    """One row per file: ``_KEEP``, findings, summary, ``go``, ``REBUILT``, source_lossy, ``action``, ``reason``; from one pass without a shuffle.

    Files that are dangerous (all with ``every``) are rebuilt, and the copies scanned again; those still dangerous, or that
    can't be rebuilt, are quarantined and have no output.
    """
    first = _judged(parsed(files, keep_content=True), as_of)
    go = F.lit(every) | dangerous(F.col("findings"))
    first = first.select(F.struct(*_KEEP, "findings", summary(F.col("findings")).alias("summary"), go.alias("go"), disarm.source_lossy().alias("source_lossy"), F.when(go, disarm.refused()).alias("refused")).alias("before"), "content")
    wanted = F.col("before.go") & F.col("before.refused").isNull()
    copies = disarm.rebuilt(first.withColumn("content", F.when(wanted, F.coalesce("content", F.lit(b"")))), rescan=True)
    again = _judged(copies, as_of)
    error = F.coalesce("before.refused", "error")
    bad = error.isNotNull() | dangerous(F.col("findings"))
    go = F.col("before.go")
    return again.select(
        *[f"before.{c}" for c in (*_KEEP, "findings", "summary", "go", "source_lossy")],
        F.when(~go, "clean").when(bad, "quarantined").otherwise("disarmed").alias("action"),
        F.when(error.isNotNull(), error).when(go & bad, "still dangerous after rebuilding").alias("reason"),
        F.when(go & ~bad, F.col("output")).alias("output"),
        "changes", "private_removed", "transcoded", "image_preserved",
    )


def disarm_or_quarantine(files: DataFrame, every: bool = False, as_of: str | None = None) -> DataFrame:
    """(file_id, action, reason, output, changes, image_preserved, source_lossy): clean, disarmed or quarantined."""
    return processed(files, every, as_of).select("file_id", "action", "reason", "output", "changes", "image_preserved", "source_lossy")


def evaluate(files: DataFrame, labels: DataFrame, as_of: str | None = None) -> DataFrame:
    """The benchmark: per labelled file its verdict, detection, action, fidelity and neutralisation.

    ``labels``: (filename, attack_class, expected_verdict). Third-party parsers aren't available, so there are no outcomes of theirs.
    """
    out = _labelled(processed(files, True, as_of).select("filename", "findings", "action", disarm.fidelity(F.col("image_preserved")).alias("fidelity")), labels)
    return out.withColumn("neutralized", F.when(F.col("intrinsic_danger"), F.col("action").isin("disarmed", "quarantined")))


def evaluate_scan(files: DataFrame, labels: DataFrame, as_of: str | None = None) -> DataFrame:
    """The same from the scan alone: nothing is rebuilt, so actions are ``n/a`` and nothing is neutralised."""
    out = _labelled(scan(files, as_of=as_of).select("filename", "findings", F.lit("n/a").alias("action"), F.lit("n/a").alias("fidelity")), labels)
    return out.withColumn("neutralized", F.lit(None).cast("boolean"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    rank = F.array_max(F.transform("findings", lambda f: severity_rank(f["severity"])))
    rows = rows.select("filename", corpus.verdict_of_rank(F.coalesce(rank, F.lit(0))).alias("verdict"), "action", "fidelity")
    benign = F.col("expected_verdict") == "clean"
    return rows.join(labels, "filename").select(
        "filename", "attack_class", "expected_verdict", "verdict", "action", "fidelity", benign.alias("benign"), (~benign).alias("intrinsic_danger"),
        corpus.detected(F.col("expected_verdict"), F.col("verdict")).alias("detected"), (benign & (F.col("verdict") == "block")).alias("false_positive"),
    )


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """One row: detection, false positives, neutralisation and fidelity, each with its Wilson interval."""
    from scanlake.functions.stats import rule_of_three, wilson

    tampered, benign, danger = ~F.col("benign"), F.col("benign"), ~F.col("benign") & F.col("intrinsic_danger")
    told = F.col("fidelity").isin("bit-exact", "CHANGED")
    pairs = {"detection": (tampered & F.col("detected"), tampered), "false_positives": (benign & F.col("false_positive"), benign), "neutralization": (danger & F.coalesce("neutralized", F.lit(False)), danger), "fidelity": (F.col("fidelity") == "bit-exact", told)}
    counted = rows.agg(*[x for k, (a, b) in pairs.items() for x in (F.count_if(a).alias(f"{k}_k"), F.count_if(b).alias(f"{k}_n"))])
    intervals = [c.alias(f"{k}_{x}") for k in pairs for x, c in wilson(F.col(f"{k}_k"), F.col(f"{k}_n")).items() if x != "p"]
    return counted.select("*", *intervals, F.when(F.col("false_positives_k") == 0, rule_of_three(F.col("false_positives_n"))).alias("false_positive_upper95"))
