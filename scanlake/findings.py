"""Findings: one rule's outcome on one file, and their rollup into verdicts.

A finding is ``struct<check, severity, message, details>``. Rules are Columns that give ``array<finding>``; no
finding is an empty array. Everything here is Catalyst expressions; rollups are partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.dims import SEVERITIES, VERDICTS

FINDING = "struct<check: string, severity: string, message: string, details: string>"


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def finding(check: str, severity: Column | str, message: Column | str, details: Column | str | None = None) -> Column:
    """One finding; strings are literals."""
    return F.struct(F.lit(check).alias("check"), _text(severity).alias("severity"), _text(message).alias("message"), _text(details).alias("details"))


def findings(*xs: Column) -> Column:
    """An array of findings; null ones are left out."""
    return F.array_compact(F.array(*xs)) if xs else none()


def none() -> Column:
    """No finding."""
    return F.array().cast(f"array<{FINDING}>")


def first_of(*rules: tuple[Column | None, Column]) -> Column:
    """The finding of the first rule whose condition holds, as an array; a rule without condition is the last resort."""
    out = None
    for condition, then in rules:
        if condition is None:
            out = F.array(then) if out is None else out.otherwise(F.array(then))
            return out
        out = F.when(condition, F.array(then)) if out is None else out.when(condition, F.array(then))
    return out.otherwise(none())


def severity_rank(severity: Column | str) -> Column:
    """0 (pass) to 4 (critical); unknown severities have none."""
    s = F.col(severity) if isinstance(severity, str) else severity
    out = F.when(s == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        out = out.when(s == name, i)
    return out


def verdict_of(critical: Column, fail: Column, warn: Column) -> Column:
    """The verdict of severity counts."""
    return F.when(critical > 0, VERDICTS[0][0]).when(fail > 0, VERDICTS[1][0]).when(warn > 2, VERDICTS[2][0]).when(warn > 0, VERDICTS[3][0]).otherwise(VERDICTS[4][0])


def trust_of(verdict: Column) -> Column:
    """The trust score of a verdict."""
    out = F.when(verdict == VERDICTS[0][0], F.lit(VERDICTS[0][1]))
    for name, score in VERDICTS[1:]:
        out = out.when(verdict == name, F.lit(score))
    return out


def summarize(rows: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """Rows of findings to one summary per key: counts per severity, ``overall``, ``trust_score``, ``total_checks``.

    A missing severity counts as info, an unknown one not at all.
    """
    s = F.coalesce(F.col(severity), F.lit("info"))
    counted = rows.groupBy(key).agg(*[F.count_if(s == name).alias(f"n_{name}") for name in SEVERITIES])
    counted = counted.withColumn("overall", verdict_of(F.col("n_critical"), F.col("n_fail"), F.col("n_warn")))
    return counted.select("*", trust_of(F.col("overall")).alias("trust_score"), sum(F.col(f"n_{name}") for name in SEVERITIES).alias("total_checks"))


def summary(found: Column) -> Column:
    """The same for one file's array of findings, as a struct."""
    shown = F.transform(found, lambda f: F.coalesce(f["severity"], F.lit("info")))
    n = {name: (F.size(shown) - F.size(F.array_remove(shown, name))).cast("long") for name in SEVERITIES}
    overall = verdict_of(n["critical"], n["fail"], n["warn"])
    counts = F.create_map(*[x for name in SEVERITIES for x in (F.lit(name), n[name])])
    return F.struct(overall.alias("overall"), trust_of(overall).alias("trust_score"), counts.alias("counts"), sum(n.values()).alias("total_checks"))


def dangerous(found: Column) -> Column:
    """True if a finding is fail or critical."""
    return F.exists(found, lambda f: f["severity"].isin("fail", "critical"))


def worst(found: Column, check: str | None = None) -> Column:
    """The gravest severity, of one check or of all; null without findings."""
    mine = F.filter(found, lambda f: f["check"] == check) if check else found
    return F.array_max(F.transform(mine, lambda f: F.struct(severity_rank(f["severity"]).alias("rank"), f["severity"].alias("severity"))))["severity"]


def verdict_distribution(summaries: DataFrame, overall: str = "overall") -> DataFrame:
    """Files per verdict with percentage, in the order of gravity, then unknown ones."""
    counted = summaries.groupBy(F.col(overall).alias("overall")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(v) for v, _ in VERDICTS]), F.col("overall")), F.lit(0))
    # the joined side is a single row
    return counted.join(F.broadcast(total)).select("overall", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), F.when(place > 0, place).otherwise(len(VERDICTS) + 1).cast("int").alias("ord"))


def category_prevalence(rows: DataFrame, key: str, check: str = "check", severity: str = "severity", top: int | None = None) -> DataFrame:
    """Files with at least one warn, fail or critical finding of a check; ``top`` cuts the report, ties by name."""
    hit = rows.filter(severity_rank(severity) >= 2)
    counted = hit.groupBy(F.col(check).alias("check")).agg(F.count_distinct(key).alias("files"))
    return counted.orderBy(F.desc("files"), "check").limit(top) if top else counted


def check_severity_pivot(rows: DataFrame, key: str, check: str = "check", severity: str = "severity", examples: int = 5) -> DataFrame:
    """Per check: findings of each severity, false-positive candidates (fail and critical), and the first few of their files.

    Only the first files of a check are gathered: they are ranked among its distinct ones, of which each task keeps that many.
    """
    s, name = F.col(severity), F.col(check).alias("check")
    bad = severity_rank(s) >= 3
    counted = rows.groupBy(name).agg(*[F.count_if(s == x).alias(f"n_{x}") for x in SEVERITIES], F.count_if(bad).alias("n_blocking"))
    order = F.row_number().over(Window.partitionBy("check").orderBy("_key"))
    first = rows.filter(bad).select(name, F.col(key).alias("_key")).distinct().withColumn("_r", order).filter(F.col("_r") <= examples)
    named = first.groupBy(F.col("check").alias("_check")).agg(F.sort_array(F.collect_list("_key")).alias("examples"))
    none = F.array().cast(rows.select(F.array(key)).schema[0].dataType)
    return counted.join(named, F.col("check").eqNullSafe(F.col("_check")), "left").drop("_check").withColumn("examples", F.coalesce("examples", none))


def action_distribution(rows: DataFrame, action: str = "action") -> DataFrame:
    """Files per action; those without one were scanned only."""
    return rows.groupBy(F.coalesce(F.col(action), F.lit("scanned")).alias("action")).agg(F.count("*").alias("n"))


def first_dangerous(reports: DataFrame, most: int = 20, path: str = "file_id") -> DataFrame:
    """The first dangerous files by path, a report: (path, overall, and the checks that failed)."""
    bad = F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"].isin("fail", "critical")), lambda f: f["check"]))
    return reports.filter(dangerous(F.col("findings"))).select(path, F.col("summary.overall").alias("overall"), bad.alias("checks")).orderBy(path).limit(most)
