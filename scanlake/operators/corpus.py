"""Corpus-level operators: dedupe, joins with dimensions, labels, baselines, anomalies, comparisons, rates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.dims import PHI_PATTERNS
from scanlake.functions.stats import wilson


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table of this library as a DataFrame; such tables hold tens of rows, so joins broadcast them."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def content_dedupe(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """One row per distinct content: its SHA-256, the first key, and how many rows hold it."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(key).alias("first"), F.count("*").alias("n"))


def first_rule(name: Column, rules: Iterable[tuple], default: tuple) -> Column:
    """``struct<label, verdict>`` of the first rule whose part occurs in ``name``."""
    out = None
    for part, label, verdict in rules:
        then = F.struct(F.lit(label).alias("label"), F.lit(verdict).alias("verdict"))
        out = F.when(F.contains(name, F.lit(part)), then) if out is None else out.when(F.contains(name, F.lit(part)), then)
    return out.otherwise(F.struct(F.lit(default[0]).alias("label"), F.lit(default[1]).alias("verdict")))


def phi_matches(text: Column, leave_out: tuple[str, ...] = ()) -> Column:
    """Names of the patterns that occur in ``text``, in table order; classes are Unicode ones."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(n)) for n, p in PHI_PATTERNS if n not in leave_out]))


#: Rank error of the sketch that finds where a quantile lies, as a part of the rows.
SKETCH = 10_000


def _finite(long: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def quantiles(finite: DataFrame, by: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between ranks) per group, without sorting or buffering a group in one task.

    A mergeable sketch brackets each quantile. Values within a bracket, some ten-thousandths of a group (all of a small one), are counted
    one by one, all others by the bracket that they lie behind; both combine on the map side, and what is left is cumulated. ``finite`` is read twice.
    Brackets are broadcast, a row for 2 * SKETCH values at least; without the hint Spark may send all values instead, where it takes them for the smaller side.
    """
    margin, v = 3.0 / SKETCH, F.col(value)
    at = [min(1.0, max(0.0, q + d)) for q in asked.values() for d in (-margin, margin)]
    sketch = finite.groupBy(*by).agg(F.count("*").alias("_size"), F.percentile_approx(v, at, SKETCH).alias("_b"))
    large = sketch.filter(F.col("_size") >= 2 * SKETCH)  # ranks are rounded, so a bracket must be some of them wide
    large = large.select(*[F.col(k).alias(f"_of_{k}") for k in by], "_b")
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    lo, hi = ([F.get("_b", F.lit(2 * i + k)) for i in range(len(asked))] for k in (0, 1))
    inside = F.coalesce(F.when(F.col("_b").isNull(), True), *[F.when((v >= a) & (v <= b), True) for a, b in zip(lo, hi, strict=True)], F.lit(False))
    behind = F.array_max(F.array(F.lit(-float("inf")), *[F.when(v > b, b) for b in hi]))
    counted = finite.join(F.broadcast(large), same, "left").groupBy(*by, F.when(inside, v).otherwise(behind).alias("_v"), (~inside).alias("_rest")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    ranked = counted.withColumns({"_upto": F.sum("_c").over(group.orderBy("_v", "_rest").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(group)})
    rank = lambda q: (F.col("_n") - 1) * q
    pick = lambda r: F.min(F.when((F.col("_upto") > r) & ~F.col("_rest"), F.col("_v")))
    picked = ranked.groupBy(*by, "_n").agg(*[x for k, q in asked.items() for x in (pick(F.floor(rank(q))).alias(f"_a_{k}"), pick(F.ceil(rank(q))).alias(f"_b_{k}"))])
    return picked.select(*by, *[(F.col(f"_a_{k}") + (F.col(f"_b_{k}") - F.col(f"_a_{k}")) * (rank(q) - F.floor(rank(q)))).alias(k) for k, q in asked.items()])


def moments(long: DataFrame, by: list[str], value: str = "value", least: int = 3) -> DataFrame:
    """Mean, population deviation, extremes and count of finite values per group of at least ``least``; NaN and infinities are left out."""
    v = F.col(value)
    return _finite(long, value).groupBy(*by).agg(F.mean(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n")).filter(F.col("n") >= least)


def baselines(long: DataFrame, by: list[str], value: str = "value", least: int = 3) -> DataFrame:
    """``moments`` and the exact median and 5th and 95th percentiles."""
    marks = quantiles(_finite(long, value), by, value, {"median": 0.5, "p5": 0.05, "p95": 0.95})
    return moments(long, by, value, least).join(marks, by).select(*by, "mean", "std", "median", "min", "max", "p5", "p95", "n")


def zscores(long: DataFrame, base: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``long`` joined with its baseline (``moments`` suffice) and ``z``; features without a baseline or with zero deviation are left out."""
    return long.join(base.select(*by, "mean", "std"), by).filter("std > 0").withColumn("z", F.abs(F.col(value) - F.col("mean")) / F.col("std"))


def anomalies(scored: DataFrame, key: list[str], tie: list[str], limit: float = 3.0) -> DataFrame:
    """Per key: how many values lie beyond ``limit`` deviations and the worst of them, ties by ``tie``."""
    out = scored.filter(F.col("z") > limit)
    rest = [c for c in out.columns if c not in key]
    worst = out.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-F.col("z"), *tie)).alias("_worst"), F.count("*").alias("n_anomalies"))
    return worst.select(*key, "_worst.*", "n_anomalies")


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """Hits, rows and the Wilson interval per group and over all (nulls in ``by``; ``is_total`` tells them apart)."""
    both = rows.select(*by, hit.alias("_hit")).rollup(*by).agg(F.count_if("_hit").alias("k"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
    both = both.filter(f"gid IN (0, {2 ** len(by) - 1})")
    return both.select(*by, "k", "n", *[c.alias(name) for name, c in wilson(F.col("k"), F.col("n")).items()], (F.col("gid") > 0).cast("int").alias("is_total"))


def by_class(rows: DataFrame, label: str) -> DataFrame:
    """Per class: files, detected ones, and of those with intrinsic danger how many were neutralised.

    Takes booleans ``detected``, ``intrinsic_danger``, ``neutralized`` (null: not tried).
    """
    danger = F.coalesce("intrinsic_danger", F.lit(False))
    return rows.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), F.count_if("detected").alias("detected"), F.count_if(danger).alias("neut_n"), F.count_if(danger & F.coalesce("neutralized", F.lit(False))).alias("neutralized")
    )


def verdict_of_rank(rank: Column) -> Column:
    """block, warn or clean from the gravest severity's rank."""
    return F.when(rank >= 3, "block").when(rank == 2, "warn").otherwise("clean")


def detected(expected: Column, verdict: Column) -> Column:
    """Whether a verdict meets the label: clean tolerates warnings, warn takes block too."""
    return F.when(expected == "clean", verdict != "block").when(expected == "block", verdict == "block").otherwise(verdict.isin("warn", "block"))


def outcome_dangerous(outcomes: Column) -> Column:
    """A map of target to outcome holds a crash, a hang or a denial of service."""
    return F.exists(F.map_values(outcomes), lambda v: v.startswith("crash") | v.startswith("hang") | v.startswith("dos"))


def all_accept(outcomes: Column) -> Column:
    """Every target that is present accepted the file; false if none is present."""
    present = F.filter(F.map_values(outcomes), lambda v: v != "n/a")
    return (F.size(present) > 0) & F.forall(present, lambda v: v == "clean")


def ran(outcomes: Column) -> Column:
    """Targets really executed the file: outcomes that aren't all denial of service known beforehand."""
    values = F.map_values(outcomes)
    return (F.size(values) > 0) & ~F.forall(values, lambda v: v.startswith("dos"))


def confusion(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined)."""
    y, p = label == 1, predicted == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def allowed_and_orphans(data: DataFrame, creators: DataFrame, allowed: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Default deny: data whose creator is allowed, and the creators that nothing kept refers to."""
    kept = data.join(creators.join(allowed, "creator", "left_semi"), by, "left_semi")
    return kept, creators.join(kept.select(*by).distinct(), by, "left_anti")


def matrix(long: DataFrame, key: str, feature: str, value: str, features: list[str]) -> DataFrame:
    """One row per key with a column per feature; missing and non-finite values are 0."""
    v = F.col(value)
    clean = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return long.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col(feature) == f, clean)), F.lit(0.0)).alias(f) for f in features])
