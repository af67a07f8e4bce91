"""Learned classification of images (experimental): matrices, forests, folds, thresholds.

Features are maps from ``pixels.measured``; models are Spark ML pipelines, which are saved and loaded as such and
never unpickled.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.findings import finding, first_of

TREES, DEPTH, LEAF, SEED, FOLDS = 500, 20, 3, 42, 5
#: Parts of a label in which rows are numbered.
PARTS = 256


def feature_names(rows: DataFrame, column: str = "features") -> list[str]:
    """The sorted union of the maps' keys; as many as there are kinds of features."""
    return sorted(r[0] for r in rows.select(F.explode(F.map_keys(column))).distinct().collect())


def matrix(rows: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """``rows`` with a column per feature; missing and non-finite ones are 0."""
    value = lambda n: F.element_at(column, n)
    clean = lambda n: F.when(F.isnan(value(n)) | (F.abs(value(n)) == float("inf")), 0.0).otherwise(F.coalesce(value(n), F.lit(0.0)))
    return rows.select("*", *[clean(n).alias(f"f_{i}") for i, n in enumerate(names)])


def hash_split(rows: DataFrame, key: str, part: float = 0.7, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: stable, and all rows of a key fall in one part."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(part * 10_000)
    return rows.filter(at), rows.filter(~at)


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``weight`` so that classes weigh alike; two classes, so the counts are two rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    return rows.join(F.broadcast(counts.join(F.broadcast(total))), label).withColumn("weight", F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def forest(names: list[str], trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> Pipeline:
    """Assembler and random forest over the matrix of ``names``."""
    columns = [f"f_{i}" for i in range(len(names))]
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="vector"), RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)])


def train(rows: DataFrame, names: list[str], **options) -> PipelineModel:
    """Fit on rows with ``features`` and ``label`` (0 or 1)."""
    return forest(names, **options).fit(balanced(matrix(rows, names)))


def probability(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``probability`` of label 1."""
    scored = model.transform(matrix(rows, names))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("probability"))


def stratified(rows: DataFrame, key: str, folds: int = FOLDS, label: str = "label") -> DataFrame:
    """``rows`` with ``fold``: their numbers modulo ``folds`` in hash order within each label.

    Rows are numbered in parts of a label, by hash, so no task has to sort all of it; a part starts where those before it end.
    """
    parted = rows.withColumn("_hash", F.xxhash64(key, F.lit(SEED))).withColumn("_part", F.pmod("_hash", F.lit(PARTS)))
    sizes = parted.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(label, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_hash", key))
    numbered = parted.withColumn("_number", number).join(F.broadcast(starts), [label, "_part"])
    return numbered.select(*rows.columns, F.pmod(F.col("_start") + F.col("_number"), F.lit(folds)).cast("int").alias("fold"))


def cross_validated(rows: DataFrame, key: str, names: list[str], folds: int = FOLDS, **options) -> DataFrame:
    """Out-of-fold probabilities; folds are stratified by label through a hash order within each class."""
    marked = stratified(rows, key, folds)
    out = None
    for k in range(folds):
        test = marked.filter(F.col("fold") == k)
        scored = probability(train(marked.filter(F.col("fold") != k), names, **options), test, names)
        out = scored if out is None else out.union(scored)
    return out


def leave_one_out(rows: DataFrame, group: str, values: list[str], names: list[str], **options) -> DataFrame:
    """Probabilities of each generator's images from a model that saw none of them; genuine images have a null group."""
    out = None
    for v in values:
        model = train(rows.filter(F.col(group).isNull() | (F.col(group) != v)), names, **options)
        scored = probability(model, rows.filter(F.col(group) == v), names)
        out = scored if out is None else out.union(scored)
    return out


def auc(scored: DataFrame) -> float:
    """Area under the ROC curve."""
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label").evaluate(scored)


def verdict(p: Column) -> Column:
    """The classifier's finding: over 0.8 a warning, over 0.6 a note."""
    c = "ai_classifier"
    return first_of(
        (p.isNull(), finding(c, "info", "No model or no features")),
        (p > 0.80, finding(c, "warn", F.format_string("Probably generated or altered (%.2f)", p))),
        (p > 0.60, finding(c, "info", F.format_string("Possibly generated or altered (%.2f)", p))),
        (None, finding(c, "pass", F.format_string("No sign of generation (%.2f)", p))),
    )


def importances(model: PipelineModel, names: list[str], top: int = 10) -> list[tuple[str, float]]:
    """The most important features, largest first; a report."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]
