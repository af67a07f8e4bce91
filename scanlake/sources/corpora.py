"""Labelled corpora, sniffing, content-distinct gathering, stored baselines, and sinks for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.dims import NAME_RULES
from scanlake.operators.corpus import first_rule
from scanlake.sources.dicom import scan_files

BASELINES = "modality string, feature string, mean double, std double, median double, min double, max double, p5 double, p95 double, n long, _sample_count long"
MANIFEST = "name string, attack_class string, expected_verdict string, note string"


def is_part10(content: Column) -> Column:
    """True if ``DICM`` stands at byte 128."""
    return F.coalesce(F.substring(content, 129, 4) == F.lit(b"DICM"), F.lit(False))


def distinct_files(files: DataFrame) -> DataFrame:
    """Files with distinct contents, the first path of each; hashes are compared, contents joined back by path."""
    first = files.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("file_id").alias("file_id"))
    return files.join(first.select("file_id"), "file_id", "left_semi")


def gather(spark: SparkSession, paths: list[str], glob: str = "*") -> DataFrame:
    """Part-10 files below several folders, each content once."""
    return distinct_files(reduce(DataFrame.unionByName, [scan_files(spark, p, glob) for p in paths]).filter(is_part10(F.col("content"))))


def labels_by_name(files: DataFrame) -> DataFrame:
    """(filename, attack_class, expected_verdict) from parts of the names; names that no rule knows are to be blocked."""
    label = first_rule(F.col("filename"), NAME_RULES, ("unknown", "block"))
    return files.select("filename", label["label"].alias("attack_class"), label["verdict"].alias("expected_verdict")).distinct()


def labels_benign(files: DataFrame, attack_class: str = "benign") -> DataFrame:
    """The same for a folder of harmless files."""
    return files.select("filename", F.lit(attack_class).alias("attack_class"), F.lit("clean").alias("expected_verdict")).distinct()


def labels_from_manifest(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The same from a manifest, a JSON list; entries without a file are left out."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).withColumnRenamed("name", "filename")
    return rows.join(files.select("filename").distinct(), "filename", "left_semi").select("filename", "attack_class", "expected_verdict")


def save_baselines(base: DataFrame, path: str) -> None:
    """Store baselines as a table."""
    base.select(*[F.col(f.split()[0]) for f in BASELINES.split(", ")]).write.mode("overwrite").parquet(path)


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Stored baselines; an empty table where there are none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(conf).exists(target):
        return spark.createDataFrame([], BASELINES)
    return spark.read.schema(BASELINES).parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines; a finding without details has no such key."""
    reports.write.mode("overwrite").json(path)
