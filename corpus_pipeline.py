"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents and nothing else. Nulls: a null text fails the
quality rules; a null doc_id is a document like any other and sorts after all others; repeated rows
are judged alike and, as copies with one id, end as one document; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import scratch_path, table, written
from scanlake.llm.linededup import dedup_lines
from scanlake.llm.packing import pack
from scanlake.llm.pii import redact
from scanlake.llm.quality import judge
from scanlake.llm.simhash import fingerprints, rooted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules reject go."""
    return judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: lines that repeat an earlier line go; a document left without any word goes."""
    found = dedup_lines(docs.select(*COLUMNS)).filter("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each SimHash component one row stays, the one with the smallest id, and of those the smallest hash of its text.

    Rows without an id come after all others. Rows that agree in id and text are one document.
    """
    keys = ["_missing", "_id", "_text"]
    docs = docs.select(*COLUMNS).withColumns({"_missing": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_text": F.xxhash64("text")})
    prints = written(fingerprints(docs, also=("_text",)), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("_missing"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "_text")
    kept = rooted(prints, F.min(rank)).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return docs.join(kept, keys, "left_semi").dropDuplicates(keys).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: personal data in the texts is replaced by its kind."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pieces of packed sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dups),
    ("pii", pii),
    ("packing", packing),
]

#: Fingerprints, learnt spans and tokens can't be expressed in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
