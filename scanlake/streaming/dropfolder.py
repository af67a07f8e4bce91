"""An extension: the scan as a stream over a folder into which files are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanlake.plans.scan import scan

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def dropped_files(spark: SparkSession, path: str, glob: str = "*.dcm", most_bytes: int = 500 * 1024**2, late: str = "1 day") -> DataFrame:
    """New files as a stream; a content that came within ``late`` isn't taken again, so the state stays bounded."""
    rows = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = rows.filter(F.col("length").between(1, most_bytes)).withColumn("_hash", F.sha2("content", 256))
    fresh = rows.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["_hash"])
    return fresh.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content")


def scan_stream(spark: SparkSession, path: str, target: str, checkpoint: str, deid: bool = False, available_now: bool = True) -> StreamingQuery:
    """Scan every new file once and append its report to ``target`` as Parquet, a folder per micro-batch.

    A batch that is run again overwrites its own folder, so reports are written exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scan(batch, deid=deid).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = dropped_files(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
