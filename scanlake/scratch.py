"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []
#: Paths of the innermost ``passing`` block.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process on one machine (tests) a temporary folder is made and
    set as the checkpoint folder of the context; on a cluster it would be another folder for each executor, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scanlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/scanlake-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    if (mine := _PASSING.get()) is not None:
        mine.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written within this block are deleted at its end; what outlives it must be written to a path taken before."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        paths = _PASSING.get()
        _PASSING.reset(token)
        for path in paths:
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch() -> None:
    """Delete every scratch folder of this process. Frames that still read them can't be used afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before; nothing can be done then
            return


atexit.register(clear_scratch)
