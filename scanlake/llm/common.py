"""Shared helpers: scratch tables in the cluster's shared folder, table loading, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.scratch import clear_scratch, passing, scratch_path, shared_dir, written

__all__ = ["arrow_batches", "clear_scratch", "id_order", "passing", "pinned", "quoted", "scratch_path", "shared_dir", "table", "text_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path can be any that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(columns: dict[str, Iterable], schema: pa.Schema, rows: int = 4096) -> Iterable[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows from equally long columns."""
    whole = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from whole.to_batches(max_chunksize=rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_order(column: str) -> "F.Column":
    """Sorts ids upwards and rows without an id last; comparable inside a struct."""
    return F.struct(F.col(column).isNull().alias("missing"), F.col(column).alias("id"))


def quoted(name: str) -> str:
    """A column's name as it must be written in expressions, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def pinned(df: DataFrame, columns: dict[str, "F.Column"], keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` and ``columns``, each computed once per row.

    A filter above a projection is moved below it with every expression it uses written out again; nested
    expressions then grow without bound. Nothing is moved through this one-row generator.
    """
    kept = [F.col(quoted(c)) for c in keep]
    made = F.explode(F.array(F.struct(*kept, *[v.alias(k) for k, v in columns.items()]))).alias("_pinned")
    return df.select(made).select("_pinned.*")
