"""Packing: concatenate and cut.

Two passes of prefix sums over partition token totals. The first pass encodes each text once and writes, per
document, its ids (two or four bytes each), its partition and its offset among the ids of that partition.
The totals of the partitions (one row per task) are summed up into each partition's first global
offset. The second pass places each document at its global offset and cuts it where windows of ``size``
tokens end; a document that crosses a window's end has one boundary record on either side. Only the
last sequence is padded.

Defined results: a null text is empty (its end token alone); a row without doc_id is packed like any
other and keeps its null; repeated rows are packed as often as they come; an empty table gives no
pieces; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import table, written
from scanlake.llm.wordcache import WordEncoder

SIZE = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, vocab: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, run, doc_id, n, ids): first pass. ``run``: ids before the document's in its partition."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, run = WordEncoder.of(vocab), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                piece = b.slice(i, 1024)
                ids, runs, ns = [], [], []
                for got in encoder.encode(pc.fill_null(piece.column(1), "")):
                    runs.append(run)
                    ns.append(len(got) + 1)
                    run += len(got) + 1
                    ids.append(got.tobytes() + end)
                yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), pa.array(runs, pa.int64()), piece.column(0), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], names=["part", "run", "doc_id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "part int, run long, doc_id long, n long, ids binary")


def placed(first_pass: DataFrame) -> DataFrame:
    """Second prefix sum: adds ``begin``, the document's first global offset.

    The window runs over one row per partition of the first pass, never over documents; that table is sent to all
    executors, as it has no more rows than the first pass had tasks. So ids are not shuffled at all.
    """
    totals = first_pass.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return first_pass.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("run")).alias("begin"), "n", "ids")


def pack(docs: DataFrame, vocab: str | None = None, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences; ``keep_ids`` adds each piece's ids as ``ids array<int>``."""
    vocab = vocab or public_tokenizers.path("word_bpe_49k.json")
    first_pass = written(encoded(docs, vocab, end_id, id_col, text_col), "packing")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, begin, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(begin + start, size)
                    stop = min(n, start + size - offset)
                    part = ids[start:stop]
                    rows.append((doc_id, start, stop - start, zlib.crc32(part.tobytes()), n, seq, offset, *([part.tolist()] if keep_ids else [])))
                    start = stop
            columns = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in PIECES.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            if rows:
                yield pa.record_batch(arrays, names=names + ["ids"] * keep_ids)

    return placed(first_pass).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
