"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding cuts a text by the vocabulary's pattern, encodes each match by itself and joins the ids; distinct
matches are remembered per worker (``wordcache``). Decoding reverses the byte table of byte-level BPE (a
bijection of the 256 bytes to printable characters, built by rule) and joins bytes, so characters
whose bytes are split over tokens come out whole. Offsets map tokens to bytes and to characters.

Defined results: a null text is empty (no ids); nulls in other columns don't matter, they aren't read;
repeated rows are returned as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import table
from scanlake.llm.wordcache import PieceEncoder


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next unused one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class ByteBpe(PieceEncoder):
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, vocab: str, pattern: str) -> None:
        super().__init__(vocab, regex.compile(pattern).findall, self.MARK, lambda p: p.removeprefix(" ").isalnum())
        back = {c: b for b, c in enumerate(byte_characters())}
        names = self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes_of = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_of[i] = name.encode() if name in special else bytes(back[c] for c in name)

    @classmethod
    def of(cls, vocab: str, pattern: str) -> "ByteBpe":
        """This worker's encoder; made once."""
        if (key := (cls, vocab, pattern)) not in cls._made:
            cls._made[key] = cls(vocab, pattern)
        return cls._made[key]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; concatenating the bytes of any cut of an id sequence gives the whole's."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """As text; bytes that make no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """For n ids, n + 1 byte offsets and n + 1 character offsets; a boundary inside a character counts that character as begun."""
        parts = [self.bytes_of[i] for i in ids]
        ends = np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        begun = np.r_[0, np.cumsum((np.frombuffer(b"".join(parts), np.uint8) & 0xC0) != 0x80, dtype=np.int64)]
        return ends, begun[ends]


def _paths(vocab: str | None, pattern: str | None) -> tuple[str, str]:
    return vocab or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, with_offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), and with offsets byte_offsets and char_offsets of token boundaries."""
    vocab, pattern = _paths(vocab, pattern)
    more = ", byte_offsets array<long>, char_offsets array<long>" * with_offsets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocab, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [x.astype(np.int32) for x in bpe.encode([x or "" for x in part.column(1).to_pylist()])]
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if with_offsets:
                    found = [bpe.offsets(x) for x in ids]
                    columns += [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.record_batch(columns, names=["doc_id", "ids", *["byte_offsets", "char_offsets"] * with_offsets])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>" + more)


def decode(rows: DataFrame, vocab: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary) from ids; null ids give no bytes. Ids outside the vocabulary raise."""
    vocab, pattern = _paths(vocab, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocab, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.decode_bytes(x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocab: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    vocab, pattern = _paths(vocab, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(vocab, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ns, ids_sha, text_sha = [], [], []
                for ids in bpe.encode([x or "" for x in part.column(1).to_pylist()]):
                    ns.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(ns, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
