"""WARC archives: writing, reading, and revisit resolution.

Method: archives are read, their *headers* (place, record id, payload digest, length) are shuffled by payload
digest, each digest's first record becomes the original, every other record of the digest is rewritten
as a ``revisit`` that refers to it, and the deduplicated archives are written with fresh headers. Reading
them back joins revisit records to their originals. Payloads are shuffled once, by their place (file and number in it),
which is unique; so a payload that a third of all pages share doesn't gather in one task, and record ids
that archives repeat do no harm.

Archives are read by Spark's text source and written by its text sink, so any store that Spark reaches can hold them. Every
record is a gzip member of its own, as readers that seek expect. A gzip file isn't split, so one task reads a file's
bytes in order; the reader holds one record at a time besides the current Arrow batch.

Defined results: a null payload is an empty one; a row without an id sorts after all others and is kept;
rows that repeat an id are records of their own, the first by (id, record id, place) is the original; an empty
table gives empty archives; columns other than the three named ones aren't read. Only ``response`` and ``resource``
records become revisits; all others, ``request`` and ``metadata`` among them, are written as they are. What a record's
header states beside the fields that resolution sets, its date, and its HTTP header stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import arrow_batches, id_order, passing, scratch_path, table, written

_TEXTS = ("rec_type", "record_id", "target_uri", "date", "refers_to", "refers_to_uri", "refers_to_date", "other")
RECORD_SCHEMA = ", ".join(f"{c} string" for c in _TEXTS) + ", http binary, payload binary, payload_bytes long, payload_digest string, file long, ordinal long"
_ARROW = pa.schema([*((c, pa.string()) for c in _TEXTS), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.int64()), ("ordinal", pa.int64())])
#: Fields of a header that are columns, or that follow from the block.
_SET = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-payload-digest", "warc-profile", "content-length"}
#: Records of these types may become revisits.
RESOLVED = ("response", "resource")
#: Level of compression of archives that last.
LEVEL = 6
EPOCH = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC writers put it in ``WARC-Payload-Digest`` after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(r: dict) -> bytes:
    """One record with the two line ends that close it, from a row of ``RECORD_SCHEMA``. A revisit carries the HTTP header alone.

    ``payload_digest`` may be null: it is then taken from the payload. A block digest that the block no longer has isn't repeated.
    """
    payload, revisit = r["payload"] or b"", r["rec_type"] == "revisit"
    block = (r["http"] or b"") + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {r['rec_type']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date'] or EPOCH}"]
    if r["target_uri"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["target_uri"]))
    head.append(f"WARC-Payload-Digest: sha1:{r['payload_digest'] or payload_digest(payload)}")
    if r["refers_to"] is not None:
        head.append(f"WARC-Refers-To: <{r['refers_to']}>")
        head += [f"{name}: {r[c]}" for name, c in (("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date")) if r[c] is not None]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += [line for line in (r["other"] or "").split("\r\n") if line and not (revisit and line.lower().startswith("warc-block-digest"))]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: An empty gzip member: behind a record of 16 MB or more, as the last byte of a member must be zero (see ``gzip_row``).
_NOTHING = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def gzip_row(record: bytes, level: int) -> bytes:
    """A gzip member less its last byte. That byte, the highest of the record's size, is zero, and the text sink adds it as line separator."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return (member if not member[-1] else member + _NOTHING)[:-1]


def write_archives(records: DataFrame, path: str, fast: bool = False) -> None:
    """Write rows of ``RECORD_SCHEMA`` (length and place aren't needed) as ``*.warc.gz`` archives below ``path``, a gzip member per record.

    ``fast`` compresses less, for archives that don't last.
    """
    level = 1 if fast else LEVEL

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                made = [gzip_row(build_record(r), level) for r in b.slice(i, 512).to_pylist()]
                yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])

    _write(records.select(*_TEXTS, "http", "payload", "payload_digest").mapInArrow(build, "value binary"), path)


def _write(rows: DataFrame, path: str) -> None:
    """Write rows ``value``, each from ``gzip_row``, as archives."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
    _named(rows.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Give the sink's files the names of what they are, by which readers know that they are compressed; one call to the file system each."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    for f in system.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")) or ():
        old = f.getPath()
        if not system.rename(old, jvm.org.apache.hadoop.fs.Path(folder, old.getName().removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"can't rename {old}")


class _Stream:
    """Cuts the bytes of one archive into records; holds at most one unfinished record."""

    def __init__(self) -> None:
        self.buf, self.at, self.need = bytearray(), 0, 0

    def feed(self, data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        self.buf += data
        while len(self.buf) - self.at >= self.need:
            while self.buf[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            end = self.buf.find(b"\r\n\r\n", self.at)
            if end < 0:
                break
            head = []
            for line in bytes(self.buf[self.at : end]).decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                head.append((k.strip(), v.strip()))
            length = dict((k.lower(), v) for k, v in head).get("content-length", "")
            stop = end + 4 + (int(length) if length.isascii() and length.isdigit() else 0)
            if len(self.buf) < stop:
                self.need = stop - self.at
                break
            yield head, bytes(self.buf[end + 4 : stop])
            self.at, self.need = stop, 0
        if self.at > 1 << 20:
            del self.buf[: self.at]
            self.at = 0


def _records(found: list[tuple[list[tuple[str, str]], bytes]], file: int, first: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``RECORD_SCHEMA``; ``first`` is the number of the first record in its file."""
    out: dict[str, list] = {f.name: [] for f in _ARROW}
    for n, (head, block) in enumerate(found, first):
        h = {k.lower(): v for k, v in head}
        kind = h.get("warc-type", "")
        http, payload = b"", block
        if h.get("content-type", "").startswith("application/http"):
            start, blank, payload = block.partition(b"\r\n\r\n")
            http = start + blank
        stored, bare = kind != "revisit", lambda k, h=h: h[k].strip("<>") if k in h else None
        row = {
            "rec_type": kind, "record_id": bare("warc-record-id") or "", "target_uri": bare("warc-target-uri"), "date": h.get("warc-date"),
            "refers_to": bare("warc-refers-to"), "refers_to_uri": bare("warc-refers-to-target-uri"), "refers_to_date": h.get("warc-refers-to-date"),
            "other": "\r\n".join(f"{k}: {v}" for k, v in head if k.lower() not in _SET), "http": http, "payload": payload if stored else None,
            "payload_bytes": len(payload) if stored else None, "payload_digest": payload_digest(payload) if stored else h.get("warc-payload-digest", "").rpartition(":")[2], "file": file, "ordinal": n,
        }
        for k, v in row.items():
            out[k].append(v)
    yield from arrow_batches(out, _ARROW, rows=1024)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all gzip archives below ``path``; columns as in ``RECORD_SCHEMA``. ``file`` (a hash of its name) and ``ordinal`` say where a record stands.

    A stored payload's digest and length are computed from its bytes; a revisit has no payload and the
    digest its header states. The line separator serves only to move bytes into rows: the parser joins
    them again and cuts records by ``Content-Length`` alone.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, file, n = _Stream(), None, 0
        for b in batches:
            files, lines = b.column(0).to_pylist(), b.column(1).to_pylist()
            start = 0
            while start < len(files):
                stop = len(files) if files[start] == files[-1] else next(i for i in range(start, len(files)) if files[i] != files[start])
                if files[start] != file:
                    stream, file, n = _Stream(), files[start], 0
                found = list(stream.feed(b"\n".join(lines[start:stop]) + b"\n"))
                for i in range(0, len(found), 512):
                    yield from _records(found[i : i + 512], file, n)
                    n += len(found[i : i + 512])
                start = stop

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(parse, RECORD_SCHEMA)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = EPOCH) -> DataFrame:
    """Pages as response records; the record id names the page and a row number that is unique in the table."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    none = F.lit(None).cast("string")
    made = {
        "rec_type": F.lit("response"),
        "record_id": F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string")),
        "target_uri": F.col(url_col).cast("string"),
        "date": F.lit(date),
        **dict.fromkeys(("refers_to", "refers_to_uri", "refers_to_date"), none),
        "other": F.lit("Content-Type: application/http; msgtype=response"),
        "http": F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary"),
        "payload": payload,
        "payload_digest": none,
    }
    return pages.select(*[c.alias(k) for k, c in made.items()])


def page_of(record_id: str) -> "F.Column":
    """The page id in a record id of ``page_records``; null where the page had none, and for all other ids."""
    parts = F.split(record_id, ":")
    return F.when(F.startswith(F.col(record_id), F.lit("urn:page:")), F.try_element_at(parts, F.lit(3)).try_cast("long"))


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read archives at ``source`` and write deduplicated ones with fresh headers at ``target``.

    Of the ``RESOLVED`` records with one payload digest and at least ``min_bytes`` bytes, that with the smallest
    (page id, record id, place) is kept; the others become revisits of it. Revisits that the source already holds
    stay revisits and refer to the original of their digest, if there is one.
    """
    records, place = read_archives(spark, source), ["file", "ordinal"]
    heads = written(records.select(*place, "rec_type", "record_id", "target_uri", "date", "payload_bytes", "payload_digest").withColumn("page_id", page_of("record_id")), "warc-heads")
    eligible = F.col("rec_type").isin(*RESOLVED) & (F.col("payload_bytes") >= min_bytes)
    originals = (
        heads.filter(eligible)
        .groupBy("payload_digest")
        .agg(F.min(F.struct(id_order("page_id").alias("o"), "record_id", *place, "target_uri", "date")).alias("first"))
    )
    first = lambda c: F.col(f"first.{c}")
    mine = (F.col("file") == first("file")) & (F.col("ordinal") == first("ordinal"))
    fate = (
        heads.join(originals, "payload_digest", "left")
        .filter((F.col("rec_type") == "revisit") | (eligible & first("file").isNotNull() & ~mine))
        .select(*place, F.lit(True).alias("old"), *[first(c).alias(f"to_{c}") for c in ("record_id", "target_uri", "date")])
    )
    headers = [*_TEXTS, "http", "payload_digest"]
    # a record that stays is packed before it is shuffled, so that what crosses the network is compressed as in an archive
    joined = records.select(*place, *headers, "payload").mapInArrow(_packed, f"file long, ordinal long, {', '.join(f'{c} string' for c in _TEXTS)}, http binary, payload_digest string, value binary").join(fate, place, "left")
    _write(joined.select("value", "old", "to_record_id", "to_target_uri", "to_date", *headers).mapInArrow(_settled, "value binary"), target)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the payload, by the record as it stands in an archive."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            made = [gzip_row(build_record(r), LEVEL) for r in part.to_pylist()]
            yield pa.record_batch([*part.columns[:-1], pa.array(made, pa.binary())], names=[*part.schema.names[:-1], "value"])


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed records as they are, or as revisits of the original that they were joined with; one without an original here keeps what it referred to."""
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            made, old = part.column(0).to_pylist(), part.column(1).to_pylist()
            for k, r in enumerate(part.to_pylist() if any(old) else ()):
                if r["old"] and r["to_record_id"] is not None:
                    made[k] = gzip_row(build_record(r | {"rec_type": "revisit", "payload": None, "refers_to": r["to_record_id"], "refers_to_uri": r["to_target_uri"], "refers_to_date": r["to_date"]}), LEVEL)
            yield pa.record_batch([pa.array(made, pa.binary())], names=["value"])


def pages_from_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of deduplicated archives: revisits take the length of their original by a join on its record id and digest."""
    heads = written(read_archives(spark, path).select("rec_type", "record_id", "refers_to", "payload_bytes", "payload_digest"), "warc-read")
    stored = heads.filter(F.col("rec_type") != "revisit").groupBy(F.col("record_id").alias("to"), F.col("payload_digest").alias("stored_digest")).agg(F.max("payload_bytes").alias("stored_bytes")).withColumn("to_page", page_of("to"))
    return heads.join(stored, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("stored_digest")), "left").select(
        page_of("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"),
        "payload_digest",
        F.col("rec_type").alias("record_type"),
        F.col("to_page").alias("refers_to"),
    )


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, deduplicated by revisit records, read back."""
    fresh = scratch_path(spark, "warc-fresh")
    with passing(spark):
        raw = scratch_path(spark, "warc-raw")
        write_archives(page_records(table(spark, sf_dir, "pages")), raw, fast=True)
        resolve_revisits(spark, raw, fresh)
    return pages_from_archives(spark, fresh)


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM b
"""
