"""Reading Part-10 files as tables: ``files`` (bytes), ``parsed`` (one row per file), ``elements`` (one row per element).

Files come from Spark's binary source; a file is walked once, in Arrow batches, into a row without pixels, so
no later shuffle carries file contents. How bytes are read is in ``sources.walker``. A file on which the walk itself
fails has a ``parse_error`` that says so; it never ends the scan of the others.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.dims import PAYLOAD_MIN
from scanlake.functions.payloads import element_text, payload_threat
from scanlake.sources.walker import KEYWORDS, PIXELS, Element, Parsed, length_walk, parse

#: Bytes of the largest file whose content Spark's binary source gives.
CONTENT_MOST = 2**31 - 1


def _empty_files(spark: SparkSession, source: DataFrame) -> DataFrame:
    """(file_id) of the empty files: Spark's driver lists them, but gives no rows for them."""
    listed = spark.createDataFrame([(p,) for p in source.inputFiles()], "value string")
    # the list has encoded URIs, rows have plain paths
    path = F.regexp_replace(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    return listed.select(path.alias("file_id")).join(source.select(F.col("path").alias("file_id")), "file_id", "left_anti")


def scan_files(spark: SparkSession, path: str, glob: str = "*.dcm", most_bytes: int | None = None, empty: bool = False) -> DataFrame:
    """(file_id, filename, file_size, content): files below ``path`` or one file, of any size; larger ones are left out if ``most_bytes`` is set.

    With ``empty``, empty files have a row too, which a scan reports as unreadable; without it they are left out.
    Files over ``CONTENT_MOST`` bytes can't be a value of a row: their content is null, and a scan reports them as unreadable.
    """
    files = source = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    columns = [F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size")]
    # the source fails on contents beyond that size, unless it isn't asked for them
    beyond = files.filter(F.col("length") > CONTENT_MOST).select(*columns, F.lit(None).cast("binary").alias("content"))
    found = files.filter(F.col("length") <= CONTENT_MOST).select(*columns, "content").union(beyond)
    return found.union(_empty_files(spark, source).select("file_id", F.element_at(F.split("file_id", "/"), -1), F.lit(0).cast("long"), F.lit(b""))) if empty else found


PARSED = (
    "walk struct<state: string, at: long, declared: long, remaining: long>, syntax string, sop_class string, attrs map<string, string>, seq_depth int, pixel_len long, pixel_sha256 string, "
    "private array<struct<grp: int, elem: int, vr: string, len: long, text: string, severity: string, threat: string>>, parse_error string"
)
_PRIVATE = pa.struct([("grp", pa.int32()), ("elem", pa.int32()), ("vr", pa.string()), ("len", pa.int64()), ("text", pa.string()), ("severity", pa.string()), ("threat", pa.string())])
PARSED_FIELDS = [
    ("walk", pa.struct([("state", pa.string()), ("at", pa.int64()), ("declared", pa.int64()), ("remaining", pa.int64())])),
    ("syntax", pa.string()),
    ("sop_class", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("seq_depth", pa.int32()),
    ("pixel_len", pa.int64()),
    ("pixel_sha256", pa.string()),
    ("private", pa.list_(_PRIVATE)),
    ("parse_error", pa.string()),
]


def describe(data: bytes, measure: Callable[[Parsed | None], dict] | None = None) -> dict:
    """What the rules need of one file, as a row of ``PARSED``, and what ``measure`` says of it."""
    p = None
    try:
        p = parse(data)
        row = _described(data, p)
    except Exception as e:  # noqa: BLE001  a hostile file is reported, and the scan goes on
        row = dict.fromkeys([k for k, _ in PARSED_FIELDS]) | {"walk": {"state": "absent", "at": 0, "declared": 0, "remaining": 0}, "seq_depth": 0, "parse_error": f"the walk failed: {type(e).__name__}: {e}"[:200]}
    return row | measure(p) if measure else row


def _described(data: bytes, p: Parsed) -> dict:
    attrs, private = {}, []
    for x in p.elements:
        if x.tag in KEYWORDS:
            text = x.text()
            attrs.setdefault(KEYWORDS[x.tag], text if text is not None else ("item" * bool(x.items) if x.items is not None else element_text(x.value if isinstance(x.value, bytes) else b"") or ""))
        if x.tag[0] % 2 and isinstance(x.value, bytes) and x.items is None:
            own = x.text()
            opaque = own is None
            threat = payload_threat(x.value) if opaque and len(x.value) >= PAYLOAD_MIN else None
            private.append({"grp": x.tag[0], "elem": x.tag[1], "vr": x.vr, "len": len(x.value), "text": element_text(x.value) if opaque else own, "severity": threat and threat[0], "threat": threat and threat[1]})
        elif x.tag[0] % 2:
            private.append({"grp": x.tag[0], "elem": x.tag[1], "vr": x.vr, "len": 0, "text": None, "severity": None, "threat": None})
    pixels = next((x.value for x in p.elements if x.tag == PIXELS), None)
    size, digest = None, None
    if pixels is not None:
        hashed = hashlib.sha256()
        for part in [pixels] if isinstance(pixels, bytes) else [y for f in pixels for y in (struct.pack("<HHI", 0xFFFE, 0xE000, len(f)), f)]:
            hashed.update(part)
        size, digest = len(pixels) if isinstance(pixels, bytes) else sum(8 + len(f) for f in pixels), hashed.hexdigest()
    meta = next((x for x in p.meta if x.tag == (0x0002, 0x0002)), None)
    state, at, declared, remaining = length_walk(data)
    return {
        "walk": {"state": state, "at": at, "declared": declared, "remaining": remaining},
        "syntax": p.syntax,
        "sop_class": (meta.value.strip(b"\0 ").decode("ascii", "ignore") if meta else None) or attrs.get("SOPClassUID"),
        "attrs": list(attrs.items()),
        "seq_depth": p.depth,
        "pixel_len": size,
        "pixel_sha256": digest,
        "private": private,
        "parse_error": p.error,
    }


def parsed(files: DataFrame, keep_content: bool = False, measure=None) -> DataFrame:
    """``files`` with ``sha256``, ``preamble`` (132 bytes) and ``PARSED``; without ``content`` unless it is kept.

    ``measure`` adds columns from the same pass: it has ``fields`` (Arrow), ``schema`` (DDL) and is called with the parsed file.
    """
    keep = [c for c in files.columns if c != "content"]
    rows = files.select(*keep, F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 132).alias("preamble"), "content")
    stay = rows.columns if keep_content else rows.columns[:-1]
    fields = [*PARSED_FIELDS, *(measure.fields if measure else ())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [describe(x or b"", measure) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[: len(stay)], *[pa.array([f[k] for f in found], t) for k, t in fields]], names=[*stay, *[k for k, _ in fields]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in stay)
    return rows.mapInArrow(run, ", ".join([kept, PARSED, *([measure.schema] if measure else [])]))


def elements(files: DataFrame) -> DataFrame:
    """One row per element, nested ones too: (file_id, path, depth, grp, elem, vr, value_bytes, value_text, value_len, n_items, is_meta)."""
    schema = "file_id string, path array<string>, depth int, grp int, elem int, vr string, value_bytes binary, value_text string, value_len long, n_items int, is_meta boolean"
    types = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]

    def flat(file_id: str, xs: list[Element], meta: bool) -> Iterator[tuple]:
        for x in xs:
            raw = b"".join(x.value) if isinstance(x.value, list) else x.value
            opaque = x.items is None and x.tag != PIXELS
            yield file_id, list(x.path), len(x.path), *x.tag, x.vr, raw if opaque else None, x.text(), len(raw), None if x.items is None else len(x.items), meta
            for item in x.items or ():
                yield from flat(file_id, item, meta)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            for file_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    p = parse(data or b"")
                except Exception:  # noqa: BLE001  as in ``describe``: such a file has no elements
                    continue
                rows = [*flat(file_id, p.meta, True), *flat(file_id, p.elements, False)]
                for i in range(0, len(rows), 2048):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2048], strict=True), types, strict=True)], names=names)

    return files.select("file_id", "content").mapInArrow(run, schema)
