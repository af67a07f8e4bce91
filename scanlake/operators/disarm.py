"""Content disarm and reconstruction: gates, decoding in a child process, private-element filter, rewriting, re-scan.

All of it is one pass over the files: what is parsed keeps its contents, the gates are Columns on the same row, and only
contents that pass them go on to the operator that rebuilds. Nothing is shuffled, and nothing is read twice.

Compressed pixels are decoded by a child process with limits on memory, CPU and time, so a crash or a hang
there ends in quarantine, not in a failed task. A task keeps one such process as long as it behaves. Only RLE and deflate
have decoders here; every other compressed syntax is quarantined.
"""

from __future__ import annotations

import hashlib
import os
import select
import subprocess
import sys
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanlake.dims import DEFLATED_LE, EXPLICIT_LE, IMPLICIT_LE, LOSSLESS_ENCAPSULATED, NATIVE_FOR_REBUILD, RLE, SAFE_CREATORS
from scanlake.findings import dangerous
from scanlake.functions.payloads import payload_threat
from scanlake.operators import security
from scanlake.operators.decoding import MEMORY, native_pixels
from scanlake.sources import dicom
from scanlake.sources.walker import PIXELS, Element, parse
from scanlake.sources.writer import data_set, part10

#: Seconds for one file in a decoder process.
TIMEOUT = 30
#: Rebuilt files and bytes of them that go on together at most.
BATCH, BATCH_BYTES = 64, 32 * 1024**2
#: Compressed syntaxes that can be decoded here.
DECODABLE = [DEFLATED_LE, RLE]
WORKER = "from scanlake.operators.decoding import main; main()"


def source_is_lossless(syntax: Column) -> Column:
    """Whether leaving this syntax keeps the pixels as acquired; unknown ones don't count."""
    return syntax.isin(*NATIVE_FOR_REBUILD, DEFLATED_LE, *LOSSLESS_ENCAPSULATED)


def filter_private(elements: list[Element], allowed: Iterable[str] = SAFE_CREATORS) -> tuple[list[Element], list[tuple[int, int]]]:
    """(kept elements, removed tags): default deny by creator, no payload even under an allowed one, no orphaned creator.

    Private elements numbered below 0x1000 that aren't creators are left alone, like all elements inside sequences.
    """
    allowed = set(allowed)
    is_creator = lambda x: x.tag[0] % 2 == 1 and 0x10 <= x.tag[1] <= 0xFF
    creators = {x.tag: x.text() or (x.value.decode("latin-1").rstrip("\0 ") if isinstance(x.value, bytes) else "") for x in elements if is_creator(x)}
    kept, removed, blocks = [], [], set()
    for x in elements:
        if x.tag[0] % 2 and x.tag[1] >= 0x1000:
            block = (x.tag[0], x.tag[1] >> 8)
            opaque = x.items is None and isinstance(x.value, bytes) and x.text() is None
            if creators.get(block) in allowed and not (opaque and payload_threat(x.value)):
                blocks.add(block)
            else:
                removed.append(x.tag)
                continue
        kept.append(x)
    orphans = [x.tag for x in kept if is_creator(x) and x.tag not in blocks]
    gone = set(orphans)
    return [x for x in kept if x.tag not in gone], removed + orphans


class Sandbox:
    """Decoder processes, one at a time, started when needed; an answer is a file's native pixels or the reason why there are none."""

    def __init__(self, timeout: float = TIMEOUT, worker: str = WORKER) -> None:
        self.timeout, self.worker, self.child, self.served = timeout, worker, None, 0

    def __enter__(self) -> "Sandbox":
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def pixels(self, data: bytes) -> tuple[bytes | None, str]:
        """(native pixels or null, reason). A file at which a process that served others before fails is tried once more in a fresh one, which tells whether it is to blame."""
        before = self.served
        raw, how = self._ask(data)
        if raw is None and before:
            raw, how = self._ask(data)
        return (raw, "ok") if raw else (None, how if raw is None else "not decodable")

    def _end(self) -> int | None:
        child, self.child, self.served = self.child, None, 0
        if child is None:
            return None
        child.kill()  # nothing happens to one that has ended by itself
        code = child.wait()
        child.stdin.close()
        child.stdout.close()
        return code

    def _ask(self, data: bytes) -> tuple[bytes | None, str]:
        if self.child is None:
            self.child = subprocess.Popen([sys.executable, "-c", self.worker], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0, env=os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, sys.path))})
            os.set_blocking(self.child.stdin.fileno(), False)
        try:
            raw = self._exchange(data)
        except TimeoutError:
            self._end()
            return None, "hung"
        if raw is None:
            try:
                code = self.child.wait(1)  # its output has ended, so it has or is about to
            except subprocess.TimeoutExpired:
                code = None
            self._end()
            return None, "no output" if not code else f"crash(sig{-code})" if code < 0 else f"failed({code})"
        self.served += 1
        return raw, "ok"

    def _exchange(self, data: bytes) -> bytes | None:
        """Send a file and take the answer, both as they come; null if the process ends before."""
        source, target = self.child.stdout.fileno(), self.child.stdin.fileno()
        poll, until = select.poll(), time.monotonic() + self.timeout
        poll.register(source, select.POLLIN)
        poll.register(target, select.POLLOUT)
        parts, got, need = [memoryview(len(data).to_bytes(8, "little")), memoryview(data)], bytearray(), 8
        while len(got) < need:
            events = poll.poll(max(0, until - time.monotonic()) * 1000)
            if not events:
                raise TimeoutError
            for fd, _ in events:
                if fd == target:
                    try:
                        parts[0] = parts[0][os.write(target, parts[0]) :]
                    except BrokenPipeError:
                        parts = []  # the process has ended; what it still said is read
                    while parts and not parts[0]:
                        parts.pop(0)
                    if not parts:
                        poll.unregister(target)
                elif more := os.read(source, 1 << 20):
                    got += more
                    if need == 8 <= len(got):
                        need += int.from_bytes(got[:8], "little")
                        if need > MEMORY:
                            return None  # no decoder within its limits gives that much
                else:
                    return None
        return bytes(got[8:need])


def sandboxed_pixels(files: list[bytes], timeout: float = TIMEOUT, worker: str = WORKER) -> list[tuple[bytes | None, str]]:
    """(native pixels or null, reason) of each file, from decoder processes."""
    with Sandbox(timeout, worker) as box:
        return [box.pixels(x) for x in files]


def rebuild(data: bytes, strip_private: bool = True, sandbox: Sandbox | None = None) -> dict:
    """A file's clean copy: ``output`` or ``error``, ``changes``, ``private_removed``, ``transcoded``, ``image_preserved``."""
    out = {"output": None, "changes": [], "private_removed": 0, "transcoded": False, "image_preserved": None, "error": None}
    try:
        return _rebuilt(data, strip_private, sandbox, out)
    except Exception as e:  # noqa: BLE001  what can't be rebuilt is quarantined, and the others go on
        return out | {"output": None, "error": f"not rebuilt: {type(e).__name__}: {e}"[:200]}


def _rebuilt(data: bytes, strip_private: bool, sandbox: Sandbox | None, out: dict) -> dict:
    p = parse(data)
    syntax, elements = p.syntax, p.elements
    if p.error:
        return out | {"error": f"unreadable: {p.error}"}
    if syntax and syntax not in NATIVE_FOR_REBUILD:
        if syntax not in DECODABLE:
            return out | {"error": f"not decoded: no decoder for {syntax}"}
        pixels, reason = sandbox.pixels(data) if sandbox else sandboxed_pixels([data])[0]
        if pixels is None:
            return out | {"error": f"not decoded: {reason}"}
        out["transcoded"], out["changes"] = True, [f"{syntax} to {EXPLICIT_LE}"]
        elements = [Element(x.tag, "OW", pixels) if x.tag == PIXELS else x for x in elements]
        syntax = EXPLICIT_LE
    else:
        pixels = native_pixels(p)
    if strip_private:
        elements, removed = filter_private(elements)
        out["private_removed"] = len(removed)
        out["changes"] += [f"{len(removed)} private elements removed"] if removed else []
    meta = {x.tag: x.value.rstrip(b"\0 ").decode("ascii", "ignore") for x in p.meta if isinstance(x.value, bytes)}
    made = part10(data_set(elements, syntax or IMPLICIT_LE), syntax, sop_class=meta.get((2, 2), ""), sop_instance=meta.get((2, 3), ""))
    out["changes"].append("preamble zeroed")
    out["image_preserved"] = pixels is not None and native_pixels(parse(made)) == pixels
    return out | {"output": made}


REBUILT = "output binary, changes array<string>, private_removed int, transcoded boolean, image_preserved boolean, error string"
REBUILT_FIELDS = [("output", pa.binary()), ("changes", pa.list_(pa.string())), ("private_removed", pa.int32()), ("transcoded", pa.bool_()), ("image_preserved", pa.bool_()), ("error", pa.string())]


def refused() -> Column:
    """Why a parsed file isn't rebuilt at all; null if it may be. Files without pixels, or with a length or allocation bomb, aren't."""
    blocking = dangerous(F.concat(security.pixel_dimension_bomb(), security.length_amplification()))
    why = F.when(F.col("parse_error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("parse_error"))).when(F.col("pixel_len").isNull(), "no image").when(blocking, "allocation or length bomb")
    return F.concat(F.lit("not disarmed: "), why)


def source_lossy() -> Column:
    """Whether a parsed file's syntax has lost what was acquired; null for native ones."""
    syntax = F.coalesce("syntax", F.lit(""))
    return F.when((syntax == "") | syntax.isin(NATIVE_FOR_REBUILD), None).otherwise(~source_is_lossless(syntax))


def rebuilt(rows: DataFrame, strip_private: bool = True, rescan: bool = False) -> DataFrame:
    """``rows`` with ``REBUILT`` in place of ``content``; nulls where the content is null. With ``rescan`` also ``sha256``, ``preamble`` and ``dicom.PARSED`` of the copies."""
    fields, at = list(REBUILT_FIELDS), rows.columns.index("content")
    keep = [f for f in rows.schema if f.name != "content"]
    if rescan:
        fields += [("sha256", pa.string()), ("preamble", pa.binary()), *dicom.PARSED_FIELDS]
    nothing = dict.fromkeys([k for k, _ in fields])

    def copy(data: bytes | None, box: Sandbox) -> dict:
        if data is None:
            return nothing
        made = rebuild(data, strip_private, box)
        if not rescan or made["output"] is None:
            return nothing | made
        return made | {"sha256": hashlib.sha256(made["output"]).hexdigest(), "preamble": made["output"][:132]} | dicom.describe(made["output"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Sandbox() as box:
            for b in batches:
                others, done, size, start = [c for i, c in enumerate(b.columns) if i != at], [], 0, 0
                for i, content in enumerate(b.column(at)):
                    done.append(copy(content.as_py(), box))
                    size += len(done[-1]["output"] or b"")
                    if len(done) == BATCH or size > BATCH_BYTES or i == b.num_rows - 1:
                        yield pa.record_batch([*[c.slice(start, len(done)) for c in others], *[pa.array([r[k] for r in done], t) for k, t in fields]], names=[*[f.name for f in keep], *[k for k, _ in fields]])
                        done, size, start = [], 0, i + 1

    more = StructType.fromDDL(", ".join([REBUILT, *(["sha256 string, preamble binary", dicom.PARSED] if rescan else [])]))
    return rows.mapInArrow(run, StructType([*keep, *more.fields]))


def disarm(files: DataFrame, strip_private: bool = True) -> DataFrame:
    """(file_id, syntax, ``REBUILT``, source_lossy) of every file of ``files`` (with ``content``); one that is refused has an error that says why."""
    rows = dicom.parsed(files, keep_content=True).select("file_id", "syntax", source_lossy().alias("source_lossy"), refused().alias("_refused"), "content")
    made = rebuilt(rows.withColumn("content", F.when(F.col("_refused").isNull(), F.coalesce("content", F.lit(b"")))), strip_private)
    return made.withColumn("error", F.coalesce("_refused", "error")).drop("_refused")


def fidelity(row: Column) -> Column:
    """n/a, bit-exact or CHANGED from ``image_preserved``."""
    return F.when(row.isNull(), "n/a").when(row, "bit-exact").otherwise("CHANGED")


def fidelity_bucket() -> Column:
    """skipped, lossy_preserved, lossy_changed, lossless_bitexact or lossless_BREAK of a disarmed row."""
    lossy = F.coalesce("source_lossy", F.lit(False))
    return F.when(F.col("output").isNull(), "skipped").when(lossy & F.col("image_preserved"), "lossy_preserved").when(lossy, "lossy_changed").when(F.col("image_preserved"), "lossless_bitexact").otherwise("lossless_BREAK")


def pixel_hash(data: bytes) -> str | None:
    """SHA-256 of a file's native pixels."""
    raw = native_pixels(parse(data))
    return None if raw is None else hashlib.sha256(raw).hexdigest()
