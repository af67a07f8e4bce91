"""WARC: archives against a brute-force version, records against an exact round trip."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

from scanlake.llm import warc

ROWS = [
    (3, "http://a/x y", "<p>one</p>"),
    (1, "http://a/1", "<p>one</p>"),
    (2, None, None),
    (9, "http://b", ""),
    (5, "http://c", "a\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nb\r\n"),
    (6, "http://c", "a\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nb\r\n"),
    (7, "http://ü", "é\n" * 3000),
    (None, "http://n", "<p>one</p>"),
    (7, "http://ü", "é\n" * 3000),
    (8, "http://z", "\n\n\r\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def brute(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    out, seen = [], {}
    for pid, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        d = digest(html)
        first = d not in seen
        seen.setdefault(d, pid)
        out.append((pid, len((html or "").encode()), d, "response" if first else "revisit", None if first else seen[d]))
    return sorted(out, key=str)


def cycle(spark, tmp_path, rows, **more):
    warc.write_archives(warc.page_records(frame(spark, rows)), str(tmp_path / "raw"))
    warc.resolve_revisits(spark, str(tmp_path / "raw"), str(tmp_path / "fresh"), **more)
    return sorted(map(tuple, warc.pages_from_archives(spark, str(tmp_path / "fresh")).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    assert cycle(spark, tmp_path, ROWS) == brute(ROWS)


def test_empty_table(spark, tmp_path):
    assert cycle(spark, tmp_path, []) == []


def test_small_payloads_stay(spark, tmp_path):
    got = cycle(spark, tmp_path, ROWS, min_bytes=1000)
    assert {r[0] for r in got if r[3] == "revisit"} == {7}


def test_archives_are_standard_records(spark, tmp_path):
    cycle(spark, tmp_path, ROWS)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "fresh").glob("*.gz"))
    at = n = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b":")[1])
        at += len(head) + 4 + size
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(ROWS)


def test_reader_takes_real_layouts(spark, tmp_path):
    """Records gzipped one by one, another version, no HTTP block, extra blank lines."""
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nab\n\nc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(b"\r\n" + record))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["rec_type"], r["record_id"], bytes(r["payload"])) for r in got] == [("resource", "urn:x", b"ab\n\nc")] * 2
    assert len({(r["file"], r["ordinal"]) for r in got}) == 2


def raw(kind, record_id, block, *more, type="application/http; msgtype=response"):
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-02T03:04:05Z", "WARC-Target-URI: http://x/" + record_id[-1], f"Content-Type: {type}", *more, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_foreign_archives(spark, tmp_path):
    """Ids that aren't ours and repeat; other record types; headers, dates and binary payloads stay."""
    page = b"HTTP/1.1 404 Not Found\r\nX-A: b\r\n\r\n" + bytes(range(256))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.warc.gz").write_bytes(
        raw("request", "urn:x", b"GET / HTTP/1.1\r\n\r\n" + bytes(range(256)), "WARC-Concurrent-To: <x>", type="application/http; msgtype=request") + raw("response", "urn:a", page, "WARC-IP-Address: 1.2.3.4", "WARC-Block-Digest: sha1:AAA")
        + raw("response", "urn:x", page, "WARC-Block-Digest: sha1:AAA") + raw("response", "urn:x", page) + raw("response", "urn:z", b"HTTP/1.1 200 OK\r\n\r\nother") + raw("metadata", "x", b"m", type="text/plain")
    )
    warc.resolve_revisits(spark, str(tmp_path / "raw"), str(tmp_path / "fresh"))
    got = sorted(warc.read_archives(spark, str(tmp_path / "fresh")).collect(), key=lambda r: r["ordinal"])
    assert sorted((r["rec_type"], r["record_id"], r["refers_to"]) for r in got) == [("metadata", "x", None), ("request", "urn:x", None), ("response", "urn:a", None), ("response", "urn:z", None), ("revisit", "urn:x", "urn:a"), ("revisit", "urn:x", "urn:a")]
    by = {(r["rec_type"], r["record_id"]): r for r in got}
    kept, old = by["response", "urn:a"], by["revisit", "urn:x"]
    assert bytes(kept["payload"]) == bytes(range(256)) and kept["date"] == "2020-01-02T03:04:05Z" and "WARC-IP-Address: 1.2.3.4" in kept["other"] and "Block-Digest" in kept["other"]
    assert bytes(old["http"]) == b"HTTP/1.1 404 Not Found\r\nX-A: b\r\n\r\n" and (old["refers_to_uri"], old["refers_to_date"]) == ("http://x/a", "2020-01-02T03:04:05Z") and "Block-Digest" not in old["other"]
    assert len(warc.pages_from_archives(spark, str(tmp_path / "fresh")).collect()) == 6
    # resolving again changes nothing
    warc.resolve_revisits(spark, str(tmp_path / "fresh"), str(tmp_path / "again"))
    assert sorted((r["rec_type"], r["record_id"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "again")).collect()) == sorted((r["rec_type"], r["record_id"], r["refers_to"]) for r in got)


def test_a_member_per_record(spark, tmp_path):
    cycle(spark, tmp_path, ROWS)
    members = 0
    for p in Path(tmp_path / "fresh").glob("*.warc.gz"):
        data = p.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.1\r\n")
            data, members = one.unused_data, members + 1
    assert members == len(ROWS)
    large = b"WARC" + b"x" * (1 << 24)
    assert gzip.decompress(warc.gzip_row(large, 1) + b"\0" + warc.gzip_row(b"y", 1) + b"\0") == large + b"y"
