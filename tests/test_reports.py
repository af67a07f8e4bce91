"""Corpora and reports."""

import hashlib
import json

from pyspark.sql import functions as F
from scanlake.operators import disarm, reports
from scanlake.plans import scan as plans
from scanlake.sources import corpora, dicom, fixtures

AS_OF = "2025-01-01"


def test_corpora(spark, tmp_path):
    for name, data in (("a.dcm", fixtures.plain()), ("b.dcm", fixtures.plain()), ("polyglot_pixel_dimension.dcm", fixtures.plain(preamble=b"MZ")), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    files = corpora.gather(spark, [str(tmp_path)])
    assert sorted(r[0] for r in files.select("filename").collect()) == ["a.dcm", "polyglot_pixel_dimension.dcm"]
    got = {r["filename"]: (r["attack_class"], r["expected_verdict"]) for r in corpora.labels_by_name(files).collect()}
    assert got == {"a.dcm": ("unknown", "block"), "polyglot_pixel_dimension.dcm": ("dimension_bomb", "block")}
    (tmp_path / "m.json").write_text(json.dumps([{"name": "a.dcm", "attack_class": "x", "expected_verdict": "clean", "note": ""}, {"name": "gone.dcm", "attack_class": "x", "expected_verdict": "warn", "note": ""}]))
    assert [r["filename"] for r in corpora.labels_from_manifest(spark, str(tmp_path / "m.json"), files).collect()] == ["a.dcm"]
    assert corpora.load_baselines(spark, str(tmp_path / "none")).count() == 0
    found = plans.scan(files, deid=True, as_of=AS_OF)
    corpora.write_reports(found, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all(("details" in f) == (f.get("details") is not None) for r in lines for f in r["findings"])
    audit = {r["d"]: r for r in reports.reid_audit(found.withColumn("d", F.lit("x")), "d").collect()}
    assert audit["x"]["n"] == 2 and audit[None]["is_total"] == 1 and audit["x"]["struct_pts_prevalence"] == 1.0
    told = found.select(*[c.alias(k) for k, c in reports.score_descriptors().items()]).first()
    assert told["structured"] == "45 points from profile tags" and told["face"] == "not a head scan"


def test_fidelity_and_rates(spark):
    rows = [("rle", fixtures.plain(fixtures.IMPLICIT_LE + ".5", [b"", fixtures.rle_frame(fixtures.slice_pixels())])), ("plain", fixtures.plain()), ("j2k", fixtures.plain(fixtures.JPEG2000, [b"", b"\0" * 64]))]
    files = spark.createDataFrame([(k, k, 1, d) for k, d in rows], "file_id string, filename string, file_size long, content binary")
    made = disarm.disarm(files)
    got = {r["syntax"]: r for r in reports.fidelity_report(made, ["syntax"]).collect()}
    assert got[None]["lossless_bitexact"] == 2 and got[fixtures.JPEG2000]["skipped"] == 1 and got[None]["is_total"] == 1
    rates = {r["subset"]: r for r in reports.mixed_rates(dicom.parsed(files).select(F.lit("block").alias("verdict"), "syntax", F.size("private").alias("n_private"))).collect()}
    assert rates["all"]["block_rate"] == 1.0 and rates["compressed"]["n"] == 2 and "private" not in rates


def test_outcomes_and_formats(spark):
    trace = "==1==ERROR: AddressSanitizer: heap-buffer-overflow\n#0 0x1f in opj_a x\n#1 0x2 in b y\n#2 0x3 in c\n#3 0x4 in d\n#4 0x5 in e\n"
    rows = spark.createDataFrame([(None, ""), (0, "ok"), (1, "bad"), (-11, ""), (-9, ""), (1, trace), (1, "allocation-size-too-big"), (1, "x.c: runtime error: shift")], "c int, t string")
    got = [tuple(r) for r in rows.select(reports.decoder_outcome(F.col("c"), F.col("t")), reports.stack_hash(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["HANG", "ok", "rejected", "CRASH/sig11", "OOM/kill", "CRASH/ASan:heap-buffer-overflow", "OOM/alloc", "CRASH/ASan:fault"]
    assert got[5][1] == hashlib.sha1(b"opj_a b c d").hexdigest()[:12] and got[0][1] == ""
    one = spark.range(1).select(reports.percent(F.lit(2), F.lit(3)), reports.percent(F.lit(0), F.lit(0)), reports.interval(F.lit(0.954), F.lit(1.0))).first()
    assert tuple(one) == ("2/3 (66%)", "0/0", "95.4 to 100.0%")
    t = reports.throughput(spark.createDataFrame([(0.5, 1024**2), (1.5, 3 * 1024**2)], "seconds double, file_size long")).first()
    assert (t["files_per_second"], t["mib_per_second"], round(t["p95"], 9)) == (1.0, 2.0, 1.45)
    pairs = spark.createDataFrame([((45, 45, 0, 0, 0), (0, 0, 0, 0, 0), True, True)], "before struct<score: int, struct_pts: int, text_pts: int, burned_pts: int, face_pts: int>, after struct<score: int, struct_pts: int, text_pts: int, burned_pts: int, face_pts: int>, same_pixels boolean, changed boolean")
    assert reports.before_after(pairs).first()["before_score"] == 45.0


def test_actions_and_first_dangerous_files(spark):
    from scanlake import findings

    rows = spark.createDataFrame([("disarmed",), (None,), (None,), ("clean",)], "action string")
    assert {r["action"]: r["n"] for r in findings.action_distribution(rows).collect()} == {"disarmed": 1, "scanned": 2, "clean": 1}
    found = "findings array<struct<check: string, severity: string, message: string, details: string>>, summary struct<overall: string>"
    reports_ = spark.createDataFrame([(f"f{9 - i}", [("a", "fail" if i % 2 else "pass", "", None), ("a", "critical" if i % 2 else "warn", "", None)], ("X",)) for i in range(8)], "file_id string, " + found)
    assert [(r["file_id"], r["checks"]) for r in findings.first_dangerous(reports_, most=3).collect()] == [("f2", ["a"]), ("f4", ["a"]), ("f6", ["a"])]
