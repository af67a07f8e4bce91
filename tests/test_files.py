"""The file half: labelled fixtures through scan, rebuilding and benchmark; the walker against damaged bytes."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scanlake.dims import EXPLICIT_LE, MAX_ELEMENTS
from scanlake.findings import worst
from scanlake.operators import corpus, disarm, pixels
from scanlake.plans import scan as plans
from scanlake.sources import dicom, fixtures, walker, writer

AS_OF = "2025-01-01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for i, x in enumerate(fixtures.all_fixtures()):
        (top / str(i % 3)).mkdir(exist_ok=True)
        (top / str(i % 3) / x.name).write_bytes(x.data)
    (top / "empty.dcm").write_bytes(b"")
    (top / "other.txt").write_bytes(b"no")
    return str(top)


@pytest.fixture(scope="module")
def files(spark, folder):
    return dicom.scan_files(spark, folder)


@pytest.fixture(scope="module")
def reports(files):
    return plans.scan(files, as_of=AS_OF).cache()


def test_verdicts_of_fixtures(reports):
    """Each fixture gets its verdict, and from the rule that it is about."""
    want = {x.name: x for x in fixtures.all_fixtures()}
    rows = {r["filename"]: r for r in reports.collect()}
    assert set(rows) == set(want)
    ranks = {"pass": 0, "info": 0, "warn": 1, "fail": 2, "critical": 2}
    names = ["clean", "warn", "block"]
    for name, x in want.items():
        found = rows[name]["findings"]
        gravest = names[max(ranks[f["severity"]] for f in found)]
        assert gravest == x.verdict, (name, gravest, [(f["check"], f["severity"], f["message"]) for f in found if f["severity"] not in ("pass", "info")])
        if x.check and x.verdict != "clean":
            assert names[max(ranks[f["severity"]] for f in found if f["check"] == x.check)] == x.verdict, name


def test_summaries(reports):
    for r in reports.collect():
        n = {s: sum(f["severity"] == s for f in r["findings"]) for s in ("pass", "info", "warn", "fail", "critical")}
        s = r["summary"]
        assert s["counts"] == n and s["total_checks"] == len(r["findings"])
        want = "CRITICAL" if n["critical"] else "FAIL" if n["fail"] else "SUSPICIOUS" if n["warn"] > 2 else "CAUTION" if n["warn"] else "CLEAN"
        assert s["overall"] == want
    got = reports.select("filename", worst(F.col("findings"), "file_preamble").alias("w")).filter("filename = 'bad_magic.dcm'").first()
    assert got["w"] == "critical"


def test_benchmark(spark, files):
    labels = spark.createDataFrame([(x.name, x.attack_class, x.verdict) for x in fixtures.all_fixtures()], "filename string, attack_class string, expected_verdict string")
    rows = plans.evaluate(files, labels, AS_OF).cache()
    got = {r["filename"]: r for r in rows.collect()}
    assert all(r["detected"] and not r["false_positive"] for r in got.values())
    assert all(r["neutralized"] for r in got.values() if r["intrinsic_danger"])
    assert {r["fidelity"] for r in got.values()} == {"bit-exact", "n/a"}
    assert got["polyglot_00.dcm"]["action"] == "disarmed" and got["pixel_decompress_512_200000_64.dcm"]["action"] == "quarantined"
    for name in ("plain_rle.dcm", "deflated.dcm", "plain_big_endian.dcm", "private_payload_elf.dcm"):
        assert (got[name]["action"], got[name]["fidelity"]) == ("disarmed", "bit-exact"), name
    s = plans.benchmark_summary(rows).first()
    assert s["detection_k"] == s["detection_n"] and s["false_positives_k"] == 0 and s["fidelity_k"] == s["fidelity_n"] > 20


def test_disarm_only_what_is_dangerous(files):
    got = {r["file_id"].rsplit("/", 1)[1]: r for r in plans.disarm_or_quarantine(files, as_of=AS_OF).collect()}
    assert got["plain_explicit.dcm"]["action"] == "clean" and got["polyglot_01.dcm"]["action"] == "disarmed"
    copy = walker.parse(got["polyglot_01.dcm"]["output"])
    assert bytes(got["polyglot_01.dcm"]["output"][:128]) == b"\0" * 128 and copy.get("PatientID").text() == "P1"


@pytest.mark.parametrize(("creator", "value", "kept"), [("GEMS_ACQU_01", b"\1\2\3\4\5\6\7\0", True), ("NOBODY", b"\1\2", False), ("GEMS_ACQU_01", b"\x7fELF\0\0\0\0", False), ("GEMS_ACQU_01", fixtures.opaque(600), False)])
def test_private_filter(creator, value, kept):
    elements = [*fixtures.private(value, creator), writer.element((0x0009, 0x0011), "GEMS_IDEN_01", "LO"), writer.element("Modality", "CT")]
    left, removed = disarm.filter_private(elements)
    assert ((0x0009, 0x1001) in [x.tag for x in left]) == kept == ((0x0009, 0x0010) in [x.tag for x in left])
    assert (0x0009, 0x0011) in removed  # nothing refers to it


@pytest.mark.parametrize(("worker", "reason"), [("import os, signal; os.kill(os.getpid(), signal.SIGSEGV)", "crash(sig11)"), ("import time; time.sleep(60)", "hung"), ("pass", "no output"), ("import sys; sys.exit(3)", "failed(3)")])
def test_sandbox_contains(worker, reason):
    assert disarm.sandboxed_pixels([fixtures.plain()], timeout=2, worker=worker) == [(None, reason)]


def test_sandbox_blames_the_right_file():
    """A file on which the decoder crashes doesn't take the others with it."""
    worker = (
        "import os, signal\nfrom scanlake.operators import decoding\nown = decoding.native_pixels\n"
        "def risky(p):\n    if p.number('Rows', 0) == 13: os.kill(os.getpid(), signal.SIGSEGV)\n    return own(p)\n"
        "decoding.native_pixels = risky\ndecoding.main()"
    )
    files = [fixtures.plain(), fixtures.plain(Rows=13), fixtures.plain(pixels=None), fixtures.plain()]
    got = disarm.sandboxed_pixels(files, worker=worker)
    assert [r for _, r in got] == ["ok", "crash(sig11)", "not decodable", "ok"] and got[0][0] == got[3][0] == fixtures.slice_pixels()


def test_a_folder_scan_reports_every_file(spark, tmp_path, monkeypatch):
    """Files over 500 MB are scanned; empty ones, and ones too large for a row, are reported as unreadable."""
    (tmp_path / "a.dcm").write_bytes(fixtures.plain())
    (tmp_path / "a b+ü%.dcm").write_bytes(fixtures.plain())
    (tmp_path / "empty.dcm").write_bytes(b"")
    with open(tmp_path / "large.dcm", "wb") as f:
        f.write(fixtures.plain())
        f.truncate(500 * 1024**2 + 1)  # sparse
    assert {r["filename"] for r in dicom.scan_files(spark, str(tmp_path)).select("filename").collect()} == {"a.dcm", "a b+ü%.dcm", "large.dcm"}
    monkeypatch.setattr(dicom, "CONTENT_MOST", 2**20)
    reports = {r["filename"]: r for r in plans.scan(dicom.scan_files(spark, str(tmp_path), empty=True), as_of=AS_OF).collect()}
    assert set(reports) == {"a.dcm", "a b+ü%.dcm", "empty.dcm", "large.dcm"} and reports["large.dcm"]["file_size"] == 500 * 1024**2 + 1
    read = {k: {f["severity"] for f in r["findings"] if f["check"] == "file_read"} for k, r in reports.items()}
    assert read == {"a.dcm": set(), "a b+ü%.dcm": set(), "empty.dcm": {"critical"}, "large.dcm": {"critical"}}
    assert {r["file_id"].rsplit("/", 1)[1]: r["action"] for r in plans.disarm_or_quarantine(dicom.scan_files(spark, str(tmp_path), empty=True), as_of=AS_OF).collect()} == {"a.dcm": "clean", "a b+ü%.dcm": "clean", "empty.dcm": "quarantined", "large.dcm": "quarantined"}


def test_elements_are_flat(spark, files):
    rows = dicom.elements(files.filter("filename IN ('nesting_3.dcm', 'plain_implicit.dcm', 'plain_big_endian.dcm')")).collect()
    deep = [r for r in rows if r["file_id"].endswith("nesting_3.dcm")]
    assert max(r["depth"] for r in deep) == 4 and sum(r["n_items"] == 1 for r in deep) == 4
    for name in ("implicit", "big_endian"):
        got = {(r["grp"], r["elem"]): r["value_text"] for r in rows if name in r["file_id"]}
        assert got[0x0028, 0x0010] == "64" and got[0x0010, 0x0010] == "Doe^Jane"


@pytest.mark.parametrize("syntax", [EXPLICIT_LE, EXPLICIT_LE.removesuffix(".1"), EXPLICIT_LE + ".99"])
def test_round_trip(syntax):
    p = walker.parse(fixtures.plain(syntax, more=[fixtures.nested(2), *fixtures.private(b"\1\2\3\4")]))
    again = walker.parse(writer.part10(writer.data_set(p.elements, syntax), syntax))
    assert [(x.tag, x.value) for x in again.elements] == [(x.tag, x.value) for x in p.elements] and again.depth == p.depth == 3


BASE = fixtures.plain(more=[fixtures.nested(2), *fixtures.private(b"\1\2\3\4")], pixels=b"\0" * 64, Rows=4, Columns=8)


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(0, len(BASE)))
def test_walker_survives_damage(seed, hits, end):
    rng, data = random.Random(seed), bytearray(BASE[:end])
    for _ in range(hits if data else 0):
        data[rng.randrange(len(data))] = rng.randrange(256)
    row = dicom.describe(bytes(data))
    assert row["walk"]["state"] in ("absent", "meta_bomb", "unresolved", "deflated", "mismatch", "bomb", "ok")
    assert row["pixel_len"] is None or row["pixel_len"] <= len(data) + 8 * len(data)


@pytest.mark.parametrize("nested_ones", [False, True])
def test_elements_behind_many_others_are_read(spark, nested_ones):
    """The cap on elements is the length walk's alone: what stands behind more of them is found, kept and listed."""
    many = [writer.element((0x0008, 0x0104), "x", "LO")] * (MAX_ELEMENTS + 10)
    front = [writer.element((0x0008, 0x1140), [many], "SQ")] if nested_ones else many
    data = fixtures.plain(more=[*front, *fixtures.private(b"\x7fELF" + b"\0" * 60)])
    frame = spark.createDataFrame([("a", "a", len(data), data)], "file_id string, filename string, file_size long, content binary")
    report = plans.scan(frame, as_of=AS_OF).first()
    assert report["parse_error"] is None and report["pixel_len"] == len(fixtures.slice_pixels())
    assert "critical" in {f["severity"] for f in report["findings"] if f["check"] == "private_tag_payload"}
    assert plans.disarm_or_quarantine(frame, as_of=AS_OF).first()["action"] == "disarmed"
    assert dicom.elements(frame).count() == MAX_ELEMENTS + 10 + nested_ones + len(walker.parse(fixtures.plain(more=fixtures.private(b"\0" * 64))).elements) + 4


HEADERS = {
    "clean": (dict(PatientName="", PatientID="", InstitutionName=None, StationName=None, BodyPartExamined="ABDOMEN"), 0, "MINIMAL"),
    "residual": (dict(StationName=None, PatientBirthDate=None, InstitutionName="General"), 45, "MODERATE"),
    "dirty_head": (
        dict(StationName=None, PatientBirthDate="19600101", ReferringPhysicianName="Roe", ImageComments="MRN 12345678", BurnedInAnnotation="YES", BodyPartExamined="HEAD", SliceThickness="1.0", ImagePositionPatient=["0", "0", "0"]),
        100,
        "HIGH",
    ),
}


def test_reid_scores(spark):
    rows = [(k, k, 1, fixtures.plain(pixels=None, **change)) for k, (change, *_) in HEADERS.items()]
    got = {r["file_id"]: r["reid"] for r in plans.scan(spark.createDataFrame(rows, "file_id string, filename string, file_size long, content binary"), deid=True, as_of=AS_OF).collect()}
    assert {k: (got[k]["score"], got[k]["band"]) for k in HEADERS} == {k: (s, b) for k, (_, s, b) in HEADERS.items()}


def test_metadata_rules(spark):
    cases = {
        "fine": ({}, {}),
        "dates": (dict(StudyDate="20200105", SeriesDate="20991231", ContentDate="19010101", AcquisitionDate="2020x"), {"dates": {"warn", "fail"}}),
        "order": (dict(StudyDate="20200105"), {"dates": {"warn"}}),
        "no_dates": (dict(StudyDate=None, SeriesDate=None, ContentDate=None, AcquisitionDate=None), {"dates": {"info"}}),
        "uids": (dict(SeriesInstanceUID="1.2.3.4.5", SOPInstanceUID="1.x"), {"uid_check": {"fail"}}),
        "long_uid": (dict(SOPInstanceUID="1." * 40 + "1"), {"uid_check": {"fail"}}),
        "missing_uid": (dict(SOPInstanceUID=None), {"uid_check": {"warn"}}),
        "nobody": (dict(PatientName=None, PatientID=None), {"patient_info": {"warn"}}),
        "half": (dict(PatientID=None), {"patient_info": {"info"}}),
        "origin": (dict(Manufacturer=None, InstitutionName=None), {"provenance": {"info"}}),
        "modality": (dict(Modality="ZZ"), {"modality": {"warn"}}),
        "no_rows": (dict(Rows=None), {"pixel_dimensions": {"fail"}}),
        "no_bits": (dict(BitsAllocated=None), {"pixel_dimensions": {"fail"}}),
        "trailer": (dict(Rows=8, Columns=8), {"pixel_dimensions": {"warn"}}),
    }
    rows = [(k, k, 1, fixtures.plain(**c)) for k, (c, _) in cases.items()]
    got = {r["file_id"]: r["findings"] for r in plans.scan(spark.createDataFrame(rows, "file_id string, filename string, file_size long, content binary"), as_of=AS_OF).collect()}
    checks = ("modality", "transfer_syntax", "sop_class", "pixel_dimensions", "dates", "patient_info", "provenance", "uid_check")
    for k, (_, want) in cases.items():
        for c in checks:
            assert {f["severity"] for f in got[k] if f["check"] == c} == want.get(c, {"pass"}), (k, c)


def test_private_text_and_free_text(spark):
    rows = [
        ("vendor", [writer.element((0x0019, 0x0010), "SIEMENS MR HEADER", "LO"), writer.element((0x0019, 0x100C), "plain", "LO")], {"private_tags_phi": "warn", "free_text_phi": "pass"}),
        ("pattern", [writer.element((0x0009, 0x0010), "ab", "LO"), writer.element((0x0009, 0x1001), b"mail x.y@example.org ok", "OB")], {"private_tags_phi": "warn", "free_text_phi": "pass"}),
        ("free", [writer.element("StudyDescription", "Seen 12/31/1999")], {"private_tags_phi": "pass", "free_text_phi": "warn"}),
        ("name", [writer.element("StudyDescription", "Chest Wall")], {"private_tags_phi": "pass", "free_text_phi": "pass"}),
    ]
    frame = spark.createDataFrame([(k, k, 1, fixtures.plain(more=m)) for k, m, _ in rows], "file_id string, filename string, file_size long, content binary")
    got = {r["file_id"]: {f["check"]: f["severity"] for f in r["findings"]} for r in plans.scan(frame, deid=True, as_of=AS_OF).collect()}
    for k, _, want in rows:
        assert {c: got[k][c] for c in want} == want, k


def test_burned_in_marks(spark):
    px = np.full((256, 256), 2000, "<u2")
    px[128, 128] = 0
    for i in range(8):
        px[4:10, 20 + 12 * i : 24 + 12 * i] = 4000
    frame = spark.createDataFrame(
        [("marks", "m", 1, fixtures.plain(pixels=px.tobytes(), Rows=256, Columns=256)), ("plain", "p", 1, fixtures.plain()), ("flat", "f", 1, fixtures.plain(pixels=b"\0" * 8192))], "file_id string, filename string, file_size long, content binary"
    )
    got = {r["file_id"]: {f["check"]: f["severity"] for f in r["findings"]} for r in plans.scan(frame, deid=True, as_of=AS_OF).collect()}
    assert [got[k]["burned_in_phi"] for k in ("marks", "plain", "flat")] == ["warn", "pass", "pass"]


def plain_components(mask):
    seen, sizes = np.zeros_like(mask), []
    for start in zip(*np.nonzero(mask), strict=True):
        if not seen[start]:
            stack, n = [start], 0
            seen[start] = True
            while stack:
                y, x = stack.pop()
                n += 1
                for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        stack.append((a, b))
            sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("density", [0.1, 0.4, 0.6, 0.9])
def test_components(density):
    mask = np.random.default_rng(1).random((23, 37)) < density
    assert sorted(pixels.components(mask).tolist()) == plain_components(mask)


def test_features():
    rng = np.random.default_rng(0)
    x = rng.normal(100, 10, (64, 48))
    a, *bands = pixels.haar(x)
    assert np.isclose((a**2).sum() + sum((b**2).sum() for b in bands), (x**2).sum())
    r, power = pixels.radial_spectrum(x)
    size = np.abs(np.fft.fftshift(np.fft.fft2(x)))
    far = np.hypot(*np.meshgrid(np.arange(64) - 32, np.arange(48) - 24, indexing="ij"))
    assert np.allclose(power, [size[(far >= k - 0.5) & (far < k + 0.5)].mean() for k in r])
    b2 = np.polyfit(np.log(r), np.log(power), 1)[0]
    assert np.isclose(pixels.spectral_features(x)["spectral_b2"], -b2)
    assert np.isclose(pixels.mirror_correlation(x), np.corrcoef(x.ravel(), x[:, ::-1].ravel())[0, 1])
    full = pixels.all_features(walker.parse(fixtures.plain()))
    assert len(full) == 36 + 4 + 6 + 3 and all(np.isfinite(v) for v in full.values())
    assert pixels.all_features(walker.parse(fixtures.plain(pixels=None))) is None


def test_calibrated_rules(spark):
    rows = [(f"f{i}", f"f{i}", 1, fixtures.plain(pixels=fixtures.slice_pixels(seed=i))) for i in range(12)]
    odd = np.random.default_rng(0).integers(0, 4000, (64, 64)).astype("<u2").tobytes()
    frame = spark.createDataFrame([*rows, ("odd", "odd", 1, fixtures.plain(pixels=odd)), ("none", "none", 1, fixtures.plain(pixels=None))], "file_id string, filename string, file_size long, content binary")
    table = dicom.parsed(frame).join(pixels.measured(frame), "file_id").cache()
    base = pixels.calibrate(table.filter("file_id LIKE 'f%'"))
    assert base.count() == 49 and base.first()["_sample_count"] == 12
    checked = pixels.with_baselines(table, base).select("file_id", pixels.simple_checks().alias("s"), pixels.advanced_checks().alias("a"))
    got = {r["file_id"]: {f["check"]: f["severity"] for f in [*r["s"], *r["a"]]} for r in checked.collect()}
    assert got["odd"]["wavelet_analysis"] == got["odd"]["noise_residual"] == "warn" and got["f3"]["wavelet_analysis"] == "pass"
    assert got["none"] == {"pixel_scan": "info", "advanced_pixel": "info"} and "bilateral_symmetry" not in got["f3"]


def test_stream(spark, folder, tmp_path):
    from scanlake.streaming.dropfolder import scan_stream

    for _ in range(2):  # the second run finds nothing new
        scan_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.select("sha256").distinct().count() == len({x.data for x in fixtures.all_fixtures()})


def broadcast_sides(frame):
    """What stands below each broadcast of a plan."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    ends = lambda i: next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
    return ["\n".join(lines[i : ends(i)]) for i, x in enumerate(lines) if "BroadcastExchange" in x]


def test_calibration_broadcasts_no_values(spark):
    """Files are measured once, and however small Spark takes the table to be, only aggregates go through the driver."""
    rows = [(f"f{i}", f"f{i}", 1, fixtures.plain(pixels=fixtures.slice_pixels(seed=i))) for i in range(4)]
    frame = spark.createDataFrame(rows, "file_id string, filename string, file_size long, content binary")
    base = pixels.calibrate(dicom.parsed(frame, measure=pixels.Measure(marks=False)))
    assert all("Aggregate" in side for side in broadcast_sides(base))
    assert "MapInArrow" not in base._jdf.queryExecution().executedPlan().toString()
    assert {r["n"] for r in base.collect()} == {4}


def test_quantiles_of_large_small_and_nameless_groups(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SKETCH", 100)  # groups of 200 are large ones
    rng = np.random.default_rng(3)
    values = {("a", "x"): rng.normal(size=5000), ("a", "y"): rng.integers(0, 4, 3000).astype(float), ("b", "x"): rng.normal(size=199), (None, "x"): rng.normal(size=700), ("c", "x"): np.array([2.5])}
    rows = spark.createDataFrame([(*k, float(x)) for k, xs in values.items() for x in xs], "m string, f string, value double")
    asked = {"median": 0.5, "p5": 0.05, "p95": 0.95, "least": 0.0, "most": 1.0}
    found = corpus.quantiles(rows, ["m", "f"], "value", asked)
    assert (sides := broadcast_sides(found)) and all("Aggregate" in side for side in sides)
    got = {(r["m"], r["f"]): [r[k] for k in asked] for r in found.collect()}
    assert got.keys() == values.keys()
    for k, xs in values.items():
        assert np.allclose(got[k], np.quantile(xs, list(asked.values())), rtol=0, atol=1e-12), k
