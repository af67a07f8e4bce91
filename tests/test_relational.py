"""Every query with SQL against DuckDB on the smallest tables, and the functions that queries don't reach."""

import math
import os
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F
from scanlake.findings import dangerous, finding, findings, severity_rank, summary
from scanlake.functions import binary, payloads, stats
from scanlake.operators import corpus
from scanlake.plans import files, relational

SF = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", [*relational.SQL, *files.SQL])
def test_query_against_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    want = order([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()])
    assert order([tuple(plain(r[c]) for c in columns) for r in frame.toArrow().to_pylist()]) == want


@pytest.mark.parametrize("name", ["file_pixel_features", "file_reid_scores", "file_nesting"])
def test_file_operators_take_every_file(spark, name):
    """No file is left out before the operator, whatever its id."""
    ids = {str(r["c_custkey"]) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    assert {r["file_id"] for r in entry.queries()[name](spark, SF).collect()} == ids


@pytest.mark.parametrize(("name", "n"), [("file_fidelity", 150), ("file_calibration", 90)])
def test_file_counts_are_of_every_file(spark, name, n):
    assert sum(r["n"] for r in entry.queries()[name](spark, SF).collect()) == n


def test_entry_has_a_query_for_each_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entropy_and_signatures(spark):
    data = [b"", b"\0" * 128, bytes(range(128)), b"MZ" + b"\0" * 10, b"\0" * 50 + b"%PDF", b"x\xc3\xa9PK\x03\x04", b"#!/bin/sh"]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "b binary")
    got = rows.select(binary.shannon_entropy(binary.byte_symbols(F.col("b"))), binary.signature_at_start(F.col("b")), binary.signature_in_window(F.col("b"))).collect()
    for d, (e, start, window) in zip(data, got, strict=True):
        assert math.isclose(e, payloads.entropy_of(d), abs_tol=1e-9)
        found = payloads.match_signature(d)
        assert (window and (window["name"], window["offset"])) == found and start == (found[0] if found and found[1] == 0 else None)


def test_intervals(spark):
    rows = spark.createDataFrame([(80, 80), (72, 72), (0, 605), (0, 0), (3, 10)], "k long, n long")
    w = stats.wilson(F.col("k"), F.col("n"))
    got = rows.select(w["p"], w["lo"], w["hi"], stats.rule_of_three(F.col("n"))).collect()
    assert round(got[0][1], 3) == 0.954 and round(got[1][1], 3) == 0.949 and round(got[2][3], 4) == 0.005
    assert tuple(got[3]) == (0.0, 0.0, 0.0, 1.0) and 0 < got[4][1] < 0.3 < got[4][2] < 1
    pairs = spark.createDataFrame([(51, 0), (0, 0), (4, 4)], "b long, c long").select(stats.mcnemar_chi2(F.col("b"), F.col("c"))).collect()
    assert round(pairs[0][0], 1) == 49.0 and pairs[1][0] == 0 and pairs[2][0] == 1 / 8
    assert stats.mcnemar_p(pairs[0][0]) < 1e-6 and stats.mcnemar_p(0) == 1


def test_findings_rollup(spark):
    row = spark.range(1).select(findings(finding("a", "warn", "m"), finding("b", None, "m"), finding("c", "odd", "m"), F.lit(None).cast("struct<check: string, severity: string, message: string, details: string>")).alias("f"))
    got = row.select(summary(F.col("f")).alias("s"), dangerous(F.col("f")).alias("d"), severity_rank(F.lit("odd")).alias("r")).first()
    assert got["s"]["counts"] == {"pass": 0, "info": 1, "warn": 1, "fail": 0, "critical": 0} and got["s"]["total_checks"] == 2 and got["s"]["overall"] == "CAUTION"
    assert not got["d"] and got["r"] is None


def test_outcomes_of_empty_maps(spark):
    rows = spark.createDataFrame([({},), ({"a": "n/a"},), ({"a": "clean", "b": "n/a"},), ({"a": "dos(pre-identified)"},)], "m map<string, string>")
    got = rows.select(corpus.all_accept(F.col("m")), corpus.outcome_dangerous(F.col("m")), corpus.ran(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (False, False, True), (True, False, True), (False, True, False)]
