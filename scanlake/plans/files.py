"""The file operators applied to files that are built from the driver's tables, with the SQL of what must come out.

The tables hold no medical images, so each row becomes one: ``built`` writes the bytes of a variant that the row's key
selects, and from there everything runs as for files of a folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.operators import corpus, disarm, pixels
from scanlake.plans import scan as plans
from scanlake.plans.relational import rounded
from scanlake.sources import dicom, fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-01-01"
SIDE = 32


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def ramp(key: int) -> bytes:
    """An image whose pixel (r, c) is (7 key + 13 r + 29 c) modulo 997."""
    r, c = np.ogrid[:SIDE, :SIDE]
    return ((7 * key + 13 * r + 29 * c) % 997).astype("<u2").tobytes()


def variant(key: int, name: str) -> bytes:
    """A file by key modulo 10; the patient is the row's name."""
    kind, own = key % 10, dict(PatientName=name, PatientID=str(key), Rows=SIDE, Columns=SIDE)
    image = ramp(key)
    more: dict = {
        1: dict(preamble=b"MZ\x90\0"),
        3: dict(more=fixtures.private(b"\x7fELF" + b"\0" * 60)),
        4: dict(more=[fixtures.nested(12)]),
        5: dict(syntax=fixtures.HTJ2K, pixels=[b"", b"\0" * 64]),
        6: dict(Rows=60000, Columns=60000),
        7: dict(pixels=None),
        8: dict(syntax=fixtures.DEFLATED_LE),
        9: dict(syntax=fixtures.IMPLICIT_LE + ".5", pixels=[b"", fixtures.rle_frame(image)]),
    }
    data = fixtures.plain(**({"pixels": image} | own | more.get(kind, {})))
    return data[:128] + b"XXXX" + data[132:] if kind == 2 else data


def built(spark: SparkSession, sf: str, table: str = "customer", key: str = "c_custkey", name: str = "c_name") -> DataFrame:
    """(file_id, filename, file_size, content) of one file per row; the file id is the key."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                data = [variant(k, n) for k, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                ids = [str(k) for k in part.column(0).to_pylist()]
                yield pa.record_batch([pa.array(ids), pa.array([f"{i}.dcm" for i in ids]), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], names=["file_id", "filename", "file_size", "content"])

    rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).cast("long").alias("k"), F.col(name).cast("string").alias("n"))
    # a few small rows stand for large files: spread them over the cores
    return rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(make, "file_id string, filename string, file_size long, content binary")


_VERDICT = "CASE c_custkey % 10 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'FAIL' WHEN 5 THEN 'CAUTION' WHEN 6 THEN 'CRITICAL' WHEN 8 THEN 'CAUTION' ELSE 'CLEAN' END"
_KEY = "c_custkey::VARCHAR AS file_id"


@query(f"SELECT {_KEY}, {_VERDICT} AS overall FROM customer")
def file_scan_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of every file."""
    return plans.scan(built(spark, sf), as_of=AS_OF).select("file_id", "summary.overall")


@query(f"SELECT overall, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 6)::DOUBLE AS pct, list_position(['CRITICAL', 'FAIL', 'SUSPICIOUS', 'CAUTION', 'CLEAN'], overall)::INT AS ord FROM (SELECT {_VERDICT} AS overall FROM customer) GROUP BY overall")
def file_verdict_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of all files (A3)."""
    from scanlake.findings import verdict_distribution

    return rounded(verdict_distribution(plans.scan(built(spark, sf), as_of=AS_OF).select("summary.overall")))


@query("""SELECT "check", count(*) AS files FROM (SELECT unnest(CASE c_custkey % 10 WHEN 1 THEN ['file_preamble'] WHEN 2 THEN ['file_preamble', 'modality', 'transfer_syntax', 'sop_class', 'patient_info', 'provenance', 'uid_check'] WHEN 3 THEN ['private_tag_payload'] WHEN 4 THEN ['sequence_depth'] WHEN 5 THEN ['codec_cve']
  WHEN 6 THEN ['pixel_dimension_bomb', 'pixel_dimensions'] WHEN 8 THEN ['codec_cve'] ELSE [] END) AS "check" FROM customer) GROUP BY 1 ORDER BY files DESC, 1 LIMIT 10""")
def file_category_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Files by category of finding."""
    from scanlake.findings import category_prevalence

    return category_prevalence(plans.finding_rows(plans.scan(built(spark, sf), as_of=AS_OF)), "file_id", top=10)


@query(f"SELECT {_KEY}, CASE c_custkey % 10 WHEN 1 THEN 'disarmed' WHEN 3 THEN 'disarmed' WHEN 2 THEN 'quarantined' WHEN 4 THEN 'quarantined' WHEN 6 THEN 'quarantined' ELSE 'clean' END AS action FROM customer")
def file_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Dangerous files are rebuilt and scanned again, or quarantined (R1 to R3, R7). A file with another magic is read as a bare data set, in which no image is found."""
    return plans.disarm_or_quarantine(built(spark, sf), as_of=AS_OF).select("file_id", "action")


def _fidelity(files: DataFrame) -> DataFrame:
    return disarm.disarm(files).groupBy("syntax", disarm.fidelity_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT CASE c_custkey % 10 WHEN 2 THEN NULL WHEN 5 THEN '1.2.840.10008.1.2.4.201' WHEN 8 THEN '1.2.840.10008.1.2.1.99' WHEN 9 THEN '1.2.840.10008.1.2.5' ELSE '1.2.840.10008.1.2.1' END AS syntax,
  CASE WHEN c_custkey % 10 IN (2, 5, 6, 7) THEN 'skipped' ELSE 'lossless_bitexact' END AS bucket, count(*) AS n FROM customer GROUP BY ALL""")
def file_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """Every file through parsing, gates and the sandboxed decoder: fidelity by transfer syntax (R4 to R6, R13, A16). Without an image (2, 7), a decoder (5) or within the caps (6) it is skipped."""
    return _fidelity(built(spark, sf))


def _reid_scores(files: DataFrame) -> DataFrame:
    return plans.scan(files, deid=True, as_of=AS_OF).select("file_id", "reid.score", "reid.band")


@query(f"SELECT {_KEY}, CASE WHEN c_custkey % 10 = 2 THEN 0 ELSE 45 END::INT AS score, CASE WHEN c_custkey % 10 = 2 THEN 'MINIMAL' ELSE 'MODERATE' END AS band FROM customer")
def file_reid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Re-identification score of every file (P1 to P9): name, id and institution are critical, the station is another tag; capped at 45. One with another magic (2) has no attributes that could tell."""
    return _reid_scores(built(spark, sf))


def _pixel_features(files: DataFrame) -> DataFrame:
    s, f = (lambda n: F.element_at("simple", n)), (lambda n: F.element_at("features", n))
    rows = pixels.measured(files)
    return rows.select("file_id", F.round(s("mean"), 4).alias("mean"), F.round(s("std_dev"), 4).alias("std_dev"), s("min").alias("low"), s("max").alias("high"), s("unique_values").alias("n_unique"), F.round(f("level1_LH_mean"), 4).alias("lh_mean"), F.round(f("level1_HH_energy"), 1).alias("hh_energy"))


@query(f"""WITH p AS (SELECT c_custkey, (7 * c_custkey + 13 * r + 29 * c) % 997 AS x, r, c FROM customer, range({SIDE}) a(r), range({SIDE}) b(c) WHERE c_custkey % 10 NOT IN (2, 5, 6, 7)),
  s AS (SELECT c_custkey, avg(x) AS mean, stddev_pop(x) AS std_dev, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high, count(DISTINCT x)::DOUBLE AS n_unique FROM p GROUP BY 1),
  q AS (SELECT c_custkey, r // 2 AS y, c // 2 AS z, sum(x * CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END) / 2 AS lh, sum(x * CASE WHEN r % 2 = c % 2 THEN 1 ELSE -1 END) / 2 AS hh FROM p GROUP BY ALL),
  w AS (SELECT c_custkey, avg(abs(lh)) AS lh_mean, sum(hh * hh) AS hh_energy FROM q GROUP BY 1)
  SELECT {_KEY}, round(mean, 4) AS mean, round(std_dev, 4) AS std_dev, low, high, n_unique, round(lh_mean, 4) AS lh_mean, round(hh_energy, 1) AS hh_energy FROM customer LEFT JOIN s USING (c_custkey) LEFT JOIN w USING (c_custkey)""")
def file_pixel_features(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel statistics, distinct values and first wavelet level of every file (X0, X1, X6, X16, X17); null where no pixels can be read (2, 5, 6, 7)."""
    return _pixel_features(built(spark, sf))


def _calibration(files: DataFrame) -> DataFrame:
    rows = dicom.parsed(files, measure=pixels.Measure(marks=False)).select("file_id", "attrs", "features")
    return pixels.calibrate(rows).filter("feature = 'noise_std'").select("modality", "n")


@query("SELECT 'CT' AS modality, count(*) AS n FROM customer WHERE c_custkey % 10 NOT IN (2, 5, 6, 7) GROUP BY 1 HAVING count(*) >= 3")
def file_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines from every file, and how many files each feature has (A9, L1, J14); those without readable pixels (2, 5, 6, 7) have no features to count."""
    return _calibration(built(spark, sf))


@query(f"SELECT {_KEY}, CASE c_custkey % 10 WHEN 2 THEN 18 WHEN 3 THEN 29 WHEN 4 THEN 41 WHEN 7 THEN 26 ELSE 27 END AS n_elements, CASE c_custkey % 10 WHEN 4 THEN 1 ELSE 0 END AS n_leaves, CASE c_custkey % 10 WHEN 4 THEN 13 ELSE 0 END::INT AS max_depth FROM customer")
def file_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """Flattened elements of every file, meta ones included: how many, how many leaves of nested sequences, and the depth."""
    return dicom.elements(built(spark, sf)).groupBy("file_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("value_text") == "leaf").alias("n_leaves"), F.max("depth").alias("max_depth"))


_CLASS = "CASE c_custkey % 10 WHEN 1 THEN 'polyglot' WHEN 2 THEN 'malformed_header' WHEN 3 THEN 'private_payload' WHEN 4 THEN 'nesting_bomb' WHEN 5 THEN 'codec_exposure' WHEN 6 THEN 'dimension_bomb' WHEN 8 THEN 'codec_exposure' ELSE 'benign' END"


@query(f"SELECT {_CLASS} AS label, count(*) AS n, count(*) AS detected, CASE WHEN {_CLASS} = 'benign' THEN 0 ELSE count(*) END AS neut_n, CASE WHEN {_CLASS} = 'benign' THEN 0 ELSE count(*) END AS neutralized FROM customer GROUP BY {_CLASS}")
def file_benchmark_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark per attack class."""
    files = built(spark, sf)
    k = F.col("c_custkey") % 10
    names = {1: "polyglot", 2: "malformed_header", 3: "private_payload", 4: "nesting_bomb", 5: "codec_exposure", 6: "dimension_bomb", 8: "codec_exposure"}
    label = F.lit("benign")
    for i, name in names.items():
        label = F.when(k == i, name).otherwise(label)
    verdict = F.when(k.isin(5, 8), "warn").when(k.isin(1, 2, 3, 4, 6), "block").otherwise("clean")
    labels = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".dcm")).alias("filename"), label.alias("attack_class"), verdict.alias("expected_verdict"))
    return corpus.by_class(plans.evaluate(files, labels, AS_OF), "attack_class")
