"""Tampering and the classifier: altered images are told apart; splits don't leak."""

from pyspark.sql import functions as F
from scanlake.operators import learning, pixels, tampering
from scanlake.sources import fixtures


def test_altered_images_are_learnt(spark):
    rows = [(f"f{i}", f"f{i}", 1, fixtures.plain(pixels=fixtures.slice_pixels(seed=i))) for i in range(16)]
    files = spark.createDataFrame(rows, "file_id string, filename string, file_size long, content binary")
    fakes = tampering.altered(files, ["gaussian_smooth", "requantize"]).cache()
    assert fakes.count() == 32 and fakes.select(F.sha2("content", 256)).distinct().count() == 32
    assert sorted(map(tuple, tampering.altered(files, ["copy_move"]).select("file_id", F.sha2("content", 256)).collect())) == sorted(map(tuple, tampering.altered(files, ["copy_move"]).select("file_id", F.sha2("content", 256)).collect()))
    table = pixels.measured(files).withColumn("label", F.lit(0)).withColumn("technique", F.lit(None).cast("string")).unionByName(pixels.measured(fakes).join(fakes.select("file_id", "technique"), "file_id").withColumn("label", F.lit(1)))
    table = table.select("file_id", "features", "label", "technique").cache()
    names = learning.feature_names(table)
    assert len(names) == 49
    small = dict(trees=20, depth=5)
    scored = learning.cross_validated(table, "file_id", names, folds=3, **small).cache()
    assert scored.count() == 48 and learning.auc(scored) > 0.9
    model = learning.train(table, names, **small)
    assert len(learning.importances(model, names, 5)) == 5
    out = learning.leave_one_out(table, "technique", ["requantize"], names, **small)
    assert out.count() == 16
    told = learning.probability(model, table, names).select(learning.verdict(F.col("probability"))[0]["severity"].alias("s"), "label")
    flagged = [r["s"] in ("warn", "info") for r in told.filter("label = 1").collect()]
    assert sum(flagged) > 0.7 * len(flagged)
    a, b = learning.hash_split(table, "file_id")
    assert a.count() + b.count() == 48 and a.join(b, "file_id").count() == 0


def test_all_techniques_change_an_image(spark):
    files = spark.createDataFrame([("a", "a", 1, fixtures.plain()), ("none", "b", 1, fixtures.plain(pixels=None))], "file_id string, filename string, file_size long, content binary")
    got = {r["technique"] for r in tampering.altered(tampering.sample_files(files, 2)).collect()}
    assert got == set(tampering.TECHNIQUES)


def test_matrix_fills(spark):
    rows = spark.createDataFrame([(1, {"a": 1.0}), (2, {"b": float("nan")}), (3, None)], "k int, features map<string, double>")
    assert [tuple(r)[2:] for r in learning.matrix(rows, ["a", "b"]).orderBy("k").collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_folds_are_stratified(spark):
    """Each label's rows are spread over the folds to within one."""
    rows = spark.createDataFrame([(f"k{i}", int(i < 7)) for i in range(60)], "k string, label int")
    got = {(r["label"], r["fold"]): r["count"] for r in learning.stratified(rows, "k").groupBy("label", "fold").count().collect()}
    assert sorted(got) == [(y, k) for y in (0, 1) for k in range(5)]
    assert {n for (y, _), n in got.items() if y} == {1, 2} and {n for (y, _), n in got.items() if not y} == {10, 11}
