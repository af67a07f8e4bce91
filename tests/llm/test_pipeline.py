"""The pipeline: every stage's decisions against a brute-force version of it on a small corpus."""

import random

import corpus_pipeline as pipeline
from test_quality_lines import plain_dedup, plain_quality
from test_simhash import classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    stop = ["the", "of", "and", "to", "in"]
    sentence = lambda k: " ".join(rng.choice(stop) if rng.random() < 0.3 else f"w{rng.randrange(600)}" for _ in range(k))
    rows = []
    for i in range(40):
        lines = [sentence(rng.randrange(8, 40)) for _ in range(4)]
        rows.append((10 * i, "\n".join(lines)))
        if i % 4 == 0:
            rows.append((10 * i + 1, "\n".join(lines)))
        if i % 5 == 0:
            words = " ".join(lines).split()
            words[3] = words[50 % len(words)] = "changed"
            rows.append((10 * i + 2, " ".join(words)))
    rows += [(900, None), (901, "too short"), (902, "# % " * 50), (903, "For " * 80), (904, f"{sentence(30)} me@mail.example.com 10.0.0.1 {sentence(5)}"), (None, sentence(60))]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def test_stages(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], SCHEMA + ", extra int")
    assert 4 <= len(pipeline.STAGES) <= 5
    (_, quality), (_, lines), (_, near), (_, pii), (_, packing) = pipeline.STAGES
    a = quality(spark, docs, "")
    assert a.columns == COLUMNS
    kept = a.collect()
    assert all(not plain_quality(r["text"])[-1] for r in kept) and {900, 901, 902, 903}.isdisjoint({r["doc_id"] for r in kept}) and len(kept) == len(corpus()) - 4
    b = lines(spark, a, "")
    want = {i: t for i, t in plain_dedup([(r["doc_id"], r["text"]) for r in kept]).items() if t.strip()}
    assert b.columns == COLUMNS and {r["doc_id"]: r["text"] for r in b.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in b.collect())
    c = near(spark, a, "")
    assert c.columns == COLUMNS and {r["doc_id"] for r in c.collect()} == {d for d, _, root in classes([(r["doc_id"], r["text"]) for r in kept]) if d is None or d == root}
    d = {r["doc_id"]: r["text"] for r in pii(spark, c, "").collect()}
    assert "[EMAIL]" in d[904] and "[IP]" in d[904] and "@" not in d[904] and len(d) == c.count()
    assert {r["doc_id"] for r in packing(spark, c, "").collect()} == set(d)


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, frame = pipeline.run(spark, str(tmp_path)), spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            frame.write.parquet(str(tmp_path / str(k)))
            frame = spark.read.parquet(str(tmp_path / str(k)))
    pieces = lambda f: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in f.collect() if r["start"] == 0)
    assert pieces(got) == pieces(frame)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, "")
        assert frame.collect() == []


def test_near_dups_keep_one_row_per_component(spark):
    """Two texts that share an id are two documents, and copies without an id are one."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (2, b), (5, a), (None, c), (None, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = pipeline.near_dups(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, a), (1, b), (None, c)], key=str)
