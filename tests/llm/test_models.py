"""Toxicity by held-out accuracy, nearest neighbours by recall against brute force."""

import random
import zlib

import numpy as np
import pytest
from scanlake.llm import ann, toxicity


def corpus(n=900):
    rng = random.Random(8)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(10, 300))]
        if y:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", "Moron,", "zork" + rng.choice(words), "zork" + rng.choice(words)]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(y)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "en", 0.5) for r in [*rows, (None, "you idiot"), (9000, None), (9001, "")]], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scores(docs, toxicity.fit(docs, marks)).collect()
    by = {r["doc_id"]: r for r in got}
    held = [(y, by[i]["predicted"]) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([a == b for a, b in held]) > 0.97 and sum(b for a, b in held if a) > 0.9 * sum(a for a, _ in held)
    assert by[None]["predicted"] == 1 and by[9000]["predicted"] == by[9001]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_are_not_learnt_from(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, toxicity.fit(docs, none)).collect()} == {1: 1, 2: 0}
    assert toxicity.scores(docs.limit(0), toxicity.fit(docs.limit(0), none)).collect() == []


def test_label_model_weighs_correlated_voters():
    """Ten copies of one voter don't outvote three independent ones."""
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    good = np.stack([np.where(rng.random(3000) < 0.85, y, ~y) for _ in range(3)], 1)
    copy = np.repeat(np.where(rng.random(3000) < 0.6, y, ~y)[:, None], 10, 1)
    votes = np.c_[good, copy, ~(good.any(1))]
    post, _, _ = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.85


def test_posteriors_beat_any_vote():
    """Good and bad voters for, independent voters against: the label model finds who is right, which taking any vote can't."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    vote = lambda p1, p0: np.where(y, rng.random(4000) < p1, rng.random(4000) < p0)
    pro = np.stack([vote(0.6, 0.01), vote(0.55, 0.01), vote(0.5, 0.02), vote(0.25, 0.2), vote(0.2, 0.2)], 1)
    con = np.stack([vote(0.1, 0.7), vote(0.15, 0.8)], 1)
    post, rates, prior = toxicity.label_model(np.c_[pro, con])
    right, anybody = ((post > 0.5) == y).mean(), (pro.any(1) == y).mean()
    assert right > 0.93 and right > anybody + 0.1 and abs(prior - 0.2) < 0.06
    assert abs(rates[0, 1] - 0.6) < 0.1 and abs(rates[3, 0] - 0.2) < 0.05  # accuracies as drawn
    silent = toxicity.label_model(np.zeros((5, 4)))[0]
    assert np.isfinite(silent).all()


def test_rows_that_repeat_an_id_train_alike(spark):
    """Two texts with one id: always the same one is learnt from, in whatever order they come."""
    rows, labels = corpus(300)
    twice = [*rows, *((i, "other " + t) for i, t in rows)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), marks) for x, n in ((twice, 1), (twice[::-1], 5)))
    assert a == b


def brute(rows, k=10, every=100):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 16:
            ok[i] = np.array(v, float)
    out = {}
    for q in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((ok[q] - x) ** 2).sum())), i) for i, x in ok.items() if i != q)
            out[q] = near[:k]
    return out


def vectors(n):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]
    for i in range(50, n, 3):
        rows[i] = (i, rows[50][1])  # a third of all rows are one vector
    rows[7], rows[8], rows[9], rows[11], rows[13] = (7, None), (8, [0.0] * 16), (9, [float("nan")] * 16), (11, [1.0] * 3), (13, [None] * 16)
    return rows + [(None, rows[0][1]), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("n", [3000, 60])
def test_recall_and_exact_scores(spark, n):
    rows = vectors(n)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, list int")
    got = {}
    for r in ann.nearest(frame, every=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(rows, every=20)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == list(range(1, len(near) + 1)) and mine == sorted(mine)
        exact = dict((i, d) for d, i in brute(rows, k=n, every=20)[q]) if q == min(want) else {}
        assert all(abs(exact[i] - d) < 1e-12 for d, i in mine if exact)
        hits, total = hits + len({i for _, i in mine} & {i for _, i in near}), total + len(near)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("n", [2000, 6000])
def test_codes_decide_and_recall_holds(spark, n, monkeypatch):
    """Lists longer than the shortlist: what isn't among the best codes is never compared exactly, and recall holds."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 32))[np.arange(n) % 20] + 0.5 * rng.normal(size=(n, 32))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "PER_LIST", 1)
    shortlist, asked = 40, range(0, n, 50)
    got = {}
    for r in ann.nearest(frame, every=50, shortlist=shortlist).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    model = ann.Index.fit(x.astype(float), int(n**0.5))
    lists, codes = model.assign(x.astype(float))
    assert np.bincount(lists).max() > shortlist  # so a shortlist leaves out even part of one list
    hits = 0
    for i in asked:
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[i] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * len(asked)
    # asymmetric distances: the query against the coded vector, centroid and codebook entries put together
    ids, q = np.flatnonzero(lists == lists[0]), x[:3].astype(float)
    for row, (found, distance) in zip(q, model.rank(lists[0], q, codes[ids], ids, 7), strict=True):
        whole = model.centres[lists[0]] + np.concatenate([model.books[m][codes[ids][:, m]] for m in range(codes.shape[1])], axis=1)
        want = ((row - whole) ** 2).sum(1)
        assert set(found) == set(ids[np.argsort(want, kind="stable")[:7]]) and np.allclose(np.sort(distance), np.sort(want)[:7], rtol=1e-4)


def test_ties_in_codes_go_to_smaller_ids():
    ids, distances = ann.best_of(np.array([9, 4, 7, 1]), np.array([1.0, 1.0, 0.5, 1.0], np.float32), 3)
    assert ids.tolist() == [7, 1, 4] and distances.tolist() == [0.5, 1.0, 1.0]


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert ann.nearest(spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect() == []
