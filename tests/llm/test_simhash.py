"""SimHash: fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from scanlake.llm import simhash


def plain(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((2, 3, 40, 300)))]
        rows.append((10 * i, " ".join(base)))
        for k in range(rng.choice((0, 1, 4))):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((10 * i + 1 + k, "\n".join(near) if k % 2 else " ".join(near).upper()))
    rows += [(1000, None), (1001, ""), (1002, "  \t\n"), (None, rows[0][1]), (1003, rows[0][1]), (1003, rows[0][1]), (None, "only here"), (1004, "word"), (1005, "x\x85y z q " * 50)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == classes(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("labels", [simhash._dense_labels, simhash._sparse_labels])
def test_long_lists(labels):
    """Both ways through a posting list give the components of its links."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 13, 300).astype(np.uint64) << np.uint64(40))
    root = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 3:
                root[root == root[i]] = root[j]
    got = labels(fps)
    assert len(set(zip(root.tolist(), got.tolist(), strict=True))) == len(set(root.tolist())) == len(set(got.tolist()))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {got[i] for i in range(-39, 41)} == {-40} and got[101] == 100
