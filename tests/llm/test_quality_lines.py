"""Quality rules and line dedup against brute force."""

import random
import re

import pytest
from scanlake.llm import linededup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words, n = WORD.findall(text or ""), len(WORD.findall(text or ""))
    wins = {}
    for i in range(n - 7):
        wins.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {p for starts in wins.values() if len(starts) > 1 for i in starts for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


TEXTS = [
    None, "", " \n\t ", "the cat " * 40, "\n".join(["one two three four five six seven eight nine"] * 3), "a b c d e f g h " * 2 + "x y z", "# * | " * 30, "é ü   \x85 \x1c the of and to " * 9,
    "For " * 25 + "the quick brown fox jumps over one lazy dog and then it was gone " * 1, "\r\nthe a\r\nthe a\n", " ".join(f"the w{i}" for i in range(200)), "A!! B!! " * 30,
]


def test_quality_against_brute_force(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "the", "x", 1)], "doc_id long, text string, _words string, n_words int")
    got = quality.judge(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(t), t
        assert not (r["kept"] and r["base_failed"])
    assert rows[10]["kept"] and not rows[11]["kept"] and rows[None]["_words"] == "x"
    assert quality.judge(docs.limit(0)).collect() == []
    assert got.filter("kept").count() == sum(r["kept"] for r in rows.values())


def test_thresholds_are_a_table(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert not quality.judge(docs).first()["kept"] and quality.judge(docs, []).first()["kept"]


def words_of(line):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w]


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_dedup(docs):
    """Every line against all lines before it."""
    before, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        kept = []
        for line in text.split("\n"):
            ws = words_of(line)
            if not ws:
                kept.append(line)
                continue
            if not any(ws == o or (max(len(ws), len(o)) >= 5 and one_edit(ws, o)) for o in before):
                kept.append(line)
            before.append(ws)
        out[doc_id] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = []
    base = [[f"{rng.choice('abc')}{rng.randrange(4)}" for _ in range(rng.randrange(1, 12))] for _ in range(25)]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            ws = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(ws) + 1)
                ws = rng.choice((ws[:k] + ["new"] + ws[k:], ws[:k] + ws[k + 1 :], ws[:k] + [rng.choice("xy")] + ws[k + 1 :]))
            lines.append(rng.choice((" ", "  ", "\t")).join(ws) if rng.random() < 0.9 else rng.choice(("", "  ")))
        docs.append((i, "\n".join(lines)))
    docs.append((None, "a0 a1 a2 a3 a0 a1\nunique last line of all here"))
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, line string, n_lines int").repartition(3)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame).collect()}
    assert got == plain_dedup(docs)


def test_shuffle_path_is_the_same(spark, monkeypatch):
    rows = [(i, f"one two three four five six {i % 7}\nother line of words {i} and more {i % 3}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(map(tuple, linededup.dedup_lines(frame).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, linededup.dedup_lines(frame).collect())) == a


def test_lines_special_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (5, "x y z"), (6, "x y q"), (7, long), (8, long + " tail"), (9, long.replace("w1500", "other")), (3, "same")]
    got = sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_exact", "n_near").collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (2, "", 0, 0), (3, "same", 0, 0), (3, "same", 0, 0), (4, "", 1, 0), (5, "x y z", 0, 0), (6, "x y q", 0, 0), (7, long, 0, 0), (8, "", 0, 1), (9, "", 0, 1)], key=str)
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_keys_take_another_way_to_the_same_result(spark, monkeypatch):
    """Keys that many rows share are joined by broadcast: all of them, or none."""
    rows = [(i, f"one two three four five six {i % 7}\nother line of words {i} and more {i % 3}\nthe same line in all of them") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(map(tuple, linededup.dedup_lines(frame).collect()))
    monkeypatch.setattr(linededup, "HOT_LEAST", 1)
    assert sorted(map(tuple, linededup.dedup_lines(frame).collect())) == a
    assert {r[0]: r[1] for r in a} == plain_dedup(rows)


NAMES = ["a.b", "x`y", "_h", "_gone", "_pinned", "_spans", "row", "x", "ls", "_row", "_text", "c0", "th", "h1", "kept.x"]


@pytest.mark.parametrize("operator", [quality.judge, linededup.dedup_lines, pii.redact])
def test_columns_of_any_name_pass_through(spark, operator):
    text = "the quick mail a@b.org of the day is here\nand the other line of the text that is long enough for all rules"
    frame = spark.createDataFrame([(1, text, *range(len(NAMES))), (2, None, *range(len(NAMES)))], ", ".join(["doc_id long, text string", *["`" + n.replace("`", "``") + "` int" for n in NAMES]]))
    out = operator(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    for r in out.collect():
        assert list(r)[2 : 2 + len(NAMES)] == list(range(len(NAMES)))
