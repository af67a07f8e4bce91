"""License scans and PII: base spans against plain patterns, learnt and fuzzy parts on planted cases."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scanlake.llm import licenses, pii

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_licenses(text):
    words = WORDS.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x[1] for x in places}))


def test_licenses_against_plain_search(spark):
    rng = random.Random(1)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "License", "é", "under", "x1", "the"]
    texts = [None, "", "...", "MIT License mit license", "cc-by 4.0 CC BY", "the mit\nlicense, Apache\tLicense", "mitx license", "x\x00mit license"]
    texts += [rng.choice((" ", "-", "\n")).join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "mit license", "x")], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[None]["n_base"] == 1 and licenses.scan(rows.limit(0)).collect() == []


def test_fuzzy_notices(spark):
    rng = random.Random(4)
    s = licenses.Searcher(licenses.NOTICES)
    filler = " ".join(rng.choice(["thon", "erat", "ofthe", "undeing"]) for _ in range(400))
    for i, (notice, label) in enumerate(licenses.NOTICES.items()):
        damaged = list(notice)
        for _ in range(s.edits[i]):
            damaged[rng.randrange(len(damaged))] = "q"
        text = f"{filler} {''.join(damaged)} {filler}"
        found = [x for x in s.find(text) if x[2] == i]
        assert found and any(abs(x[0] - len(filler) - 1) <= s.edits[i] and x[3] <= s.edits[i] for x in found), notice
    assert s.find(filler) == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "@b", ".c", "1", "255", "256", ".", "1.2", " ", "-", "+", "+1", "(", ")", "4539 1488 0343 6467", "79927398713", "%", "é", "\n", "_", "0"]), max_size=25))
def test_base_spans_against_plain_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


def documents():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "no data here 12 34"), (3, "x@y.z and 1.2.3.4, +1 (234) 555-0199, 4539148803436467")]
    for i in range(4, 60):
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'line {i} token = "{token}" mail u{i}@mail.example.com tel (212) 555-{1000 + i} serial {rng.randrange(10**9)} aaaaaaaaaaaaaaaaaaaaaaa1'))
    return rows


def test_detect(spark):
    rows = documents()
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, (None, "a@b.c")]], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.detect(frame).collect()}
    for i, text in rows:
        base = plain_base(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() == pii.base_digest(base)
        assert [got[i][f"n_{n}"] for n in pii.BASE] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(filter(None, told.split(","))) <= set(got[i]["spans"].split(","))
    assert all("secret:" in got[i]["spans"] and "aaaa" not in got[i]["spans"] for i in range(4, 60))
    assert got[None]["n_email"] == 1 and got[2]["spans"] == "" and pii.detect(frame.limit(0)).collect() == []


def test_redact(spark):
    frame = spark.createDataFrame([(*r, 5) for r in documents()], "doc_id long, text string, n long")
    got = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "no data here 12 34"
    assert got[3] == "[EMAIL] and [IP], [PHONE], [CARD]"
    assert all("[SECRET]" in got[i] and "@" not in got[i] for i in range(4, 60))


def test_reliabilities_find_the_bad_labeler():
    """A labeler that votes at random gets a lower reliability than one that is right."""
    rng = random.Random(1)
    counts = {}
    n = len(pii.LABELERS)
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = [int(y) if rng.random() < 0.9 else int(not y) for _ in range(3)] + [int(rng.random() < 0.5)] + [2] * (n - 4)
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[(0, code)] = counts.get((0, code), 0) + 1
    _, table = pii.reliabilities(counts)
    right = [(table[k, 0, 0] + table[k, 1, 1]) / 2 for k in range(4)]
    assert min(right[:3]) > 0.85 and right[3] < 0.6


def test_inexact_notices_before_an_exact_one():
    """All notices of a merged window are found, not only those behind its best one."""
    found = licenses.Searcher({"licensed under cc by": "cc"}, 20).find("licensed undr cc by licensed under cc by licenced under cc by")
    assert [(e, d) for _, e, _, d in found] == [(19, 1), (40, 0), (61, 1)]


def distances(notice, text):
    """least[e][s]: the edit distance of ``text[s:e]`` to the notice, by the plain recurrence, for all s and e."""
    out = {}
    for s in range(len(text) + 1):
        row = list(range(len(notice) + 1))
        out[s, s] = row[-1]
        for e in range(s, min(len(text), s + 2 * len(notice))):
            new = [row[0] + 1]
            for j, c in enumerate(notice):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != text[e])))
            row = new
            out[s, e + 1] = row[-1]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["mit terms apply here", "given by acme inc now", "some other words", "x"]), st.lists(st.tuples(st.integers(0, 24), st.sampled_from(["", "q", "zz", " "])), max_size=3)), min_size=1, max_size=4))
def test_fuzzy_spans_against_edit_distances(parts):
    """Each span has the edits it states and no more than allowed; whatever is within the bound overlaps a span of its notice."""
    notices = {"mit terms apply here": "a", "given by acme inc now": "b"}
    pieces = []
    for text, changes in parts:
        for at, new in changes:
            text = text[:at] + new + text[at + 1 :]
        pieces.append(text)
    text = " ".join(" ".join(pieces).split())
    searcher = licenses.Searcher(notices, 10)
    found = searcher.find(text)
    for i, notice in enumerate(notices):
        least, k = distances(notice, text), searcher.edits[i]
        mine = [(a, b) for a, b, j, edits in found if j == i and (least[a, b] == edits <= k or pytest.fail(f"{text!r} {a} {b} {edits} {least[a, b]}"))]
        assert all(b <= c for (_, b), (c, _) in zip(mine, mine[1:], strict=False))
        for (s, e), d in least.items():
            assert d > k or any(s < b and a < e for a, b in mine), (text, s, e, d, mine)


def test_many_notices_and_identifiers(spark):
    """Several notices in one text, in any order, thousands of them, and identifier lines."""
    one = "Released under thx MIT license. Licensed undr CC BY. Licensed under the Apache License version 2."
    texts = [one, " ".join([one] * 3000), "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: mitx", "released under the mit license released undr the mit license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert [s["label"] for s in got[0]["spans"]] == ["mit", "cc-by", "apache"] and [s["edits"] for s in got[0]["spans"]] == [1, 1, 0]
    assert len(got[1]["spans"]) == 9000
    assert got[2]["labels"] == "apache" and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(0, 30)] and got[3]["labels"] == ""
    assert [s["edits"] for s in got[4]["spans"]] == [0, 1]


def plain_em(rows, rounds=50):
    """Expectation-maximisation one vote row at a time, from the definitions."""
    n = len(rows[0])
    start = {0: [0.4, 0.1, 0.5], 1: [0.1, 0.4, 0.5]}
    table = [{c: list(start[c]) for c in (0, 1)} for _ in range(n)]
    prior = 0.5
    for _ in range(rounds):
        post = []
        for votes in rows:
            like = {}
            for c, p in ((0, 1 - prior), (1, prior)):
                like[c] = p
                for k, v in enumerate(votes):
                    like[c] *= table[k][c][v]
            post.append(like[1] / (like[0] + like[1]))
        for k in range(n):
            for c in (0, 1):
                mass = [2 * x for x in start[c]]
                for votes, p in zip(rows, post, strict=True):
                    mass[votes[k]] += p if c else 1 - p
                table[k][c] = [m / sum(mass) for m in mass]
        prior = min(0.95, max(0.05, sum(post) / len(post)))
    return post, table


def test_reliabilities_against_plain_em():
    rng, n = random.Random(4), len(pii.LABELERS)
    rows = [[rng.choice([0, 1, 2, 2]) if rng.random() < 0.5 else int(i % 3 == 0) for _ in range(n)] for i in range(60)]
    rows += rows[:20]  # repeated patterns
    codes = [sum(v * 3 ** (n - 1 - k) for k, v in enumerate(votes)) for votes in rows]
    post, table = plain_em(rows)
    got, reliability = pii.reliabilities({(4, c): codes.count(c) for c in codes})
    assert all(abs(got[4, c] - p) < 1e-6 for c, p in zip(codes, post, strict=True))
    assert all(abs(reliability[k, c, v] - table[k][c][v]) < 1e-6 for k in range(n) for c in (0, 1) for v in range(3))


def test_the_classifier_looks_at_the_span():
    """Where votes weren't seen in training, what the text of a span and the word before it tell decides."""
    code = 3 ** len(pii.LABELERS) - 1  # every labeler abstains
    good, bad = pii.shape("aB3" * 9, 'token = "'), pii.shape("1" * 27, "serial ")
    theta = pii.span_classifier([(4, code - 1, good, 500), (4, code - 2, bad, 500)], {(4, code - 1): 0.99, (4, code - 2): 0.01})
    score = lambda h: sum(theta[a + int(i)] for a, i in zip(pii._STARTS, pii._steps(4, code, h), strict=False))
    assert score(good) > 1 > -1 > score(bad)
    assert pii.shape("abc", "") != pii.shape("abc", "token") and 0 <= pii.shape("é" * 1000, "x") < 2**31


def test_many_spans_in_one_text():
    """Time grows with the spans, not with their square; overlapping candidates give way to earlier ones."""
    text = " ".join(f"(212) 555-{i % 10000:04d}, 123-45-{i % 10000:04d};" for i in range(20_000))
    began = time.time()
    assert len(pii.candidates(text, pii.base_spans(text))) == 40_000 and time.time() - began < 20
    text = "1.2.3.4, 4111-1111-1111-1111 x 123-45-6789"
    spans = pii.candidates(text, pii.base_spans(text))
    assert [pii.KINDS[k] for _, k, *_ in spans] == ["ip", "card", "ssn"]
