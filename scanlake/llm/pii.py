"""Personal data: weak-supervision aggregation of regex, gazetteer and context labelers.

Base spans (e-mail, ip, card, phone) are always reported. Besides, looser patterns propose candidates of further
kinds (secrets, social security numbers, IBANs, local phone numbers). ``LABELERS`` vote on every candidate: 1 for
personal data, 0 against, 2 abstains. Votes are counted over the whole corpus by vote pattern (at most
kinds x 3**labelers of them); on these counts expectation-maximisation estimates every labeler's
reliability. A logistic span classifier is trained on the posteriors; it sees, besides kind and votes, the span's
length, entropy, digits, capitals and separators and the word before it (``FIELDS``, ``CONTEXT``). It learns from at most ``SAMPLE``
distinct candidates, chosen by a hash and weighted by how often they occur; the reliabilities, and the decision on every
candidate, cover the whole corpus. A candidate becomes a span if the classifier gives it 0.5 or more and it overlaps no other.

Texts are read once: base spans, candidates and votes go to a table in the shared folder.

Defined results: a null text is empty and has no spans; a row without doc_id is scanned and keeps its null;
repeated rows are returned as often as they come; an empty table gives an empty result; other
columns pass through ``redact`` and aren't read by ``detect``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanlake.llm.common import table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "local_phone")
_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile("[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always starts where a run of digits does, so the look-behind only saves restarts within a run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EXTRA = {
    "secret": re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}+"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
}
#: Gazetteers: words that stand before personal data, by kind; top-level domains; codes of countries.
CUES = {
    "email": "mail email e-mail contact write",
    "ip": "ip host server address from client",
    "card": "card visa mastercard amex credit number karte carte tarjeta",
    "phone": "phone tel call fax mobile telefon téléphone teléfono",
    "secret": "token key secret password passwd apikey api_key bearer auth",
    "ssn": "ssn social security",
    "iban": "iban account konto compte cuenta",
    "local_phone": "phone tel call fax mobile telefon téléphone teléfono",
}
DOMAINS = frozenset("com org net edu gov io info biz de fr es uk eu us it nl ch at".split())
COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR IE IT LU NL NO PL PT SE".split())


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their at signs, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)  # the part before this at sign can't belong to a later match
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of base spans, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _by_shape(kind: str, s: str, before: str, after: str) -> int:
    if kind == "secret":
        return 1 if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_-]{24,}", s) else 0
    return 1 if kind in ("email", "ip", "card", "phone", "ssn") else 2


def _by_checksum(kind: str, s: str, before: str, after: str) -> int:
    if kind == "card":
        return int(luhn(_digits(s)))
    if kind == "iban":
        return int(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    if kind == "ssn":
        return int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    return 2


def _by_gazetteer(kind: str, s: str, before: str, after: str) -> int:
    if kind == "email":
        return int(s.rpartition(".")[2].lower() in DOMAINS)
    if kind == "iban":
        return int(s[:2] in COUNTRIES)
    if kind == "card":
        return int(s[0] in "3456")
    return 2


def _by_cue(kind: str, s: str, before: str, after: str) -> int:
    words = re.findall(r"[\w-]+", before.lower())[-3:]
    return 1 if set(words) & set(CUES[kind].split()) else 2


def _by_assignment(kind: str, s: str, before: str, after: str) -> int:
    if kind != "secret":
        return 2
    return 1 if re.search(r"[=:]\s*[\"']?$", before) else 0


def _by_boundary(kind: str, s: str, before: str, after: str) -> int:
    return 0 if before[-1:].isalnum() or after[:1].isalnum() else 2


def _by_variety(kind: str, s: str, before: str, after: str) -> int:
    e = _entropy(s)
    return (1 if e >= 3 else 0) if kind == "secret" else (0 if e < 1.5 else 2)


LABELERS = (_by_shape, _by_checksum, _by_gazetteer, _by_cue, _by_assignment, _by_boundary, _by_variety)


#: Features of a span besides kind and votes: so many fields of eight steps each, and so many buckets of the word before it.
FIELDS, CONTEXT = 5, 64
#: Distinct candidates that the span classifier learns from at most.
SAMPLE = 20_000


def shape(s: str, before: str) -> int:
    """The features of a span as one number: ``FIELDS`` digits in base 8, and above them the bucket of the word before it."""
    n = len(s)
    word = re.findall(r"\w+", before.lower())[-1:]
    steps = (min(7, n // 6), min(7, int(2 * _entropy(s))), 7 * len(_digits(s)) // n, 7 * sum(c.isupper() for c in s) // n, min(7, sum(not c.isalnum() for c in s)))
    return sum(v * 8**i for i, v in enumerate(steps)) + 8**FIELDS * (zlib.crc32(word[0].encode()) % CONTEXT if word else 0)


class _Taken:
    """Places in a text that spans take, in order; asking for a place takes time in the logarithm of the spans."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.places: list[tuple[int, int]] = []
        for a, _, b in sorted(spans):
            if self.places and a < self.places[-1][1]:  # base spans of different kinds can overlap
                self.places[-1] = (self.places[-1][0], max(b, self.places[-1][1]))
            else:
                self.places.append((a, b))

    def take(self, a: int, b: int) -> bool:
        """Take a place if it overlaps none taken before."""
        at = bisect_left(self.places, (b,))
        if at and self.places[at - 1][1] > a:
            return False
        insort(self.places, (a, b))
        return True


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's number, end, votes as a number in base 3, ``shape``) of base spans and of further candidates clear of them."""
    spans = list(base)
    if _DIGIT.search(text):
        taken = _Taken(base)
        for k, kind in enumerate(KINDS[len(BASE) :], len(BASE)):
            spans += [(m.start(), k, m.end()) for m in _EXTRA[kind].finditer(text) if taken.take(m.start(), m.end())]
    out = []
    for a, k, b in sorted(spans):
        before, s, after = text[max(0, a - 40) : a], text[a:b], text[b : b + 8]
        votes = 0
        for f in LABELERS:
            votes = votes * 3 + f(KINDS[k], s, before, after)
        out.append((a, k, b, votes, shape(s, before)))
    return out


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in reversed(range(len(LABELERS)))]


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """Expectation-maximisation over (kind, votes) -> count: the posterior of each pattern, and P(vote | class) per labeler.

    ``table[l, c, v]`` is labeler l's probability of vote v under class c (1: personal data). It starts from
    labelers that are right four times in five; counts are smoothed, so a labeler that never votes stays neutral.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((len(LABELERS), 2, 3))
    votes = np.array([_votes(v) for _, v in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    start = np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])
    reliability, prior = np.repeat(start[None], len(LABELERS), 0), 0.5
    for _ in range(rounds):
        logs = np.array([[np.log(reliability[np.arange(len(LABELERS)), c, v]).sum() for c in (0, 1)] for v in votes]) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        for c, p in ((0, 1 - post), (1, post)):
            mass = np.stack([((votes == v) * (p * weight)[:, None]).sum(0) for v in range(3)], 1) + start[c] * 2
            reliability[:, c] = mass / mass.sum(1, keepdims=True)
        prior = float(np.clip((post * weight).sum() / weight.sum(), 0.05, 0.95))
    return dict(zip(patterns, post.tolist(), strict=True)), reliability


#: Parts of the classifier's weights: bias, kinds, votes of each labeler, fields, context; each candidate has one weight of each.
_PARTS = [1, len(KINDS), *[3] * len(LABELERS), *[8] * FIELDS, CONTEXT]
_STARTS = np.cumsum([0, *_PARTS])


def _steps(kind, votes, shape) -> list:
    """Which weight of each part of ``_PARTS`` applies, for numbers, arrays or Columns."""
    whole = (lambda x, d: F.floor(x / d)) if isinstance(votes, Column) else (lambda x, d: x // d)
    n = len(LABELERS)
    return [kind * 0, kind, *[whole(votes, 3 ** (n - 1 - i)) % 3 for i in range(n)], *[whole(shape, 8**i) % 8 for i in range(FIELDS)], whole(shape, 8**FIELDS)]


def span_classifier(rows: list[tuple[int, int, int, int]], posterior: dict[tuple[int, int], float], steps: int = 40, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights from (kind, votes, shape, count) and the posteriors of (kind, votes); a row weighs the root of its count."""
    size = int(_STARTS[-1])
    if not rows:
        return np.zeros(size)
    kind, votes, shapes, counts = np.array(rows, np.int64).T
    x = np.zeros((len(rows), size), np.float32)
    for start, step in zip(_STARTS, _steps(kind, votes, shapes), strict=False):
        x[np.arange(len(rows)), start + step] = 1
    y, w = np.array([posterior[k, v] for k, v in zip(kind.tolist(), votes.tolist(), strict=True)]), np.sqrt(counts)
    w, theta = w / w.sum(), np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x.T * (w * p * (1 - p) + 1e-9)) @ x + ridge * np.eye(size)
        step = np.linalg.solve(hessian, x.T @ (w * (p - y)) + ridge * theta)
        theta -= step
        if abs(step).max() < 1e-6:
            break
    return theta


_SPANS = "array<struct<start: long, kind: int, `end`: long, votes: int, shape: int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' columns and, last, ``_spans``: candidates with votes, base ones among them. One pass over the texts."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.int32()), ("shape", pa.int32())]))
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = []
                for text in part.column(at).to_pylist():
                    spans = candidates(text, base) if text and ((base := base_spans(text)) or _DIGIT.search(text)) else []
                    found.append([{"start": a, "kind": k, "end": e, "votes": v, "shape": h} for a, k, e, v, h in spans])
                yield pa.record_batch([*part.columns, pa.array(found, kind)], names=[*part.schema.names, "_spans"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"_spans {_SPANS}").fields]))


def learnt(scanned: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The span classifier's weights: reliabilities from vote counts over all of ``scanned``, the classifier from at most ``sample`` of its distinct candidates."""
    counted = written(scanned.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count(), "pii-votes")
    patterns = counted.groupBy("kind", "votes").agg(F.sum("count").alias("n")).collect()  # bounded by the number of vote patterns
    posterior, _ = reliabilities({(r["kind"], r["votes"]): r["n"] for r in patterns})
    chosen = counted.orderBy(F.xxhash64("kind", "votes", "shape"), "kind", "votes", "shape").limit(sample).collect()
    return span_classifier([tuple(r) for r in chosen], posterior)


def _final(scanned: DataFrame, least: float = 0.5) -> DataFrame:
    """``scanned`` with ``_spans`` cut down to those reported: base ones, and those that the classifier gives ``least`` or more."""
    theta = learnt(scanned)
    weights = [F.array(*[F.lit(float(x)) for x in theta[a:b]]) for a, b in zip(_STARTS, _STARTS[1:], strict=False)]
    score = lambda s: sum(F.get(w, step.cast("int")) for w, step in zip(weights, _steps(s["kind"], s["votes"], s["shape"]), strict=True))
    return scanned.withColumn("_spans", F.filter("_spans", lambda s: (s["kind"] < len(BASE)) | (score(s) >= math.log(least / (1 - least)))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row."""
    core = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(scan(core).drop("text"), "pii")
    base = F.filter("_spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return _final(scanned).select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span (start, kind's number, end) replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; null texts stay null."""
    # columns may have any name, so the operator works on numbered ones
    names, types = docs.columns, docs.schema
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    found = _final(written(scan(numbered, text_col=f"c{at}"), "pii-redact"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = [t if not t or not s else redacted(t, [(x["start"], x["kind"], x["end"]) for x in s]) for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
                columns = list(b.columns[:-1])
                columns[at] = pa.array(texts, b.column(at).type)
                yield pa.record_batch(columns, names=names)

    return found.mapInArrow(run, types)


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest that ``detect`` gives for base spans (start, kind's number, end)."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return detect(table(spark, sf_dir, "documents"))
