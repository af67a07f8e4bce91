"""Toxicity: weak supervision by many lexicon and pattern voters.

Voters. ``SEEDS`` and ``PATTERNS`` are given; further lexicon entries (words, and beginnings of words, which catch
inflected and compounded forms) are mined from labelled training rows: those that are frequent in toxic and all
but absent in other texts. Each voter votes for toxic where its entry occurs, else abstains. ``AGAINST`` voters vote against,
by evidence of their own, whether or not an entry occurs: words that are frequent in other texts and rare in toxic
ones (mined into ``PARTS`` lexicons of their own), long texts that address nobody, and the silence of all entries. Else they abstain.

Label model. A generative model with one latent class per text gives every voter its rates under both classes,
fitted by expectation-maximisation on the votes. Voters that agree beyond what the class explains
(pairwise correlation of residuals, taken after the first rounds) share their weight. Its posteriors, not the labels, are the
targets of a logistic classifier over occurrences of entries, which scores every text.

Only rows outside the held-out fold (crc32 of the id modulo 5 is not 0) are learnt from: at most
``SAMPLE`` of them, chosen by a hash of the id. That bounds the driver's memory; scoring covers all texts.
Neither labels nor lang, source or doc_id enter a score.

Defined results: a null or empty text is scored as one without any entry; a row without doc_id is scored,
its held_out is null; a label without a text or with a null isn't used, of conflicting labels the
larger holds; without training rows the given voters alone decide; repeated rows are returned as often as
they come; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import table

#: Labelled rows that are learnt from at most.
SAMPLE = 6000
FOLDS = 5
SEEDS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting".split()
PATTERNS = (r"\byou (?:are|re) (?:an? )?(?:\w+ )?(?:fool|idiot|loser)\b", r"\bshut up\b", r"\bgo (?:die|to hell)\b", r"\bkill (?:yourself|them all)\b")
#: Lengths of word beginnings that may become entries.
PREFIXES = range(3, 9)
#: An entry is in so many toxic texts of the sample; of the texts it is in, so large a part is toxic; so many texts it adds.
SUPPORT, PRECISION, GAIN = 4, 0.93, 2
VOTERS = 400
#: Lexicons of words that speak against, and words of them; how many voters against there are.
PARTS, FRIENDLY = 2, 40
AGAINST = PARTS + 2
#: Words of a text that counts as long, and words that address somebody.
LONG = 40
_ADDRESS = frozenset("you your yours yourself u ur du dich dir ihr tu te toi vous tú usted vosotros".split())
#: Residual correlation from which voters share their weight.
CORRELATED = 0.3
#: Words whose entries a ``matcher`` remembers.
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")
_PATTERN = re.compile("|".join(PATTERNS))


def terms(word: str) -> list[str]:
    """What a lower-case word can match: itself (``=word``) and its beginnings (``beginning~``)."""
    return ["=" + word, *[word[:k] + "~" for k in PREFIXES if len(word) >= k]]


def matcher(entries: Container[str]) -> Callable[[Iterable[str]], set[str]]:
    """What of ``entries`` words match; each word's own are remembered, for at most ``REMEMBERED`` words."""
    known: dict[str, tuple[str, ...]] = {}

    def matched(words: Iterable[str]) -> set[str]:
        hits: set[str] = set()
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = tuple(t for t in terms(w) if t in entries)
            if got:
                hits.update(got)
        if len(known) > REMEMBERED:
            known.clear()
        return hits

    return matched


def text_words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def mine(texts: list[str | None], toxic: np.ndarray, given: list[str] = (), support: int = SUPPORT, precision: float = PRECISION, gain: int = GAIN, most: int = VOTERS) -> list[str]:
    """Entries that occur in toxic texts and hardly elsewhere, at most ``most``.

    Greedy: the entry with most toxic texts goes first, and each entry must be in ``gain`` toxic texts that
    neither ``given`` entries nor those before it are in. Texts with the same words count once, so copies
    give no support. Of entries that occur in the same texts the longest is taken, as it claims least.
    Words are taken from a text when they are needed and not kept; other texts are only searched for what toxic ones have.
    """
    seen: set[int] = set()
    unlike = []
    inside: Counter = Counter()
    for i in sorted(range(len(texts)), key=lambda i: not toxic[i]):
        ws = text_words(texts[i])
        if (key := hash(frozenset(ws))) not in seen:
            seen.add(key)
            unlike.append(i)
            if toxic[i]:
                inside.update({t for w in ws for t in terms(w)})
    inside = {t: n for t, n in inside.items() if n >= support}
    outside: Counter = Counter()
    matched = matcher(inside)
    for i in unlike:
        if not toxic[i]:
            outside.update(matched(text_words(texts[i])))
    good = {t for t, n in inside.items() if n / (n + outside[t] + 0.3) >= precision}
    having: dict[str, list[int]] = {t: [] for t in good}
    covered = set()
    matched = matcher(good | set(given))
    for i in unlike:
        if toxic[i]:
            own = matched(text_words(texts[i]))
            covered |= {i} if own & set(given) else set()
            for t in own & good:
                having[t].append(i)
    same: dict[tuple, str] = {}
    for t in sorted(good, key=lambda t: (-len(t), t)):
        same.setdefault((*having[t], outside[t]), t)
    chosen = []
    for t in sorted(same.values(), key=lambda t: (outside[t] * 10 - len(having[t]), -len(t), t)):
        if len(set(having[t]) - covered) >= gain and len(chosen) < most:
            chosen.append(t)
            covered.update(having[t])
    return chosen


def friendly(texts: list[str | None], toxic: np.ndarray, words: int = FRIENDLY, parts: int = PARTS) -> list[set[str]]:
    """Lexicons of the ``words`` words whose share among other texts most exceeds that among toxic ones, dealt out by rank."""
    counts = [Counter(w for i, t in enumerate(texts) if bool(toxic[i]) == c for w in text_words(t)) for c in (False, True)]
    n = np.bincount(toxic.astype(int), minlength=2) + 2
    lead = {w: k / n[0] - (counts[1][w] + 1) / n[1] for w, k in counts[0].items()}
    best = sorted((w for w in lead if lead[w] > 0), key=lambda w: (-lead[w], w))[:words]
    return [set(best[k::parts]) for k in range(parts)]


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior per text, rates[voter, class] of voting, and the prior. ``votes`` holds 1 where a voter votes, 0 where it abstains.

    Which class a voter speaks for comes out of its rates; the last one, which must vote against, says where they start. Residual
    correlations of voters within the classes set their weights: voters that always vote together count as one.
    """
    v = votes.astype(float)
    post = np.where(v[:, -1] > 0, 0.05, 0.95)
    weight = np.ones(v.shape[1])
    for r in range(rounds):
        prior = float(np.clip(post.mean(), 0.01, 0.99))
        rates = np.stack([((1 - post) @ v + 0.02) / ((1 - post).sum() + 1), (post @ v + 0.05) / (post.sum() + 1)], 1)
        if r == 2 and len(v) > 2:  # later, classes may have come to be what a group of voters says, which explains its agreement away
            residual = v - (post[:, None] * rates[:, 1] + (1 - post)[:, None] * rates[:, 0])
            sd = np.sqrt((residual**2).mean(0)) + 1e-9
            near = np.clip((residual.T @ residual) / len(v) / sd[:, None] / sd[None, :], 0, 1)
            near[near < CORRELATED] = 0
            np.fill_diagonal(near, 1)
            weight = 1 / near.sum(1)
        fire = weight * (np.log(rates[:, 1]) - np.log(rates[:, 0]))
        rest = weight * (np.log1p(-np.clip(rates[:, 1], 0, 0.999)) - np.log1p(-np.clip(rates[:, 0], 0, 0.999)))
        logit = np.log(prior / (1 - prior)) + v @ fire + (1 - v) @ rest
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rates, prior


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, steps: int = 40) -> np.ndarray:
    """Weights and, last, the intercept (not shrunk) of a logistic regression on soft targets, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    theta = np.zeros(x.shape[1])
    shrink = np.r_[np.full(x.shape[1] - 1, ridge), 1e-9]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + shrink * theta
        hessian = (x.T * (p * (1 - p) / len(y) + 1e-9)) @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if abs(step).max() < 1e-6:
            break
    return theta


@dataclass
class Model:
    """Entries with weights; ``score`` is the classifier's probability."""

    entries: dict[str, float]
    pattern: float
    none: float
    intercept: float

    def score(self, hits: set[str], pattern: bool) -> float:
        """From the entries that occur and whether a pattern does."""
        z = self.intercept + sum(self.entries[t] for t in hits) + self.pattern * pattern + self.none * (not hits and not pattern)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """Voters, label model and classifier from a sample of labelled texts."""
    entries = ["=" + s for s in SEEDS]
    y = np.array(toxic, bool)
    entries += [t for t in mine(texts, y, entries) if t not in entries] if y.any() else []
    if not y.any() or y.all():
        return Model(dict.fromkeys(entries, 4.0), 4.0, 0.0, -3.0)
    index = {t: i for i, t in enumerate(entries)}
    n, calm = len(entries), friendly(texts, y)
    votes = np.zeros((len(texts), n + 1 + AGAINST), np.float32)
    matched = matcher(index)
    for i, text in enumerate(texts):
        words = text_words(text)
        votes[i, [index[t] for t in matched(words)]] = 1
        votes[i, n] = bool(_PATTERN.search((text or "").lower()))
        votes[i, n + 1 :] = [*[bool(words & f) for f in calm], len(words) >= LONG and not words & _ADDRESS, not votes[i, : n + 1].any()]
    post, _, _ = label_model(votes)
    theta = logistic(votes[:, [*range(n + 1), -1]].astype(float), post)
    return Model(dict(zip(entries, theta[:n].tolist(), strict=True)), float(theta[n]), float(theta[n + 1]), float(theta[-1]))


def fold(id_col: str = "doc_id") -> "F.Column":
    """crc32 of the id as text, modulo ``FOLDS``; the fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold, by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of texts that repeat an id always the same one
    return texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(first).select("doc_id", "text", "toxic")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matched = matcher(model.entries)
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                out.append(model.score(matched(text_words(text)), bool(text and _PATTERN.search(text.lower()))))
            got = np.array(out, float)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the driver from a bounded sample."""
    rows = training_rows(docs, labels, sample).toArrow().sort_by("doc_id")
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
