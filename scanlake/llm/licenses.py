"""License scans: fuzzy search for short notices.

Every notice of ``NOTICES`` is cut into k + 1 pieces; a passage within k edits of the notice holds at least one
piece unchanged (pigeonhole). One automaton finds all pieces of all notices in a text; where one occurs, the
window in which the notice would lie is searched by the regex library with at most k errors, which verifies
the edits and gives the span. Windows are as long as a notice and its edits, so the work is linear in the places where pieces
occur. Overlapping spans of one notice keep the one with fewest edits, then the first; whatever lies within k edits of
a notice overlaps a reported span of it.

Besides, exact phrases of words are counted (``PHRASES``), anywhere in the text, and identifier lines (``IDENTIFIERS``) are found exactly.

Defined results: a null text is empty; a text without words has zero counts, empty labels and score 0; a row
without doc_id is scanned and keeps its null; repeated rows are returned as often as they come; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import table, text_bytes

#: Phrases of words and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, as normalised words, and their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "licensed under the apache license version": "apache",
    "licensed under cc by": "cc-by",
    "licensed under a creative commons attribution": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the bsd license": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "dedicated to the public domain under cc0": "cc0",
}
#: What follows the words of an identifier line, as normalised words, and its label.
IDENTIFIERS = {
    "spdx license identifier " + words: label
    for words, label in {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "isc": "isc", "cc by": "cc-by", "cc0": "cc0"}.items()
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normalise(text: bytes) -> tuple[str, int]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text, space-joined, and their number."""
    words = text.translate(_WORDS).split()
    return b" ".join(words).decode("utf-8", "replace"), len(words)


class Searcher:
    """The automaton over pieces and the compiled patterns of a set of notices."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT) -> None:
        import ahocorasick

        self.notices, self.edits = list(notices.items()), [len(n) // chars_per_edit for n in notices]
        self.patterns = [regex.compile(rf"(?be)(?:{regex.escape(n, special_only=True)}){{e<={k}}}", regex.V1) for n, k in zip(notices, self.edits, strict=True)]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, k) in enumerate(zip(notices, self.edits, strict=True)):
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(notice[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice's number, edits) of verified notices in normalised text, in order."""
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.seeds.iter(text):
            for i, a in where:
                starts.setdefault(i, set()).add(last + 1 - size - a)
        return sorted((a, b, i, edits) for i, places in starts.items() for edits, a, b in self._verified(text, i, sorted(places)))

    def _verified(self, text: str, i: int, places: list[int]) -> list[tuple[int, int, int]]:
        """(edits, start, end) of notice ``i``, from where its pieces say that it would start."""
        size, k, spans = len(self.notices[i][0]), self.edits[i], []
        for first, last in _runs(places, 2 * k, 4 * size):
            todo = [(max(0, first - k), min(len(text), last + size + k))]
            while todo:  # a search gives the best match of a range; others stand before and after it
                a, b = todo.pop()
                if b - a >= size - k and (m := self.patterns[i].search(text, a, b)):
                    spans.append((sum(m.fuzzy_counts), m.start(), m.end()))
                    todo += [(a, m.start()), (m.end(), b)]
        return _apart(spans)


def _runs(places: list[int], near: int, most: int) -> Iterator[tuple[int, int]]:
    """First and last of runs of ascending numbers at most ``near`` apart and ``most`` long."""
    first = last = places[0]
    for p in places[1:]:
        if p - last > near or p - first > most:
            yield first, last
            first = p
        last = p
    yield first, last


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) those that don't overlap one with fewer edits, or as many and an earlier start."""
    starts, ends, kept = [], [], []
    for edits, a, b in sorted(set(spans)):
        at = bisect_right(starts, a)
        if (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            kept.append((edits, a, b))
    return kept


@lru_cache(4)
def _searcher(notices: tuple, chars_per_edit: int) -> Searcher:
    return Searcher(dict(notices), chars_per_edit)


def phrase_spans(joined: str, phrases: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, label) of each place where a phrase's words stand consecutively in space-joined words."""
    if any(p in joined for p in phrases):
        padded = f" {joined} "
        for phrase, label in phrases.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                yield at, at + len(phrase), label
                at = padded.find(f" {phrase} ", at + 1)


def phrase_places(joined: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """The same as (word number, label), in order."""
    spans = list(phrase_spans(joined, phrases))
    spaces = [i for i, c in enumerate(joined) if c == " "] if spans else []
    return sorted((bisect_right(spaces, a), label) for a, _, label in spans)


def scan(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and ``spans``: (start, end) in the normalised text, label, edits, similarity.

    ``score`` is 1 where a phrase stands, else the best similarity of a notice, else 0.
    """
    identifiers = IDENTIFIERS if notices is None else {}
    notices, phrases = tuple((notices or NOTICES).items()), dict(phrases or PHRASES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(notices, chars_per_edit)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                rows = []
                for text in text_bytes(part.column(1)):
                    joined, n = normalise(text)
                    places = phrase_places(joined, phrases)
                    spans = [{"start": s, "end": e, "label": notices[k][1], "edits": d, "similarity": 1 - d / len(notices[k][0])} for s, e, k, d in searcher.find(joined)]
                    spans += [{"start": s, "end": e, "label": label, "edits": 0, "similarity": 1.0} for s, e, label in phrase_spans(joined, identifiers)]
                    spans.sort(key=lambda x: (x["start"], x["end"], x["label"]))
                    base = {x[1] for x in places}
                    best = 1.0 if places else max((x["similarity"] for x in spans), default=0.0)
                    rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in spans})), best, spans))
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("similarity", pa.float64())]))]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.record_batch([part.column(0), *columns], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, edits: long, similarity: double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document; ``spans`` as ``label:start:end:edits`` in the normalised text, comma-joined."""
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))), ",")
    return scan(table(spark, sf_dir, "documents")).withColumn("spans", told)
