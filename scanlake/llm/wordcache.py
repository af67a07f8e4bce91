"""Encoding by the tokenizers library, each distinct piece of text once while it is remembered.

A text is cut into pieces at places where the tokenizer itself always cuts, so the ids of a text are those of
its pieces one after another. Texts repeat their words, so most pieces are found in a table of at
most ``LIMIT`` entries per Python worker (cleared when full); the others go to the library in one batch.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers, and the longest that it does (characters); longer ones are encoded each time.
LIMIT = 600_000
LONGEST = 40


class PieceEncoder:
    """Encodes texts piece by piece; ``split`` gives a text's pieces in order.

    Unknown pieces are encoded many at a time: joined by ``glue``, around a mark that is one id, which
    the tokenizer never merges with its neighbours where ``joinable`` holds for them; the others go singly.

    The strings of added tokens are ordinary text with ``plain``. Otherwise the library takes them for these tokens
    wherever it finds them, and a text that holds one is encoded whole.
    """

    _made: dict = {}
    MARK = "\x1e"

    def __init__(self, vocab: str, split: Callable[[str], list[str]], glue: str, joinable: Callable[[str], bool], plain: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.tokenizer.encode_special_tokens = plain
        # added tokens can be looked for behind the normaliser, so letters are compared without case
        self.added = [] if plain else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split, self.glue, self.joinable, self.known = split, glue, joinable, {}
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _whole(self, text: str) -> bool:
        low = text.lower() if self.added else ""
        return any(a in low for a in self.added)

    def _fresh(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        joined = [p for p in pieces if self.mark is not None and self.MARK not in p and self.joinable(p) and not self._whole(p)]
        groups = [joined[i : i + 128] for i in range(0, len(joined), 128)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([self.glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids, size = np.array(e.ids, self.dtype), self.dtype.itemsize
            raw, marks = ids.tobytes(), (np.flatnonzero(ids == self.mark) * size).tolist()
            if len(marks) != len(group) - 1:
                raise ValueError("the mark between pieces was merged")
            yield from zip(group, [raw[a:b] for a, b in zip([0, *[m + size for m in marks]], [*marks, len(raw)], strict=True)], strict=True)
        single = list(set(pieces).difference(joined))
        for p, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            yield p, np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, in two bytes each where the vocabulary allows it."""
        known = self.known
        if len(known) > LIMIT:  # what came first is the most frequent
            for p in list(known)[LIMIT // 2 :]:
                del known[p]
        pieces = [[t] if self._whole(t) else self.split(t) for t in texts]
        new: set[str] = set()
        for ps in pieces:
            new.update(set(ps).difference(known))
        long = {}
        for p, ids in self._fresh(list(new)):
            (known if len(p) <= LONGEST else long)[p] = ids
        for ps in pieces:
            try:
                yield np.frombuffer(b"".join(map(known.__getitem__, ps)), self.dtype)
            except KeyError:
                yield np.frombuffer(b"".join([known[p] if p in known else long[p] for p in ps]), self.dtype)


class WordEncoder(PieceEncoder):
    """For vocabularies that drop white space and never join text across it: the pieces are words.

    A batch's words are split, counted out and put together again by Arrow; Python sees each distinct word of a
    batch once. Where the vocabulary cuts words by ``RULES``, an unknown word of ASCII and Latin-1 letters is cut
    here into the same parts, so words that differ in case and punctuation share theirs; only unknown parts
    are encoded, by the library's model without its normaliser and pattern. Other words go to the library as they are.
    """

    #: Normaliser and cutting of words that ``_PARTS`` repeats, as the vocabulary's file has them.
    RULES = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )
    # NFC leaves these characters alone, and lower case maps each to one of them; parts of many words are found at once, a \n between words
    _SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")

    def __init__(self, vocab: str) -> None:
        super().__init__(vocab, str.split, f" {self.MARK} ", lambda p: True, plain=False)
        from tokenizers import Tokenizer, pre_tokenizers

        self.bare, self.last = None, np.zeros(0, bool)
        rules, names = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab(with_added_tokens=False)
        suffix, bytes_ = rules["model"].get("end_of_word_suffix"), pre_tokenizers.ByteLevel.alphabet()
        if (rules["normalizer"], rules["pre_tokenizer"]) == self.RULES and suffix and not rules["model"]["dropout"] and max(names.values()) < np.iinfo(self.dtype).max and all(b in names and b + suffix in names for b in bytes_):
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(names.values()) + 1, bool)
            self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True

    @classmethod
    def of(cls, vocab: str) -> "WordEncoder":
        """This worker's encoder for ``vocab``; made once."""
        if (key := (cls, vocab)) not in cls._made:
            cls._made[key] = cls(vocab)
        return cls._made[key]

    def _bare(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Parts are joined by spaces; the end of each is told by its last id."""
        found = self.bare.encode_batch_fast([" ".join(parts[i : i + 128]) for i in range(0, len(parts), 128)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), self.dtype)
        raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
        return zip(parts, [raw[a:b] for a, b in pairwise([0, *ends])], strict=True)

    def _fresh(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        simple = [p for p in pieces if self._SIMPLE.fullmatch(p)] if self.bare is not None else []
        others = list(set(pieces).difference(simple)) if len(simple) < len(pieces) else []
        if simple:
            # words of small letters are their own parts
            composed = [p for p in simple if not (p.isalpha() and p.islower())]
            parts = self._PARTS.findall("\n".join(composed).lower())
            made = {p: self.known.get(p) for p in {*parts, *set(simple).difference(composed)}}
            new = dict(self._bare([p for p, x in made.items() if x is None and p != "\n"]))
            yield from new.items()
            if composed:
                none = np.array([np.iinfo(self.dtype).max], self.dtype)  # an id of no token, between words
                made |= new | {"\n": none.tobytes()}
                raw, size = b"".join(map(made.__getitem__, parts)), self.dtype.itemsize
                ends = (np.flatnonzero(np.frombuffer(raw, self.dtype) == none) * size).tolist()
                yield from zip(composed, [raw[a + size : b] for a, b in pairwise([-size, *ends, len(raw)])], strict=True)
        yield from super()._fresh(others)

    def encode(self, texts: "list[str] | pa.Array") -> Iterator[np.ndarray]:
        """As in ``PieceEncoder``; ``texts`` can be an Arrow array without nulls."""
        if len(self.known) > LIMIT:  # what came first is the most frequent
            self.known = dict(islice(self.known.items(), LIMIT // 2))
        known = self.known
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = self._held(texts)
        # white space beyond ASCII stays inside words, as \x1C-\x1F do; the library knows about it
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts) if any(whole) else texts)
        each = split.values.dictionary_encode()
        names = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, names))
        fresh = dict(self._fresh([p for p, x in zip(names, ids, strict=True) if x is None and p]))
        ids = [fresh.get(p, b"") if x is None else x for p, x in zip(names, ids, strict=True)]
        known.update(fresh if max(map(len, fresh), default=0) <= LONGEST else {p: x for p, x in fresh.items() if len(p) <= LONGEST})
        _, ends, raw = pa.array(ids, pa.large_binary()).take(each.indices).buffers()
        starts = np.frombuffer(ends, np.int64, len(each) + 1)[split.offsets.to_numpy()] // self.dtype.itemsize if len(each) else np.zeros(len(texts) + 1, int)
        flat = np.frombuffer(raw, self.dtype, starts[-1]) if starts[-1] else np.zeros(0, self.dtype)
        for i, (a, b) in enumerate(pairwise(starts.tolist())):
            yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype) if whole[i] else flat[a:b]

    def _held(self, texts: pa.Array) -> list[bool]:
        """Which texts hold an added token, as ``_whole`` says."""
        found = np.zeros(len(texts), bool)
        for a in self.added:
            found |= pc.match_substring(texts, a, ignore_case=True).to_numpy(zero_copy_only=False)
        return found.tolist()
