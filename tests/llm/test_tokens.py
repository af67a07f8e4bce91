"""Packing and BPE against the libraries, one text at a time."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from scanlake.llm import bpe, packing, wordcache
from tokenizers import Tokenizer

TEXTS = [
    "It's we're 12ab  \n\n x \x1e foo\x1e, <|endoftext|> é́ 你好 \U0001f600‍!! ' ''s",
    "", None, " ", "\t\n", "a" * 5000, "word " * 9000, "Σίσυφος ΣΑΣ İstanbul ß", "\x1c\x1d a\x1fb\x85c d", "tab\tnew\nline\r\n", "<|startoftext|>", "1234567 3.14 x1y2",
    "hello <|endoftext|> world", "a<|ENDOFTEXT|><|startoftext|>b \x1e c <|endoftext|", "long " * 3000 + "<|endoftext|>" + " tail" * 3000,
]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)


def test_bpe_against_tiktoken(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in enumerate(TEXTS):
        ids = TIK.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(tuple, bpe.round_trip(frame(spark, TEXTS)).collect())) == want


def test_offsets_and_split_characters(spark):
    rows = {r["doc_id"]: r for r in bpe.encode(frame(spark, TEXTS), with_offsets=True).collect()}
    coder = bpe.ByteBpe.of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for i, t in enumerate(TEXTS):
        r, raw = rows[i], (t or "").encode()
        assert r["byte_offsets"][-1] == len(raw) and r["char_offsets"][-1] == len(t or "")
        for k, one in enumerate(r["ids"]):
            a, b = r["byte_offsets"][k : k + 2]
            assert coder.decode_bytes([one]) == raw[a:b]
            assert r["char_offsets"][k] == len(raw[:a].decode("utf-8", "ignore")) + (1 if raw[:a].decode("utf-8", "ignore").encode() != raw[:a] else 0)
        cut = len(r["ids"]) // 2
        assert coder.decode_bytes(r["ids"][:cut]) + coder.decode_bytes(r["ids"][cut:]) == raw
    back = bpe.decode(bpe.encode(frame(spark, TEXTS)))
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    coder = bpe.ByteBpe.of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    (ids,) = coder.encode([text])
    assert ids.tolist() == TIK.encode_ordinary(text) and coder.decode(ids) == text


def test_added_tokens_are_those_of_the_library():
    (ids,) = wordcache.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json")).encode(["hello <|endoftext|> world"])
    assert ids.tolist() == LIBRARY.encode("hello <|endoftext|> world", add_special_tokens=False).ids and 49407 in ids.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "<|endoftext|>", "<|", "|>", "endoftext", "<|StartOfText|>", "\x1e", "\n", "é", "1"]), max_size=12))
def test_any_mixture_of_words_and_added_tokens(parts):
    text = "".join(parts)
    (ids,) = wordcache.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json")).encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "'", "S", "t", "re", "LL", "'m", "1", "É", "ß", "ÿ", "×", "ª", "µ", "²", "İ", "Σ", "\u0301", " ", "\xa0", "\n", "\x1c", "\x1e", ".", ",!", "</w>", "<|endoftext|>"]), max_size=14))
def test_any_mixture_of_parts(parts):
    text = "".join(parts)
    (ids,) = wordcache.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json")).encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


class Counted:
    """A tokenizer that keeps what it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **options):
        self.given += [w for t in texts for w in t.split()]
        return self.inner.encode_batch_fast(texts, **options)


def test_words_share_their_parts():
    """Capitals and punctuation cost no encoding of their own, and plain words none of the normaliser and pattern."""
    stems = [a + b for a in ("anth", "überö", "tion") for b in ("ou", "er", "ée", "st")]
    texts = [" ".join(f.format(w) for w in stems for f in ("{}", "({}),", "{}.", "{}'s")) for w in stems] + [" ".join(w.title() + "! " + w.upper() for w in stems)]
    wordcache.WordEncoder._made.clear()
    coder = wordcache.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    wordcache.WordEncoder._made.clear()
    whole, bare = Counted(coder.tokenizer), Counted(getattr(coder, "bare", None))
    coder.tokenizer, coder.bare = whole, bare
    assert [x.tolist() for x in coder.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole.given == [] and sorted(bare.given) == sorted({*stems, "(", "),", ".", "'s", "!"})


def test_other_rules_are_left_to_the_library(tmp_path):
    """A vocabulary that cuts words otherwise gets its own ids."""
    rules = json.loads(LIBRARY.to_str())
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    (tmp_path / "other.json").write_text(json.dumps(rules))
    text = "It's here, (there). Été"
    (ids,) = wordcache.WordEncoder.of(str(tmp_path / "other.json")).encode([text])
    assert ids.tolist() == Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids


def check(pieces, texts, size):
    ids = {i: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    got, seqs = {}, {}
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, whole in ids.items():
        assert sum(n for _, n in got[i]) == len(whole) and len({a for a, _ in got[i]}) == len(got[i])
    total = sum(map(len, ids.values()))
    assert sorted(seqs) == list(range(-(-total // size)))
    for s, parts in seqs.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == size or s == max(seqs)


def test_packing_against_the_library(spark):
    check(packing.pack(frame(spark, TEXTS)).collect(), TEXTS, 4096)
    check(packing.pack(frame(spark, TEXTS), size=16).collect(), TEXTS, 16)
    kept = packing.pack(frame(spark, ["a b c"]), keep_ids=True).collect()
    assert len(kept[0]["ids"]) == kept[0]["length"]


def test_packing_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(rows).collect()) == 4
    assert packing.pack(rows.limit(0)).collect() == []
