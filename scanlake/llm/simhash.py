"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they agree in
at least 5 positional bytes: the guaranteed minimum of matches. Posting lists of single positional bytes
would hold 1/256 of all fingerprints each, so the index posts each distinct fingerprint under every
combination of 5 positional bytes (56 keys of 40 bits): a pair meets under a key exactly if its
tally of shared positional bytes reaches the minimum. Members of a posting list are then tallied and
verified against each other inside the task, and only a spanning forest of the verified links leaves it;
pairs are never emitted. A list's members differ in the 24 bits outside the key, so no list can hold
more than 2**24 fingerprints (128 MB); long lists are searched by flipping 3 or fewer of those bits, which
is linear in the list, instead of comparing all members.

Equal fingerprints are one node. Components come from alternating large-star and small-star steps over
tables in the shared folder; no links, components or fingerprints reach the driver.

Defined results: a null or wordless text has fingerprint zero and links to others that have it; a row
without doc_id is a member but never the representative (a component of such rows alone has a null
component_id); repeated rows are returned as often as they come; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import table, text_bytes, written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Positional bytes that a linked pair shares at least.
MIN_SHARED = 8 - MAX_BITS
#: Lists up to this length are compared member by member, longer ones by flipping bits.
DENSE = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of whole UTF-8 ``text``; bit set if set in over half of the shingle hashes, repeats counted."""
    words = text.lower().split()  # bytes: A-Z alone is lowered, white space is \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for every row, and the long columns ``also``; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                fps = np.array([fingerprint(x) for x in text_bytes(b.column(1))], np.uint64)
                yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *also])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also).mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{c} long" for c in also]]))


_SUBSETS = list(combinations(range(8), MIN_SHARED))


def postings(nodes: DataFrame) -> DataFrame:
    """(posting, fp): each fingerprint under its 56 keys of five positional bytes, the key's number above them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 2048):
                part = fps[i : i + 2048]
                octets = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
                keys = np.stack([sum((octets[:, p] << (8 * j) for j, p in enumerate(s)), np.int64(k) << 40) for k, s in enumerate(_SUBSETS)], axis=1)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part, len(_SUBSETS)).view(np.int64))], names=["posting", "fp"])

    return nodes.select("fp").mapInArrow(run, "posting long, fp long")


def _dense_labels(fps: np.ndarray) -> np.ndarray:
    x = fps[:, None] ^ fps[None, :]
    shared = (x.view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(axis=2)  # the tally of positional bytes
    linked = (shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)
    labels = np.arange(len(fps))
    while True:
        new = np.where(linked, labels[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def _sparse_labels(fps: np.ndarray) -> np.ndarray:
    """The same for a long list: partners are looked up by flipping the bits in which members differ. ``fps`` is sorted."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    links = []
    for k in range(1, MAX_BITS + 1):
        for flip in combinations(bits, k):
            other = fps ^ np.uint64(sum(flip))
            at = np.searchsorted(fps, other)
            hit = np.flatnonzero(fps[np.minimum(at, len(fps) - 1)] == other)
            hit = hit[at[hit] < hit]  # each link once
            if len(hit):
                links.append((hit.astype(np.int32), at[hit].astype(np.int32), k))
    labels = np.arange(len(fps))
    while True:
        before = labels.copy()
        for a, b, _ in links:
            low = np.minimum(labels[a], labels[b])
            np.minimum.at(labels, a, low)
            np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (before == labels).all():
            return labels


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: links (u, v), v the root of u among the verified links of a posting list."""
    key, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        sizes = ends - starts
        pair = starts[sizes == 2]
        a, b = fps[pair], fps[pair + 1]
        ok = np.bitwise_count(a ^ b) <= MAX_BITS
        us, vs = [a[ok]], [b[ok]]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            group = np.unique(fps[s:e])
            labels = _dense_labels(group) if len(group) <= DENSE else _sparse_labels(group)
            rest = labels != np.arange(len(group))
            us.append(group[rest])
            vs.append(group[labels[rest]])
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        for i in range(0, len(u), 1 << 14):
            yield pa.record_batch([pa.array(u[i : i + (1 << 14)]), pa.array(v[i : i + (1 << 14)])], names=["u", "v"])

    for b in batches:
        key, fps = np.r_[key, b.column(0).to_numpy()], np.r_[fps, b.column(1).to_numpy().view(np.uint64)]
        if not len(key) or key[0] == key[-1]:
            continue  # one list so far; it has 2**24 members at most
        last = int(np.searchsorted(key, key[-1]))
        yield from links(key[:last], fps[:last])
        key, fps = key[last:], fps[last:]
    if len(key):
        yield from links(key, fps)


def near_links(nodes: DataFrame) -> DataFrame:
    """Distinct links (u, v) between fingerprints at 3 or fewer bits that connect whatever such pairs connect."""
    lists = postings(nodes).repartition("posting").sortWithinPartitions("posting")
    return lists.mapInArrow(forest, "u long, v long").distinct()


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes, which takes rounds in the order of the
    logarithm of the links; each round's links are written to the shared folder.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low)
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return _roots(edges)
        seen = state


def _roots(stars: DataFrame) -> DataFrame:
    return stars.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first, root) of the distinct fingerprints of ``prints``: an aggregate of each one's rows, and its component."""
    nodes = written(prints.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    roots = components(near_links(nodes), "simhash-cc")
    return written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    roots = rooted(prints, F.min("doc_id"))
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = roots.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under SimHash."""
    return near_duplicates(table(spark, sf_dir, "documents"))
