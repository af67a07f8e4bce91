"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Training takes a bounded sample (``SAMPLE`` vectors, more of them for large tables, ``MAX_SAMPLE`` at most, by a hash of the id)
on the driver: k-means for the coarse centroids, then a codebook per subspace of the residuals. Every vector is indexed: it
is assigned to its nearest centroid's list and coded by its residual. A query probes the lists of its nearest
centroids. There asymmetric distance tables rank the codes; the best ``SHORTLIST`` codes of all probed lists together
are its shortlist, whose vectors are then fetched by a join and reranked by exact distance in double precision. Codes alone
decide what gets on a shortlist, whatever the size of a list.

Scale. Lists hold codes, not vectors. Equal vectors are one entry, with their ``k`` + 1 smallest ids: no other copy can be
among any query's k nearest, as ties go to smaller ids. So one vector that a third of all rows share is one entry.
Likewise equal queries are searched once. A list is dealt out in chunks of about ``CHUNK`` codes and its queries
in blocks of about ``BLOCK``, so no task holds a whole list. The number of lists grows with the root of the vectors.

Defined results: vectors that are null, empty, of another length than the most frequent one, zero, or that hold null
or non-finite components take no part; a row without an id takes no part; of rows that repeat id and vector one
counts; with fewer than k candidates a query gets all; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import table, written

#: Vectors that training sees: so many, or ``PER_LIST`` for each list, up to the most.
SAMPLE, PER_LIST, MAX_SAMPLE = 20_000, 8, 1 << 18
SHORTLIST, CHUNK, BLOCK, K = 200, 65_536, 4096, 10
#: Queries of the sample on which the number of probed lists is set, and the part of their neighbours to be met.
TRIALS, TARGET = 400, 0.98
#: Entries of a matrix of distances at most.
CELLS = 4_000_000


def _blocks(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows whose matrices of ``width`` columns have at most ``CELLS`` entries."""
    step = max(1, CELLS // max(1, width))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and its squared distance."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (centres**2).sum(1)
    for b in _blocks(len(x), len(centres)):
        d = norms[None] - 2 * x[b] @ centres.T
        near[b] = d.argmin(1)
        far[b] = d[np.arange(len(d)), near[b]] + (x[b] ** 2).sum(1)
    return near, far


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids of at most ``k`` clusters; an empty cluster takes the point farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, d = nearest_centres(x, centres)
        far = np.argsort(-d, kind="stable")
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for j, i in zip(np.flatnonzero(n == 0), far, strict=False):
            centres[j] = x[i]
    return centres


@dataclass
class Index:
    """Coarse centroids and the codebooks of residuals: ``books[m, code]`` in subspace m."""

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> "Index":
        """Train on a sample ``x``."""
        x = x.astype(np.float64)
        centres = kmeans(x, min(lists, len(x)))
        residual = x - centres[nearest_centres(x, centres)[0]]
        width = next(w for w in (2, 4, 3, 1) if x.shape[1] % w == 0)
        parts = residual.reshape(len(x), -1, width)
        codes = min(256, len(x))
        return cls(centres, np.stack([kmeans(parts[:SAMPLE, m], codes, rounds=6, seed=m) for m in range(parts.shape[1])]))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and the codes of its residual."""
        near, _ = nearest_centres(x, self.centres)
        parts = (x - self.centres[near]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest_centres(np.ascontiguousarray(parts[:, m]), book)[0] for m, book in enumerate(self.books)], 1)
        return near.astype(np.int32), codes.astype(np.uint8)

    def probes(self, q: np.ndarray, sizes: np.ndarray, most: int, least_rows: int) -> Iterator[np.ndarray]:
        """Lists to search for each query: the ``most`` nearest non-empty ones, and more until they hold ``least_rows`` vectors."""
        norms, filled = (self.centres**2).sum(1), sizes > 0
        for b in _blocks(len(q), len(self.centres)):
            for row in (norms[None] - 2 * q[b] @ self.centres.T).argsort(1, kind="stable"):
                row = row[filled[row]]
                held = np.cumsum(sizes[row])
                yield row[: max(most, int(np.searchsorted(held, least_rows)) + 1)].astype(np.int32)

    def calibrate(self, x: np.ndarray, k: int, trials: int = TRIALS, target: float = TARGET) -> int:
        """How many lists to probe so that ``target`` of the true neighbours within sample ``x`` lie in them.

        A sample is sparser than the whole, so its neighbours are farther apart and the number errs upwards.
        """
        x = x.astype(np.float64)
        q = x[:trials]
        near, _ = nearest_centres(x, self.centres)
        places = []
        for b in _blocks(len(q), max(len(x), len(self.centres))):
            d = (x**2).sum(1)[None] - 2 * q[b] @ x.T
            d[np.arange(len(d)), np.arange(b.start, b.stop)] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
            order = ((self.centres**2).sum(1)[None] - 2 * q[b] @ self.centres.T).argsort(1, kind="stable")
            places.append(np.take_along_axis(np.argsort(order, 1), near[best], 1).ravel())  # of each list in each query's order
        at = np.sort(np.concatenate(places)) if places else np.empty(0)
        return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1 if len(at) else 1

    def rank(self, lst: int, q: np.ndarray, codes: np.ndarray, ids: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, asymmetric distances) of the ``most`` best codes of a list, for each query in turn."""
        residual = (q - self.centres[lst]).reshape(len(q), len(self.books), -1)
        for b in _blocks(len(q), len(ids)):
            part = residual[b]
            distance = np.zeros((len(part), len(ids)), np.float32)
            for m, book in enumerate(self.books):  # the distance table of subspace m, looked up by code
                distance += ((part[:, m, None, :] - book[None]) ** 2).sum(2).astype(np.float32)[:, codes[:, m]]
            for d in distance:
                yield best_of(ids, d, most)


def best_of(ids: np.ndarray, distances: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` smallest distances and their ids, ties to smaller ids."""
    if len(ids) > most:
        near = np.flatnonzero(distances <= np.partition(distances, most - 1)[most - 1])
        near = near[np.lexsort((ids[near], distances[near]))[:most]]
        return ids[near], distances[near]
    return ids, distances


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.empty((0, 1))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part; ``vec`` holds the components as little-endian doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, "<f8") + 0.0  # -0.0 becomes 0.0, so equal vectors have equal bytes
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, vec binary")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, vec, ids): one entry per distinct vector, with its ``k`` + 1 smallest ids; the first of them names it."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    return few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "vec", "ids")


def shortlists(indexed: DataFrame, single: DataFrame, model: Index, sizes: np.ndarray, probes: int, shortlist: int, k: int) -> DataFrame:
    """(q, vec_id): the ``shortlist`` entries of the probed lists whose codes are nearest to each query."""
    chunks = np.maximum(1, -(-sizes // CHUNK))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                pairs = [(int(lst), c, j) for j, ls in enumerate(model.probes(_matrix(part.column(1)), sizes, probes, 16 * (k + 1))) for lst in ls for c in range(int(chunks[lst]))]
                if pairs:
                    lists, cs, js = zip(*pairs, strict=True)
                    yield pa.record_batch([pa.array(lists, pa.int32()), pa.array(cs, pa.int32()), part.column(0).take(pa.array(js)), part.column(1).take(pa.array(js))], names=["list", "chunk", "q", "vec"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mixed = b.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            chunk = mixed.astype(np.int64) % chunks[b.column(0).to_numpy()]
            yield pa.record_batch([b.column(0), pa.array(chunk, pa.int32()), b.column(1), b.column(2)], names=["list", "chunk", "vec_id", "codes"])

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            found = [(i.astype("<i8").tobytes(), d.astype("<f4").tobytes()) for i, d in model.rank(key[0].as_py(), _matrix(left.column("vec")), codes, ids, shortlist)]
        return pa.table({"q": left.column("q") if found else pa.array([], pa.int64()), "ids": pa.array([f[0] for f in found], pa.binary()), "distances": pa.array([f[1] for f in found], pa.binary())})

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        ids, distances = (np.frombuffer(b"".join(part.column(i).to_pylist()), t) for i, t in ((1, "<i8"), (2, "<f4")))
        ids, _ = best_of(ids, distances, shortlist)
        return pa.table({"q": pa.array(np.full(len(ids), key[0].as_py(), np.int64)), "vec_id": pa.array(ids)})

    blocks = max(1, -(-single.count() * probes // (BLOCK * max(1, int((sizes > 0).sum())))))
    questions = single.select("q", "vec").mapInArrow(probe, "list int, chunk int, q long, vec binary").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    parts = indexed.select("list", "vec_id", "codes").mapInArrow(deal, "list int, chunk int, vec_id long, codes binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["list", "chunk", "block"]
    found = questions.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(search, "q long, ids binary, distances binary")
    return found.groupBy("q").applyInArrow(merge, "q long, vec_id long")  # a group: a row per probed list


def nearest(rows: DataFrame, k: int = K, every: int = 100, probes: int | None = None, shortlist: int = SHORTLIST, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by ``every``.

    ``probes`` lists are searched for each query; by default as many as ``Index.calibrate`` finds. ``sample`` is the least that
    training takes, see ``SAMPLE``.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = written(vectors(rows, id_col, vector_col), "ann-vectors")
    width = valid.groupBy(F.length("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return empty
    valid = valid.filter(F.length("vec") == width["w"])
    few = written(entries(valid, k), "ann-entries")
    lists = max(1, int(few.count() ** 0.5))
    sample = max(sample, min(MAX_SAMPLE, PER_LIST * lists))
    seen = _matrix(few.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("vec"))
    model = Index.fit(seen, max(1, min(lists, MAX_SAMPLE // PER_LIST)))
    probes = probes or model.calibrate(seen[:SAMPLE], k)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                assigned, codes = model.assign(_matrix(b.column(1)))
                yield pa.record_batch([pa.array(assigned), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "vec_id", "codes"])

    indexed = written(few.select("vec_id", "vec").mapInArrow(index, "list int, vec_id long, codes binary"), "ann-index")
    sizes = np.zeros(len(model.centres), np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]
    asked = valid.filter(F.col("vec_id") % every == 0).distinct()
    single = written(asked.groupBy("vec").agg(F.min("vec_id").alias("q")), "ann-queries")
    near = written(shortlists(indexed, single, model, sizes, probes, shortlist, k), "ann-shortlists")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = np.sqrt(((_matrix(b.column(2)) - _matrix(b.column(3))) ** 2).sum(1)) if b.num_rows else np.empty(0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(exact)], names=["q", "ids", "score"])

    fetched = near.join(few, "vec_id").select("q", "ids", "vec").join(single.select("q", F.col("vec").alias("asked")), "q").select("q", "ids", "vec", "asked")
    scored = fetched.mapInArrow(rerank, "q long, ids array<long>, score double").select("q", F.explode("ids").alias("vec_id"), "score")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("n") <= k + 1)
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))  # k + 1 entries at most
    answers = asked.join(single, "vec").select(F.col("vec_id").alias("query_id"), "q").join(best, "q")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op7_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth row."""
    return nearest(table(spark, sf_dir, "embeddings"))
