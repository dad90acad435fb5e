"""Product quantisation: vectors as short codes, searched by tables, re-scored by the vectors themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.shared import among
from .best import FOUND, SCORES, Best, matrix

#: Queries whose tables are in one broadcast, at 1 kB a part each.
QUERY_BLOCK = 512
#: Queries in one broadcast of the exact search.
EXACT_BLOCK = 4096
CODES = 256


def _units(vectors: list) -> np.ndarray:
    m = np.array(vectors, float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _good(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.col("vector").cast("array<double>").alias("vector"), *more).where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()) & F.exists("vector", lambda x: x != 0))


def _top(scored: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "item_id", "score", F.col("rank").cast("int").alias("rank"))


class ProductIndex:
    """Codes of all vectors of a corpus (id, vector): rows (id, codes, error).

    A vector of length 1 is cut into ``parts``; each part is replaced by the
    nearest of 256 centres, so a vector is one byte for each part, and 4 for the
    length of what the code misses, ``error``. Centres are fitted by k-means on a sample of
    at most ``sample`` rows; every row gets a code. ``refine``, the number of
    candidates that are re-scored for one result, is the least with which
    ``recall`` of the ten nearest of held-out sampled queries are among them,
    scaled to the corpus. Rows with a zero vector or a null in it are left out;
    all vectors have the same width, a multiple of ``parts``.
    """

    def __init__(self, corpus: DataFrame, parts: int = 16, sample: int = 20_000, rounds: int = 12, recall: float = 0.97, seed: int = 5):
        self.corpus, self.parts = _good(corpus), parts
        near = self.corpus.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
        units = _units([r["vector"] for r in near]) if near else np.zeros((0, parts))
        self.width = units.shape[1]
        if self.width % parts:
            raise ValueError(f"{self.width} numbers can't be cut into {parts} equal parts")
        self.centres = self._fit(units, rounds)
        self.refine = self._refine(units, recall, self.corpus.count())
        centres = self.centres

        def encode(batches):
            for batch in batches:
                unit = _units(batch.column("vector").to_pylist()) if len(batch) else np.zeros((0, centres.shape[0] * centres.shape[2]))
                codes = _encode(unit, centres)
                error = np.linalg.norm(unit - _decode(codes, centres), axis=1)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(np.nextafter(error.astype(np.float32), np.float32(np.inf)))], ["id", "codes", "error"])

        self.rows = self.corpus.mapInArrow(encode, "id long, codes binary, error float")

    def _fit(self, units: np.ndarray, rounds: int) -> np.ndarray:
        """Centres by part, code and number."""
        cut = units.reshape(len(units), self.parts, self.width // self.parts)
        out = np.zeros((self.parts, CODES, cut.shape[2]))
        rnd = np.random.default_rng(7)
        for p in range(self.parts):
            x = cut[:, p]
            if not len(x):
                continue
            c = x[rnd.choice(len(x), CODES, replace=len(x) < CODES)]
            for _ in range(rounds):
                own = np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, axis=1)
                n = np.bincount(own, minlength=CODES)
                sums = np.stack([np.bincount(own, x[:, d], minlength=CODES) for d in range(x.shape[1])], axis=1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            out[p] = c
        return out

    def _refine(self, units: np.ndarray, recall: float, n: int, k: int = 10, queries: int = 200) -> int:
        """Candidates for each result."""
        if len(units) <= k + 1:
            return max(1, n)
        held = np.arange(max(0, len(units) - queries), len(units))
        guess = units[held] @ _decode(_encode(units, self.centres), self.centres).T
        true = units[held] @ units.T
        for m in (guess, true):
            m[np.arange(len(held)), held] = -2
        best = np.argpartition(-true, k, axis=1)[:, :k]
        places = np.argsort(np.argsort(-guess, axis=1), axis=1)
        needed = np.sort(np.take_along_axis(places, best, 1).ravel())
        at = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1
        return max(2, int(np.ceil(at * max(1.0, n / len(units)) / k)))

    def _search(self, queries: DataFrame, each) -> DataFrame:
        """each(guesses, errors, k-th floor) says by query which rows of a batch are candidates; queries: id, vector, floor."""
        spark = self.corpus.sparkSession
        centres, out = self.centres, None
        n = queries.count() if self.corpus.head(1) else 0
        blocks = max(1, -(-n // QUERY_BLOCK))
        for block in range(blocks if n else 0):
            rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about QUERY_BLOCK
            if not rows:
                continue
            units = _units([r["vector"] for r in rows]).reshape(len(rows), self.parts, -1)
            tables = np.einsum("qpd,pcd->qpc", units, centres)
            shared = spark.sparkContext.broadcast(([r["id"] for r in rows], tables, [r["floor"] for r in rows]))

            def scan(batches, shared=shared):
                ids, tables, floors = shared.value
                for batch in batches:
                    if not len(batch):
                        continue
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), -1)
                    item, error = batch.column("id").to_numpy(), batch.column("error").to_numpy().astype(float)
                    for q, table, floor in zip(ids, tables, floors, strict=True):
                        guess = np.zeros(len(codes))
                        for p in range(codes.shape[1]):
                            guess += table[p][codes[:, p]]
                        at = each(guess, error, floor, item != q)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int64)), pa.array(item[at]), pa.array(guess[at])], ["query_id", "item_id", "score"])

            found = self.rows.mapInArrow(scan, "query_id long, item_id long, score double")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else spark.createDataFrame([], "query_id long, item_id long, score double")

    def _rescored(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """Candidates with the cosines of the vectors themselves."""
        near = among(self.corpus.withColumnRenamed("id", "item_id"), candidates, "item_id")
        both = candidates.select("query_id", "item_id").join(near, "item_id").join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id")
        return both.select("query_id", "item_id", F.round(cosine(F.col("q"), F.col("vector")), 6).alias("score"))

    def topk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, item_id, score, rank: of the ``refine`` * k best by code, the k best by cosine. A query's own id is left out."""
        queries, most = _good(queries).withColumn("floor", F.lit(None).cast("double")), self.refine * k

        def best(guess, error, floor, other):
            at = np.flatnonzero(other)
            return at[np.argpartition(-guess[at], most - 1)[:most]] if len(at) > most else at

        candidates = _top(self._search(queries, best), most)
        return _top(self._rescored(candidates, queries), k)

    def exact_topk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The exact k nearest: a code's score is off by at most its error, so rows whose score and error stay under the k-th best found so far can't be nearer.

        Codes and vectors are read side by side: what the codes can't rule out
        is scored by the vectors in the same task, which keeps its k best of each
        query. So what is shuffled is k rows for each query and task, also where
        the codes rule out little.
        """
        spark, centres = self.corpus.sparkSession, self.centres
        queries, out = _good(queries), None
        n = queries.count() if self.corpus.head(1) else 0
        blocks = -(-n // EXACT_BLOCK)
        for block in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about EXACT_BLOCK
            if not rows:
                continue
            shared = spark.sparkContext.broadcast(([r["id"] for r in rows], _units([r["vector"] for r in rows])))

            def scan(batches, shared=shared):
                ids, units = shared.value
                best, every, step = Best(ids, k), np.arange(len(ids)), max(1, SCORES // len(ids))
                for batch in batches:
                    ok, m = matrix(batch.column("vector"), units.shape[1])
                    items = batch.column("id").to_numpy(zero_copy_only=False)[ok]
                    m = m / np.linalg.norm(m, axis=1, keepdims=True)
                    for a in range(0, len(items), step):
                        item, own = items[a : a + step], m[a : a + step]
                        code = _decode(_encode(own, centres), centres)
                        bound = units @ code.T + np.linalg.norm(own - code, axis=1)[None, :]
                        possible = (bound >= best.floor[:, None] - 1e-5) & (best.ids[:, None] != item[None, :])
                        if possible.mean() > 1 / 16:
                            best.offer_all(every, item, units @ own.T, possible)
                        else:
                            q, i = np.nonzero(possible)
                            best.offer(q, item[i], np.einsum("ij,ij->i", units[q], own[i]))
                yield from best.batches()

            found = self.corpus.select("id", "vector").mapInArrow(scan, FOUND)
            out = found if out is None else out.unionByName(found)
        return _top(out if out is not None else spark.createDataFrame([], FOUND), k)


def _encode(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = centres.shape[0]
    cut = units.reshape(len(units), parts, -1)
    return np.stack([np.argmin((centres[p] ** 2).sum(1)[None] - 2 * cut[:, p] @ centres[p].T, axis=1) for p in range(parts)], axis=1).astype(np.uint8)


def _decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([centres[p][codes[:, p]] for p in range(centres.shape[0])], axis=1)
