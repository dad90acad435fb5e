"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text is three views of its words: the words themselves in lower case (runs of
one and two), their shapes (runs of one to three; letters, capitals, digits and
marks, repeated ones once: ``WORD!!`` is ``A!``), and which of three words in a
row are equal. Each run is hashed to one of 2**BITS features; a feature's value
is the square root of its share of its view, so a view has length 1 whatever the
length of the text.

Training takes every labelled row of the training folds. Rows are dealt to STEPS
batches by a hash of their text. A step is one Spark job: tasks add up their
rows' gradients in whole numbers of 2**-24, Spark sums these by feature, and the
driver, which holds three numbers for each feature and nothing of the corpus,
makes one FTRL-proximal update. Sums of whole numbers don't depend on how rows
are dealt to tasks, so neither do the weights. Scoring is a dot product for each
text in a single pass with broadcast weights, of fixed size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_IDS, shared_folder
from .words import U, Words, chunks, lower_ascii, mix, space_table, span_hashes

BITS = 18
FEATURES = 1 << BITS
#: Batches of one pass over the training rows, and passes.
STEPS = 12
PASSES = 2
#: Parameters of the updates.
ALPHA, BETA, L1, L2 = 0.3, 0.001, 1e-6, 1e-4
_UNIT = float(1 << 24)


def _shapes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x30:0x3A] = ord("0")
    t[0x41:0x5B] = ord("A")
    t[0x61:0x7B] = ord("a")
    t[0x80:] = ord("a")
    return t


def _runs(words: Words, h: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words."""
    at = words.windows(k)
    out = np.full(len(at), seed, np.uint64)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at + j])
    return words.doc[at], out


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a run of texts, by text and feature; a text without words has none."""
    words = Words(data, off, space_table())
    low = lower_ascii(data)
    letters = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    h = span_hashes(letters[low], words.starts, words.ends)
    # shapes: of equal classes in a row within a word the first stays
    shape = _shapes()[data]
    stays = np.ones(len(data), bool)
    stays[1:] = shape[1:] != shape[:-1]
    stays[words.starts] = True
    place = np.concatenate([[0], np.cumsum(stays)])
    s = span_hashes(letters[shape[stays]], place[words.starts], place[words.ends])
    views = [_runs(words, h, k, k) for k in (1, 2)] + [_runs(words, s, k, 10 + k) for k in (1, 2, 3)]
    at = words.windows(3)
    equal = (h[at] == h[at + 1]) + 2 * (h[at + 1] == h[at + 2]) + 4 * (h[at] == h[at + 2])
    views.append((words.doc[at], mix(equal.astype(np.uint64) + U(99))))
    out = []
    for doc, run in views:
        key, n = np.unique((doc.astype(np.int64) << BITS) | (run >> U(64 - BITS)).astype(np.int64), return_counts=True)
        doc = key >> BITS
        out.append((doc, key & (FEATURES - 1), np.sqrt(n / np.bincount(doc, n, minlength=len(off) - 1)[doc])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Model:
    """FTRL state: z and n of each feature; the last is the constant's."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> Model:
        return cls(np.zeros(FEATURES + 1), np.zeros(FEATURES + 1))

    def weights(self) -> np.ndarray:
        l1 = np.full(FEATURES + 1, L1)
        l1[-1] = 0
        w = -(self.z - np.sign(self.z) * l1) / ((BETA + np.sqrt(self.n)) / ALPHA + L2)
        return np.where(np.abs(self.z) <= l1, 0.0, w)

    def update(self, g: np.ndarray) -> None:
        """One step with the mean gradient of a batch."""
        w = self.weights()
        more = self.n + g * g
        self.z += g - (np.sqrt(more) - np.sqrt(self.n)) / ALPHA * w
        self.n = more


def probabilities(texts: pa.Array, weights: np.ndarray, each=None) -> np.ndarray:
    """Of label 1 for each text; each(first, texts, features, values, probabilities) sees every run of texts."""
    out = np.zeros(len(texts))
    for a, b, data, off in chunks(texts):
        doc, feature, value = features(data, off)
        dot = np.bincount(doc, weights[feature] * value, minlength=b - a) + weights[-1]
        out[a:b] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
        if each is not None:
            each(a, doc, feature, value, out[a:b])
    return out


def _gradients(weights):
    """Sums over a task's rows of (p - y) * value by feature, in units of 2**-24, without zeros; feature -1 counts the rows."""

    def run(batches):
        total, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            y = np.array(batch.column("y").to_pylist(), float)

            def add(a, doc, feature, value, p, y=y):
                off = p - y[a : a + len(p)]
                np.add.at(total, feature, np.rint(off[doc] * value * _UNIT).astype(np.int64))
                total[-1] += int(np.rint(off * _UNIT).astype(np.int64).sum())

            probabilities(batch.column("text"), weights.value, add)
            rows += len(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], ["feature", "g"])

    return run


def train(rows: DataFrame) -> np.ndarray:
    """Weights from all rows (text, y); y is 0 or 1. Without rows all are 0.

    The rows are written once, dealt to batches, in the shared folder.
    """
    spark = rows.sparkSession
    place = f"{shared_folder(spark)}/classifier-{uuid.uuid4().hex}"
    step = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(STEPS)).cast("int")
    rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y")).withColumn("step", step).write.partitionBy("step").parquet(place)
    dealt = spark.read.schema("text string, y int, step int").parquet(place)
    model = Model.new()
    for i in range(STEPS * PASSES):
        shared = spark.sparkContext.broadcast(model.weights())
        sums = dealt.where(F.col("step") == i % STEPS).mapInArrow(_gradients(shared), "feature int, g long").groupBy("feature").agg(F.sum("g").alias("g"))
        found = sums.toArrow()  # at most a number for each feature
        shared.destroy()
        feature, g = found.column("feature").to_numpy(), found.column("g").to_numpy()
        n = int(g[feature == -1].sum())
        if n:
            mean = np.zeros(FEATURES + 1)
            mean[feature[feature >= 0]] = g[feature >= 0] / (_UNIT * n)
            model.update(mean)
    return model.weights()


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of the training folds: documents whose crc32 of the id as text, modulo 3, is not 1, with a quality of 0 or 1 in labels (doc_id, quality).

    Labels without an id or with another quality are left out. A row of docs
    counts once for each different label of its id. Up to BROADCAST_IDS labels
    are broadcast, so that no text is shuffled; more are joined by shuffling.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    known = known.where(~_held_out())
    few = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return own.join(F.broadcast(known) if few else known, "doc_id").select("text", "y")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _score(weights):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(batch.column("text"), weights.value))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (probability of label 1) of every row of docs, from its text alone; a null text is empty, and an empty one has the score of the constant."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_score(shared), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), by a model trained on labels.

    held_out rows, whose crc32 of the id as text modulo 3 is 1, are never learnt
    from. A null doc_id is scored and not held out. Without a label to learn from all scores are
    0.5; no docs give no rows. Equal texts have equal scores.
    """
    scored = score(docs, train(labelled(docs, labels)))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
