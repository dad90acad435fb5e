"""Logistic regression on hashed terms, for moderation and quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import hash_share
from ..sources.shared import if_few, keep

#: Words, and runs of marks between them.
TERM = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SCALE = 10_000


def clues(text: Column, words: Column) -> Column:
    """Statistics of a text in steps, as terms of their own: shares of marks, capitals, different words and different lines, and the number of words."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    different = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    step = lambda name, x: F.concat(F.lit(f"\t{name} "), F.floor(x).cast("string"))
    return F.array(
        step("marks", F.least(50 * share(r"[\p{L}\p{N}\s]"), F.lit(12))),
        step("capitals", 10 * share(r"\P{Lu}")),
        step("words", 10 * different(words)),
        step("lines", 10 * different(lines)),
        step("size", F.log2(F.size(words) + F.lit(1.0))),
    )


def hashed_terms(text: Column, width: int, with_clues: bool = False) -> Column:
    """Distinct buckets of a text's lower-cased words and marks, and of its clues() if asked for, ascending; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    terms = F.concat(F.array_distinct(words), clues(text, words)) if with_clues else F.array_distinct(words)
    return F.array_sort(F.array_distinct(F.transform(terms, lambda t: (hash_share(t) % width).cast("int"))))


def _dots(features: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat features, row of each, dot product of each row); a feature's value is 1 over the root of the row's number of features."""
    if isinstance(features, pa.ChunkedArray):
        features = features.combine_chunks()
    flat = features.flatten().to_numpy(zero_copy_only=False)
    sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes, 1))
    return flat, row, np.bincount(row, weights[flat], minlength=len(sizes)) * value + weights[-1]


def _gradient(weights):
    """The sums of a task's losses and gradients, as one row of bytes: loss, gradient, rows."""

    def run(batches):
        w = weights.value
        total = np.zeros(len(w) + 2)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            flat, row, dot = _dots(batch.column("features"), w)
            total[0] += np.logaddexp(0, dot).sum() - (y * dot).sum()
            off = 1 / (1 + np.exp(-dot)) - y
            sizes = np.bincount(row, minlength=len(y))
            total[1:-2] += np.bincount(flat, (off / np.sqrt(np.maximum(sizes, 1)))[row], minlength=len(w) - 1)
            total[-2] += off.sum()
            total[-1] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


class Logistic:
    """A logistic regression over hashed terms; ``weights`` has one number for each bucket and a constant at its end."""

    def __init__(self, weights: np.ndarray, losses: list[float] | None = None):
        self.weights, self.losses = weights, losses or []

    @classmethod
    def fit(cls, rows: DataFrame, width: int, l2: float = 1e-4, rounds: int = 30, memory: int = 8) -> Logistic:
        """The weights that minimise the mean log loss of all rows (y, features) plus ``l2`` / 2 times their squares, the constant's left out.

        Each round is one job: tasks sum their losses and gradients, and a tree
        of tasks sums these up, so the driver gets one vector of ``width``
        numbers. It then makes a limited-memory quasi-Newton step, halved while
        the loss doesn't fall. The optimum is unique, so how rows are dealt to
        tasks matters to rounding only. Without rows all weights are 0.
        """
        spark = rows.sparkSession
        rows = keep(rows.select(F.col("y").cast("int").alias("y"), "features").where("y is not null and features is not null"))

        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast(w)
            parts = rows.mapInArrow(_gradient(shared), "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
            total = parts.treeReduce(lambda a, b: a + b, depth=2)
            shared.destroy()
            n = max(total[-1], 1.0)
            penalty = np.append(w[:-1], 0.0) * l2
            return total[0] / n + float(w[:-1] @ w[:-1]) * l2 / 2, total[1:-1] / n + penalty

        w = np.zeros(width + 1)
        loss, g = at(w)
        losses, steps = [loss], []
        for _ in range(rounds):
            if not np.any(np.abs(g) > 1e-7):
                break
            d, saved = -g, []
            for s, y in reversed(steps):
                a = (s @ d) / (s @ y)
                saved.append(a)
                d = d - a * y
            if steps:
                s, y = steps[-1]
                d = d * ((s @ y) / (y @ y))
            for (s, y), a in zip(steps, reversed(saved), strict=True):
                d = d + (a - (y @ d) / (s @ y)) * s
            length = 1.0 if steps else min(1.0, 1 / np.abs(g).sum()) * 10
            while True:
                new_loss, new_g = at(w + length * d)
                if new_loss <= loss + 1e-4 * length * (g @ d) or length < 1e-8:
                    break
                length /= 2
            s, y = length * d, new_g - g
            if new_loss >= loss:
                break
            if s @ y > 1e-12:
                steps = [*steps, (s, y)][-memory:]
            w, loss, g = w + s, new_loss, new_g
            losses.append(loss)
        return cls(w, losses)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with ``score``, the probability of 1 of their features; without features that of the constant."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)
        at = rows.columns.index("features")

        def run(batches):
            for batch in batches:
                p = 1 / (1 + np.exp(-_dots(batch.column(at), shared.value)[2]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

        schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
        return rows.mapInArrow(run, schema)


def folds(key: Column) -> Column:
    """'train' (6 of 10), 'tune' (2 of 10) or 'test' by a hash of the key."""
    share = hash_share(key) % 10
    return F.when(share < 6, "train").when(share < 8, "tune").otherwise("test")


def best_threshold(scored: DataFrame) -> float:
    """The least score from which on rows (y, score) are called 1 so that F1 is largest, ties by the larger one; 0.5 without a row of 1.

    Scores are counted in steps of 1 / SCALE, so what is sorted is SCALE rows at most.
    """
    step = F.floor(F.col("score") * SCALE).cast("int").alias("step")
    counts = scored.groupBy(step).agg(F.sum(F.col("y").cast("long")).alias("hits"), F.count("*").alias("n"))
    down = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)  # SCALE rows at most
    so_far = counts.select("step", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("called"), F.sum("hits").over(Window.partitionBy()).alias("all"))
    f1 = 2 * F.col("tp") / (F.col("called") + F.col("all"))
    best = so_far.where("all > 0").agg(F.max_by("step", F.struct(f1, "step"))).first()[0]
    return 0.5 if best is None else best / SCALE


def confusion(rows: DataFrame, called: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, f1 of rows (y) that are called 1."""
    y, c = F.col("y") == 1, F.coalesce(called, F.lit(False))
    out = rows.agg(F.count_if(y & c).alias("tp"), F.count_if(~y & c).alias("fp"), F.count_if(y & ~c).alias("fn"), F.count_if(~y & ~c).alias("tn"))
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


def trained(docs: DataFrame, labels: DataFrame, width: int = 1 << 14, l2: float = 1e-4, rounds: int = 30, with_clues: bool = False) -> tuple[Logistic, float]:
    """A model of labels (doc_id, y) by the texts of docs (doc_id, text), fitted on the training fold, and its threshold from the tuning fold."""
    known = docs.select("doc_id", "text").join(if_few(labels.where("y in (0, 1)").select("doc_id", "y").distinct()), "doc_id")  # few labels shuffle no text
    rows = keep(known.select(folds(F.col("doc_id")).alias("fold"), "y", hashed_terms(F.col("text"), width, with_clues).alias("features")).where("fold != 'test'"))
    model = Logistic.fit(rows.where("fold = 'train'"), width, l2, rounds)
    return model, best_threshold(model.score(rows.where("fold = 'tune'").select("y", "features")))


def judge(docs: DataFrame, model: Logistic, threshold: float, with_clues: bool = False) -> DataFrame:
    """doc_id, score, flagged of every document by a model of trained()."""
    rows = docs.select("doc_id", hashed_terms(F.col("text"), len(model.weights) - 1, with_clues).alias("features"))
    return model.score(rows).select("doc_id", F.round("score", 4).alias("score"), (F.col("score") >= threshold).alias("flagged"))
