"""Vectors, matrices, probabilities, attention and gradient descent as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of matrices in coordinates (row, col, value)."""
    left, right = a.select("row", F.col("col").alias("k"), F.col("value").alias("x")), b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def conditional(rows: DataFrame, given: str, of: str) -> DataFrame:
    """given, of, n, p: the share of each value among the rows with the same given value."""
    n = rows.groupBy(given, of).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(given)), 6))


def attention_weights(rows: DataFrame, heads: int = 1) -> DataFrame:
    """group, head, q, k, weight: causal scaled dot-product attention of rows (group, at, vector), each head on its slice of the vector.

    The pairs are within a group, the sequence; it must be short, as attention is quadratic.
    """
    split = rows.select("group", "at", "vector", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    width = F.floor(F.size("vector") / heads).cast("int")
    part = split.select("group", "at", "head", F.slice("vector", (F.col("head") * width + 1).cast("int"), width).alias("v"))
    a = part.select("group", "head", F.col("at").alias("q"), F.col("v").alias("x"))
    b = part.select("group", "head", F.col("at").alias("k"), F.col("v").alias("y"))
    scored = a.join(b, ["group", "head"]).where("k <= q").withColumn("s", dot(F.col("x"), F.col("y")) / F.sqrt(F.size("x").cast("double")))
    row = Window.partitionBy("group", "head", "q")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(row)))
    return e.select("group", "head", "q", "k", F.round(F.col("e") / F.sum("e").over(row), 6).alias("weight"))


def attend(rows: DataFrame, heads: int = 1) -> DataFrame:
    """group, head, q, dim, value: the weighted sums of the vectors' slices."""
    weights = attention_weights(rows, heads)
    width = F.floor(F.size("vector") / heads).cast("int")
    each = rows.select("group", F.col("at").alias("k"), width.alias("width"), F.posexplode("vector").alias("i", "x")).select("group", "k", F.floor(F.col("i") / F.col("width")).cast("int").alias("head"), (F.col("i") % F.col("width")).alias("dim"), "x")
    return weights.join(each, ["group", "head", "k"]).groupBy("group", "head", "q", "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("value"))


def linear_fit(rows: DataFrame, rate: float = 0.1, steps: int = 20) -> DataFrame:
    """step, w, b, loss of gradient descent for y = w x + b on rows (x, y), standardised x.

    The loss and the gradient are quadratic in (w, b), so one aggregation of
    moments over the data serves all steps.
    """
    n, sx, sy, sxx, sxy, syy = rows.agg(F.count("*"), F.avg("x"), F.avg("y"), F.avg(F.col("x") * F.col("x")), F.avg(F.col("x") * F.col("y")), F.avg(F.col("y") * F.col("y"))).first()
    w = b = 0.0
    out = []
    for step in range(steps + 1):
        loss = syy + w * w * sxx + b * b - 2 * w * sxy - 2 * b * sy + 2 * w * b * sx if n else 0.0
        out.append((step, w, b, loss))
        gw, gb = (2 * (w * sxx + b * sx - sxy), 2 * (b + w * sx - sy)) if n else (0.0, 0.0)
        w, b = w - rate * gw, b - rate * gb
    return rows.sparkSession.createDataFrame(out, "step int, w double, b double, loss double").select("step", *(F.round(c, 6).alias(c) for c in ("w", "b", "loss")))
