"""Whether a run is better than another: Poisson bootstrap in one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_share

#: Weights above this are this; of a Poisson variable with mean 1, a share of 1e-7 is.
MOST = 9


def poisson_cuts() -> list[int]:
    """The 32-bit numbers from which on a weight is 1, 2, ..., MOST."""
    below, out = 0.0, []
    for k in range(MOST):
        below += math.exp(-1) / math.factorial(k)
        out.append(math.floor(below * 2**32))
    return out


def poisson_weight(share: Column) -> Column:
    """How often a resample with replacement takes a case, about, by a hash of the case and the resample (a number below 2**32)."""
    return sum(((share >= cut).cast("int") for cut in poisson_cuts()[1:]), (share >= poisson_cuts()[0]).cast("int"))


def bootstrap(before: DataFrame, after: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """metric, n, delta, low, high, better: the mean change from one run (case_id, metric, value) to another, its interval, and the share of resamples in which it is positive.

    Each replicate weighs each case by a hash of both, so the same cases give
    the same interval anywhere, a case has one weight in all metrics, and a
    case's metrics stay together. Tasks sum their cases' changes by metric and
    replicate before anything is shuffled: rows are not sorted, drawn or copied
    to a group. Cases of one run only are left out.
    """
    both = before.select("case_id", "metric", F.col("value").alias("a")).join(after.select("case_id", "metric", F.col("value").alias("b")), ["case_id", "metric"])
    change = both.select("case_id", "metric", (F.col("b") - F.col("a")).alias("d")).where("d is not null")
    each = change.select("metric", "d", "case_id", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("r"))  # 0 is the run itself
    each = each.select("metric", "d", "r", hash_share(F.concat_ws(":", F.col("case_id").cast("string"), F.col("r").cast("string"))).alias("share"))
    weight = F.when(F.col("r") == 0, 1).otherwise(poisson_weight(F.col("share")))
    sums = each.groupBy("metric", "r").agg(F.sum(F.col("d") * weight).alias("s"), F.sum(weight).alias("w"), F.count("*").alias("n"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w"))
    drawn = F.when(F.col("r") > 0, F.round(mean, 9))
    return sums.groupBy("metric").agg(
        F.max("n").alias("n"),
        F.round(F.max(F.when(F.col("r") == 0, mean)), 6).alias("delta"),
        F.round(F.percentile(drawn, (1 - level) / 2), 6).alias("low"),
        F.round(F.percentile(drawn, (1 + level) / 2), 6).alias("high"),
        F.round(F.avg((drawn > 0).cast("int")), 6).alias("better"),
    )
