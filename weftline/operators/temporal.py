"""Joins in time and over ranges, and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, columns: list[str]) -> DataFrame:
    """left with the columns of the last right row of the same key whose time is not later; null if there is none.

    Both sides are sorted together by key, so nothing is compared pair by pair.
    On equal times the right row comes first; of equal right rows, one is taken.
    """
    a = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType)})
    b = right.select(by, on, F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_m", last).where("_side = 1").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """points with the ranges low <= at < high, by an equi-join on buckets of ``width``: each range is dealt to the buckets that it meets."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / F.lit(width)))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width)))))
    return p.join(r, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def tumbling(events: DataFrame, every: str, keys: list[str], value: str) -> DataFrame:
    """start, keys, n, total of event-time windows."""
    return events.groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, value: str) -> DataFrame:
    """start, n, total of overlapping event-time windows."""
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """key, start, n of runs of events less than ``gap`` apart."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
