"""Cost and usage of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def cost_summary(calls: DataFrame) -> DataFrame:
    """model, endpoint, gid, tokens, cost over models, endpoints, both and all, of calls (model, endpoint, tokens, cost)."""
    calls.createOrReplaceTempView("_calls")
    return calls.sparkSession.sql(
        f"SELECT model, endpoint, grouping_id(model, endpoint) AS gid, sum(tokens) AS tokens, cast(sum(cost) AS {MONEY}) AS cost FROM _calls GROUP BY GROUPING SETS ((model), (endpoint), (model, endpoint), ())"
    )


def estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, tokens) with cost by a price table (model, price per 1000 tokens); unknown models have a null cost."""
    return usage.join(prices.select("model", "price"), "model", "left").withColumn("cost", (F.col("tokens").cast("decimal(18,0)") * F.col("price").cast("decimal(10,6)") / 1000).cast(MONEY)).drop("price")


def cache_savings(calls: DataFrame, key: list[str], order: str) -> DataFrame:
    """model, calls, hits, saved: repeats of a request (the key) within a model would be answered by a cache."""
    nth = F.row_number().over(Window.partitionBy("model", *key).orderBy(order))
    return calls.withColumn("nth", nth).groupBy("model").agg(F.count("*").alias("calls"), F.count_if(F.col("nth") > 1).alias("hits"), F.round(F.coalesce(F.sum(F.when(F.col("nth") > 1, F.col("cost"))), F.lit(0.0)), 2).alias("saved"))


def top_paths(calls: DataFrame, k: int) -> DataFrame:
    """path, cost of the k most expensive call paths; ties by path."""
    return calls.groupBy("path").agg(F.round(F.sum("cost"), 2).alias("cost")).orderBy(F.col("cost").desc(), "path").limit(k)


def call_paths(events: DataFrame, length: int = 3) -> DataFrame:
    """path, cost: each call with the ``length - 1`` calls before it in its session (session, ts, model, cost)."""
    by = Window.partitionBy("session").orderBy("ts")
    steps = [F.lag("model", i).over(by) for i in range(length - 1, 0, -1)]
    return events.select(F.concat_ws(">", *steps, "model").alias("path"), "cost")


def over_time(calls: DataFrame, every: str = "1 day") -> DataFrame:
    """start, model, n, cost by tumbling windows of ts."""
    return calls.groupBy(F.window("ts", every).alias("w"), "model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost")).select(F.col("w.start").alias("start"), "model", "n", "cost")
