"""Evaluation metrics: retrieval, answers, runs, comparisons and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def retrieval_metrics(hits: DataFrame, judged: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, rr, ndcg at k for all queries (query_id).

    judged: query_id, item_id, rel. Without relevant items recall and ndcg are
    null, precision and rr are 0. Precision divides by k.
    """
    good = judged.where("rel > 0").groupBy("query_id", "item_id").agg(F.max("rel").cast("double").alias("rel"))
    ideal = good.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "item_id")))
    total = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + F.lit(1.0)))).alias("idcg"))
    own = hits.where(F.col("rank") <= k).join(good, ["query_id", "item_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    every = queries.select("query_id").distinct().join(total, "query_id", "left").join(own, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return every.select(
        "query_id",
        F.round(found / F.col("n_rel"), 6).alias("recall"),
        F.round(found / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(F.col("n_rel").isNotNull(), F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), 6).alias("ndcg"),
    )


def answer_similarity(pairs: DataFrame) -> DataFrame:
    """case_id, exact, f1, edit for (case_id, answer, expected): equality after trimming, token F1 on distinct tokens, Levenshtein distance."""
    a, e = F.array_distinct(tokens(F.col("answer"))), F.array_distinct(tokens(F.col("expected")))
    both = F.size(F.array_intersect(a, e)).cast("double")
    return pairs.select("case_id", (F.trim("answer") == F.trim("expected")).alias("exact"), F.round(F.coalesce(F.try_divide(2 * both, F.size(a) + F.size(e)), F.lit(0.0)), 6).alias("f1"), F.levenshtein("answer", "expected").alias("edit"))


def common_subsequence(a: list, b: list) -> int:
    """The length of the longest common subsequence.

    A row of the usual table is the bits of one whole number: a bit is 0 where
    the row grows. A step over a word of ``a`` is an addition, so the work is
    that of len(a) additions of len(b) bits.
    """
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def sequence_similarity(pairs: DataFrame) -> DataFrame:
    """case_id, n_answer, n_expected, common, precision, recall, f1 of (case_id, answer, expected): the words of their longest common subsequence, and its shares.

    Words are lower-cased; a null text has none. Shares of no words are null, f1
    is 0 if nothing is common and null without any words. Pairs go through
    Python in Arrow batches.
    """

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    words = lambda c: F.coalesce(tokens(F.col(c)), F.array().cast("array<string>"))
    out = pairs.select("case_id", words("answer").alias("a"), words("expected").alias("e"))
    out = out.select("case_id", F.size("a").cast("long").alias("n_answer"), F.size("e").cast("long").alias("n_expected"), common("a", "e").alias("common"))
    share = lambda n, of: F.round(F.try_divide(n.cast("double"), of), 6)
    c = F.col("common")
    return out.select("*", share(c, F.col("n_answer")).alias("precision"), share(c, F.col("n_expected")).alias("recall"), share(2 * c, F.col("n_answer") + F.col("n_expected")).alias("f1"))


def summary(results: DataFrame) -> DataFrame:
    """metric, n, mean, low, high of long results (metric, value)."""
    return results.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def report(results: DataFrame, metrics: list[str]) -> DataFrame:
    """run_id and a column with the mean of each metric; fixed names spare a pass to find them."""
    return results.groupBy("run_id").pivot("metric", metrics).agg(F.round(F.avg("value"), 6))


def run_summary(runs: DataFrame, group: str) -> DataFrame:
    """group, n, success_rate, avg_steps, p50, p95 of runs (ok, steps, latency); exact percentiles."""
    return runs.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("ok").cast("int")), 6).alias("success_rate"),
        F.round(F.avg("steps"), 6).alias("avg_steps"),
        F.round(F.percentile("latency", 0.5), 6).alias("p50"),
        F.round(F.percentile("latency", 0.95), 6).alias("p95"),
    )


def completion(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """task, completion_rate, step_efficiency, tool_accuracy of runs (task, ok, steps, tool) against (task, best_steps, right_tool)."""
    both = runs.join(expected, "task")
    return both.groupBy("task").agg(
        F.round(F.avg(F.col("ok").cast("int")), 6).alias("completion_rate"),
        F.round(F.avg(F.least(F.col("best_steps") / F.col("steps"), F.lit(1.0))), 6).alias("step_efficiency"),
        F.round(F.avg((F.col("tool") == F.col("right_tool")).cast("int")), 6).alias("tool_accuracy"),
    )


def format_compliance(rows: DataFrame, column: str, required: list[str]) -> DataFrame:
    """rows with valid (JSON) and complete (all required top-level keys are there)."""
    value = F.try_parse_json(column)
    has = [F.try_variant_get(value, f"$.{k}", "string").isNotNull() for k in required]
    complete = value.isNotNull()
    for h in has:
        complete = complete & h
    return rows.withColumns({"valid": value.isNotNull(), "complete": complete})


def dual_scores(a: DataFrame, b: DataFrame, key: str, cut: float) -> DataFrame:
    """One row: n, agreement (both on one side of the cut) and correlation of two score tables (key, score)."""
    both = a.select(key, F.col("score").alias("x")).join(b.select(key, F.col("score").alias("y")), key)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(((F.col("x") >= cut) == (F.col("y") >= cut)).cast("int")), 6).alias("agreement"), F.round(F.corr("x", "y"), 6).alias("correlation"))


def exact_mean(value: Column) -> Column:
    """The mean of numbers of up to ten decimals, from their exact sum, so that it doesn't depend on the order in which tasks add."""
    return F.sum(value.cast("decimal(28,10)")).cast("double") / F.count(value)


def compare_runs(before: DataFrame, after: DataFrame, margin: float = 0.0) -> DataFrame:
    """metric, n, delta, win, tie, loss of two runs (case_id, metric, value)."""
    d = F.col("b") - F.col("a")
    both = before.select("case_id", "metric", F.col("value").alias("a")).join(after.select("case_id", "metric", F.col("value").alias("b")), ["case_id", "metric"])
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("delta"), F.count_if(d > margin).alias("win"), F.count_if(F.abs(d) <= margin).alias("tie"), F.count_if(d < -margin).alias("loss"))


def worst(results: DataFrame, k: int, by: str = "metric") -> DataFrame:
    """The k lowest values of each group, ties by case."""
    order = Window.partitionBy(by).orderBy(F.col("value").asc_nulls_first(), "case_id")
    return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def slices(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and count over every combination of the keys, with its grouping_id."""
    return results.cube(*keys).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def alerts(results: DataFrame, group: str, condition: Column, least: float) -> DataFrame:
    """group, n, rate where the share of rows that meet the condition is below ``least``."""
    return results.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(condition.cast("int")), 6).alias("rate")).where(F.col("rate") < least)


def over_time(metrics: DataFrame, every: str, columns: list[str]) -> DataFrame:
    """start, n and the mean of each metric column by tumbling windows of ts: how retrieval does over time."""
    return metrics.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 5).alias(c) for c in columns)).select(F.col("w.start").alias("start"), "n", *columns)


def report_lines(results: DataFrame, title: str) -> DataFrame:
    """line_no, line of a Markdown report: a heading, and a table with a row for each metric of long results (metric, value)."""
    spark = results.sparkSession
    head = spark.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| metric | n | mean | low | high |"), (3, "|---|---|---|---|---|")], "line_no int, line string")
    show = lambda c: F.format_string("%.2f", F.col(c))
    rows = summary(results).withColumn("line_no", (F.row_number().over(Window.orderBy("metric")) + 3).cast("int"))  # a row for each metric
    return head.unionByName(rows.select("line_no", F.concat_ws(" ", F.lit("|"), "metric", F.lit("|"), F.col("n").cast("string"), F.lit("|"), show("mean"), F.lit("|"), show("low"), F.lit("|"), show("high"), F.lit("|")).alias("line")))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what an action on it will have counted on the way, without a pass of its own."""
    watch = Observation(name)
    return df.observe(watch, *(c.alias(k) for k, c in metrics.items())), watch
