"""Training data: pairs, splits, pipelines, versions and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_share
from .text import exact_dedup, with_reasons


def sft_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, turn, instruction, input, output of each user message that an assistant's follows at once."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    both = messages.withColumns({"next_role": F.lead("role").over(by), "output": F.lead("text").over(by)})
    return both.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), F.lit("").alias("input"), "output")


def preference_pairs(scored: DataFrame) -> DataFrame:
    """prompt, chosen, rejected: best and worst answer (answer, score) of each prompt; equal scores give none. Ties by answer."""
    best, worst = F.max(F.struct("score", "answer")), F.min(F.struct("score", "answer"))
    return scored.groupBy("prompt").agg(best.alias("b"), worst.alias("w")).where("b.score > w.score").select("prompt", F.col("b.answer").alias("chosen"), F.col("w.answer").alias("rejected"))


def hash_split(docs: DataFrame, key: str, percent: int) -> DataFrame:
    """docs with split 'test' for about ``percent`` of the keys, by a hash of the key alone."""
    return docs.withColumn("split", F.when(hash_share(F.col(key)) % 100 < percent, "test").otherwise("train"))


def prepare(docs: DataFrame) -> dict[str, DataFrame]:
    """The stages collected, deduplicated and kept, each from the one before."""
    unique = exact_dedup(docs)
    return {"collected": docs, "deduplicated": unique, "kept": with_reasons(unique).where("reason is null").drop("reason")}


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n of every stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def retrain(log: DataFrame, least_rows: int, most_drop: float) -> DataFrame:
    """version, rows, score, due of a log (version, rows, score): due when enough rows came in or the score fell against the version before."""
    before = F.lag("score").over(Window.orderBy("version"))  # a row for each version that was ever trained: a small log
    drop = F.coalesce(before - F.col("score"), F.lit(0.0))
    return log.withColumn("due", (F.col("rows") >= least_rows) | (drop > most_drop))


def stratified_sample(docs: DataFrame, key: str, stratum: str, percents: dict[str, int], default: int = 0) -> DataFrame:
    """About the given per cent of each stratum's rows, by a hash of the key alone; strata without a share get the default."""
    share = F.lit(default)
    for value, percent in sorted(percents.items()):
        share = F.when(F.col(stratum) == value, percent).otherwise(share)
    return docs.where(hash_share(F.col(key)) % 100 < share)


def minibatches(docs: DataFrame, key: str, size: int, groups: int = 64) -> DataFrame:
    """docs with batch_group and batch: rows in hash order, ``size`` to a batch within each of ``groups`` groups, so that no task orders all rows."""
    group = F.pmod(hash_share(F.col(key)), F.lit(groups)).cast("int")
    nth = F.row_number().over(Window.partitionBy("batch_group").orderBy("_h", key))
    return docs.withColumns({"batch_group": group, "_h": F.md5(F.col(key).cast("string").cast("binary"))}).withColumn("batch", F.floor((nth - 1) / F.lit(size)).cast("int")).drop("_h")


def experiments(log: DataFrame) -> DataFrame:
    """run, step, loss, best_so_far, smoothed of a loss log (run, step, loss); smoothed over the last three steps."""
    by = Window.partitionBy("run").orderBy("step")
    return log.withColumns({"best_so_far": F.min("loss").over(by.rowsBetween(Window.unboundedPreceding, 0)), "smoothed": F.round(F.avg("loss").over(by.rowsBetween(-2, 0)), 6)})
