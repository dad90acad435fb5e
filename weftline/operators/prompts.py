"""Prompts for retrieval: diverse hits by maximal marginal relevance, and their assembly under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill, n_tokens, tokens
from ..sources.shared import among


def _alike(a: Column, b: Column) -> Column:
    """Shared words over all words of two sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def diverse(hits: DataFrame, corpus: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """query_id, item_id, gain, rank: k hits of each query, each time the one with the most marginal relevance.

    That is ``weight`` times its score, as a share of the query's best, less
    (1 - weight) times its likeness (Jaccard of words) to the most alike of
    those taken before; ties by the first rank. What is gathered of a query is its hits, a
    stated number; likeness is worked out only against the one just taken.
    """
    words = among(corpus.select(F.col("id").alias("item_id"), "text"), hits, "item_id").select("item_id", F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array().cast("array<string>")).alias("words"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    relevant = hits.select("query_id", "item_id", "rank", F.when(best > 0, F.col("score") / best).otherwise(0.0).alias("rel")).join(words, "item_id")
    own = F.struct("rank", "item_id", "rel", "words", F.lit(0.0).alias("near"))
    each = relevant.groupBy("query_id").agg(F.array_sort(F.collect_list(own)).alias("rest"))
    gain = lambda x: F.round(weight * x["rel"] - (1 - weight) * x["near"], 9)

    def take(state: Column, _: Column) -> Column:
        top = F.array_max(F.transform(state["rest"], lambda x: F.struct(gain(x).alias("gain"), (-x["rank"]).alias("minus_rank"), x["item_id"].alias("item_id"), x["words"].alias("words"))))

        def without(t: Column) -> Column:
            left = F.filter(state["rest"], lambda x: x["rank"] != -t["minus_rank"])
            nearer = F.transform(left, lambda x: F.struct(x["rank"].alias("rank"), x["item_id"].alias("item_id"), x["rel"].alias("rel"), x["words"].alias("words"), F.greatest(x["near"], _alike(x["words"], t["words"])).alias("near")))
            return F.struct(nearer.alias("rest"), F.concat(state["taken"], F.array(F.struct(t["item_id"].alias("item_id"), t["gain"].alias("gain")))).alias("taken"))

        return F.when(F.size(state["rest"]) == 0, state).otherwise(F.transform(F.array(top), without)[0])

    none = F.expr("cast(array() as array<struct<item_id:bigint,gain:double>>)")
    taken = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.struct(F.col("rest"), none.alias("taken")), take, lambda s: s["taken"])
    out = each.select("query_id", F.posexplode(taken).alias("at", "t"))
    return out.select("query_id", "t.item_id", "t.gain", (F.col("at") + 1).cast("int").alias("rank"))


def assemble(hits: DataFrame, queries: DataFrame, corpus: DataFrame, template: str, budget: int, constraints: str = "") -> DataFrame:
    """query_id, prompt, n_items, n_tokens of every query (id, text): the template with {context}, {question} and {constraints}.

    The context is the texts of the hits by rank, numbered, up to the first that
    would make the prompt longer than ``budget`` tokens; question and
    constraints always stay. A query without hits has an empty context.
    """
    asked = queries.select(F.col("id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    frame = lambda context: fill(template, {"constraints": F.lit(constraints), "question": F.col("question"), "context": context})
    asked = asked.withColumn("fixed", n_tokens(frame(F.lit(""))))
    texts = hits.join(among(corpus.select(F.col("id").alias("item_id"), "text"), hits, "item_id"), "item_id").select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("part"))
    so_far = F.sum(n_tokens(F.col("part"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = texts.withColumn("so_far", so_far).join(asked, "query_id").where(F.col("fixed") + F.col("so_far") <= budget)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n")
    context = fits.groupBy("query_id").agg(ordered.alias("context"), F.count("*").alias("n_items"))
    out = asked.join(context, "query_id", "left").withColumn("prompt", frame(F.coalesce("context", F.lit(""))))
    return out.select("query_id", "prompt", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), n_tokens(F.col("prompt")).alias("n_tokens"))
