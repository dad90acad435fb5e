"""Positional postings and reranking by proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import among

def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, term_no (from 0, by first place in the query), n_terms of (id, text); a term counts once."""
    terms = queries.select(F.col("id").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("t"))
    return terms.select("query_id", F.size("t").alias("n_terms"), F.posexplode("t").alias("term_no", "term"))


def positional_postings(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, item_id, n and positions (from 0, ascending) of every term of (id, text), or of those among terms (term).

    A posting is of one term in one item, so a term that stands in every item is
    as many rows, and a join by (item_id, term) deals them out by item.
    """
    each = corpus.select(F.col("id").alias("item_id"), F.posexplode(tokens(F.col("text"))).alias("at", "term"))
    if terms is not None:
        each = among(each, terms, "term")
    return each.groupBy("term", "item_id").agg(F.sort_array(F.collect_list("at")).alias("positions")).select("term", "item_id", F.size("positions").alias("n"), "positions")


def smallest_span(places: Column, n: Column) -> Column:
    """Words in the smallest span that holds all n terms, of an array of structs (at, term_no) sorted by at; term_no counts from 0 to n - 1.

    A fold keeps the last place of each term: a span that ends at a place begins
    at the least of them. Null if a term is missing or there is none.
    """
    none = F.lit(None).cast("int")
    start = F.struct(F.transform(F.sequence(F.lit(1), n), lambda _: none).alias("last"), none.alias("span"))

    def step(state: Column, place: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == place["term_no"], place["at"]).otherwise(x))
        # bound to a name by transform(), so that it is worked out once
        return F.transform(F.array(last), lambda own: F.struct(own.alias("last"), F.when(F.exists(own, lambda x: x.isNull()), state["span"]).otherwise(F.least(state["span"], place["at"] - F.array_min(own) + 1)).alias("span")))[0]

    return F.when(n > 0, F.aggregate(places, start, step, lambda state: state["span"]))


def proximity(hits: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, item_id, n_terms, n_found, span, closeness of every hit whose item holds a term of its query.

    n_found counts the query's distinct terms in the item, span is the smallest
    run of words that holds these, and closeness n_found / span, 1 where they
    stand side by side. Only items that are hit are cut into words.
    """
    terms = query_terms(queries)
    wanted = hits.select("query_id", "item_id").distinct()
    post = positional_postings(among(corpus.withColumn("item_id", F.col("id")), wanted, "item_id").select("id", "text"), terms)
    asked = wanted.join(terms, "query_id")
    found = asked.join(post, ["item_id", "term"]).select("query_id", "item_id", "n_terms", "term_no", "positions")
    own = F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("term_no")) - 1  # terms that the item lacks leave no gap
    placed = found.withColumn("no", own).withColumn("p", F.transform("positions", lambda at: F.struct(at.alias("at"), F.col("no").alias("term_no"))))
    both = placed.groupBy("query_id", "item_id", "n_terms").agg(F.count("*").cast("int").alias("n_found"), F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    out = both.withColumn("span", smallest_span(F.col("p"), F.col("n_found")))
    return out.select("query_id", "item_id", "n_terms", "n_found", "span", F.round(F.col("n_found") / F.col("span").cast("double"), 6).alias("closeness"))


def proximity_rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """query_id, item_id, n_found, span, score, rank: the k best hits by coverage and closeness.

    score = coverage * (1 - weight + weight * closeness), coverage being the
    share of the query's terms in the item; ties by the first score, then by
    item. Hits without a term of the query score 0 and have no span.
    """
    near = hits.select("query_id", "item_id", F.col("score").alias("first")).join(proximity(hits, queries, corpus), ["query_id", "item_id"], "left")
    score = F.col("n_found") / F.col("n_terms").cast("double") * (1 - weight + weight * F.col("closeness"))
    near = near.withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 6))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first").desc(), "item_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "item_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), "span", "score", F.col("rank").cast("int").alias("rank"))


def phrase_hits(phrases: DataFrame, corpus: DataFrame, slop: int = 0) -> DataFrame:
    """query_id, item_id, n: how often the words of a phrase (id, text) stand in an item in their order, with at most ``slop`` words more between any two.

    By positional postings: the places of the first word that has all others
    behind it. A phrase may repeat a word. Join keys hold the item, so a word of
    every item is no hot key.
    """
    words = phrases.select(F.col("id").alias("query_id"), tokens(F.col("text")).alias("t")).where("size(t) > 0")
    each = words.select("query_id", F.size("t").alias("n_words"), F.posexplode("t").alias("no", "term"))
    post = positional_postings(corpus, each)
    # items with every word
    found = each.join(post, "term").select("query_id", "n_words", "item_id", "no", "positions")
    whole = found.groupBy("query_id", "item_id", "n_words").agg(F.sort_array(F.collect_list(F.struct("no", "positions"))).alias("w")).where("size(w) = n_words")

    def behind(reach: Column, word: Column) -> Column:
        """Starts and ends of the runs that go on with the next word; a start keeps every end, as a near one may lead nowhere."""
        ahead = lambda r: F.filter(word["positions"], lambda p: F.exists(r["ends"], lambda e: (p > e) & (p <= e + 1 + slop)))
        return F.filter(F.transform(reach, lambda r: F.struct(r["start"].alias("start"), ahead(r).alias("ends"))), lambda r: F.size(r["ends"]) > 0)

    rest, places = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))), F.col("w")[0]["positions"]
    if slop == 0:  # each word says where the phrase would begin; hashed intersections keep the starts that all agree on
        runs = F.aggregate(rest, places, lambda starts, word: F.array_intersect(starts, F.transform(word["positions"], lambda p: p - word["no"])))
    else:
        runs = F.aggregate(rest, F.transform(places, lambda p: F.struct(p.alias("start"), F.array(p).alias("ends"))), behind)
    return whole.select("query_id", "item_id", F.size(runs).cast("long").alias("n")).where("n > 0")
