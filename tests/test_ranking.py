"""Proximity and phrases against brute force over all spans."""

import random
import re

import numpy as np
import pytest
from weftline.operators import proximity, quantised
from weftline.plans import ranking, search

WORD = re.compile(r"[^\W_]+")
TEXT = "id long, text string"


def words(text):
    return WORD.findall((text or "").lower())


def brute_span(w, terms):
    """The smallest run of words with all the terms, by every pair of ends."""
    found = terms & set(w)
    spans = [j - i + 1 for i in range(len(w)) for j in range(i, len(w)) if found <= set(w[i : j + 1])]
    return len(found), min(spans) if found else None


def test_spans_equal_brute_force(spark):
    rnd = random.Random(4)
    corpus = [(i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 25)))) for i in range(40)] + [(90, None), (91, ""), (92, "a " * 300 + "b")]
    queries = [(i, " ".join(rnd.choice("abcdexyz") for _ in range(rnd.randint(1, 6)))) for i in range(8)] + [(50, None), (51, "zzz")]
    hits = [(q, i, 1.0) for q, _ in queries for i, _ in corpus]
    frames = [spark.createDataFrame(hits, "query_id long, item_id long, score double"), *(spark.createDataFrame(x, TEXT) for x in (queries, corpus))]
    got = {(r["query_id"], r["item_id"]): (r["n_terms"], r["n_found"], r["span"]) for r in proximity.proximity(*frames).collect()}
    expected = {}
    for q, t in queries:
        terms = set(words(t))
        for i, x in corpus:
            n, span = brute_span(words(x), terms)
            if n:
                expected[q, i] = (len(terms), n, span)
    assert got == expected


def test_rerank_prefers_words_that_stand_together(spark):
    corpus = spark.createDataFrame([(1, "red one two three fish"), (2, "a red fish here"), (3, "red only"), (4, "none of it"), (5, "fish red")], TEXT)
    queries = spark.createDataFrame([(9, "Red fish red"), (8, "absent")], TEXT)
    hits = spark.createDataFrame([(9, i, 5.0 - i) for i in (1, 2, 3, 4, 5)] + [(8, 1, 1.0)], "query_id long, item_id long, score double")
    out = proximity.proximity_rerank(hits, queries, corpus, 4)
    assert [(r["item_id"], r["span"], r["score"]) for r in out.where("query_id = 9").orderBy("rank").collect()] == [(2, 2, 1.0), (5, 2, 1.0), (1, 5, 0.7), (3, 1, 0.5)]
    assert [(r["n_found"], r["span"], r["score"]) for r in out.where("query_id = 8").collect()] == [(0, None, 0.0)]
    assert proximity.proximity_rerank(hits.limit(0), queries, corpus).count() == 0


def test_positional_postings(spark):
    got = {(r["term"], r["item_id"]): (r["n"], r["positions"]) for r in proximity.positional_postings(spark.createDataFrame([(1, "b a B"), (2, None)], TEXT)).collect()}
    assert got == {("a", 1): (1, [1]), ("b", 1): (2, [0, 2])}


def test_phrases_equal_brute_force(spark):
    rnd = random.Random(5)
    corpus = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 20)))) for i in range(30)] + [(90, None)]
    phrases = [(0, "a b"), (1, "a a"), (2, "c"), (3, "a b a c"), (4, ""), (5, None), (6, "a x")]
    frames = [spark.createDataFrame(x, TEXT) for x in (phrases, corpus)]

    def runs(w, p, slop):
        n = 0
        for s in range(len(w)):
            if w[s] != p[0]:
                continue
            ends = {s}
            for x in p[1:]:
                ends = {e for f in ends for e in range(f + 1, min(len(w), f + 2 + slop)) if w[e] == x}
            n += bool(ends)
        return n

    got = {(r["query_id"], r["item_id"]): r["n"] for r in proximity.phrase_hits(*frames).collect()}
    assert got == {(q, i): n for q, p in phrases for i, t in corpus if words(p) and (n := runs(words(t), words(p), 0))}
    near = {(r["query_id"], r["item_id"]) for r in proximity.phrase_hits(*frames, slop=2).where("query_id < 2").collect()}
    assert near == {(q, i) for q, p in phrases[:2] for i, t in corpus if runs(words(t), words(p), 2)}


VECTORS = "id long, vector array<double>"


def nearest(vectors, k):
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    out = {}
    for q in units:
        best = sorted(((-round(float(units[q] @ u), 6), i) for i, u in units.items() if i != q))[:k]
        out[q] = [i for _, i in best]
    return out


def test_codes_of_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(quantised, "QUERY_BLOCK", 40)
    rnd = np.random.default_rng(6)
    vectors = [(i, (rnd.normal(size=16) * (1 + i % 3)).tolist()) for i in range(1500)]
    odd = [(9001, [0.0] * 16), (9002, None), (9003, [1.0] * 15 + [None]), (9004, [])]
    df = spark.createDataFrame(vectors + odd, VECTORS).repartition(3)
    index = quantised.ProductIndex(df, parts=8)
    assert all(len(r["codes"]) == 8 for r in index.rows.collect()) and index.rows.count() == 1500
    # a score by code is off by the error at most
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    for r in index.rows.limit(50).collect():
        made = quantised._decode(np.frombuffer(r["codes"], np.uint8)[None], index.centres)[0]
        assert np.linalg.norm(unit[r["id"]] - made) <= r["error"]
    queries, truth = df.where("id % 15 = 0"), nearest(vectors, 10)
    got = {}
    for r in index.exact_topk(queries).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {i: truth[i] for i, _ in vectors if i % 15 == 0}
    found = index.topk(queries).collect()
    assert sum(r["item_id"] in truth[r["query_id"]] for r in found) >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, folder):
    truth = {(r["query_id"], r["item_id"]) for r in search.vector_topk(spark, folder).collect()}
    assert sum((r["query_id"], r["item_id"]) in truth for r in ranking.pq_topk(spark, folder).collect()) >= 0.9 * len(truth)


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VECTORS)
    index = quantised.ProductIndex(df, parts=2)
    assert [(r["query_id"], r["item_id"]) for r in index.topk(df.where("id = 1")).collect()] == [(1, 2)]
    assert quantised.ProductIndex(df.limit(0), parts=2).topk(df).count() == 0
    with pytest.raises(ValueError):
        quantised.ProductIndex(df, parts=3)
