"""Steps whose work must grow with the input only: what they shuffle, and that they stay exact."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.functions.text import upper
from weftline.operators import evaluation, near, quantised, retrieval
from weftline.operators import text as preparation
from weftline.plans import search

TEXT = "id long, text string"


def brute(queries, parts, k):
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    docs = [(i, cut(t)) for i, t in parts]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    out = []
    for q, text in queries:
        best = {}
        for i, w in docs:
            score = 0.0
            for t in set(cut(text)) & set(w):
                df = sum(t in x for _, x in docs)
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                best[i] = max(best.get(i, 0.0), round(score, 6))
        out += [(q, i, s, r) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def same(a, b):
    return [(q, i, r) for q, i, _, r in a] == [(q, i, r) for q, i, _, r in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=2e-6)


@pytest.fixture(scope="module")
def texts():
    rnd = np.random.default_rng(3)
    words = ["the", "of", *(f"w{i}" for i in range(40))]
    make = lambda: " ".join(["the", *rnd.choice(words, rnd.integers(0, 30))])
    return [(i, make()) for i in range(300)] + [(300, None), (301, "")], [(i, make()) for i in range(9)] + [(9, "absent"), (10, None)]


@pytest.mark.parametrize("block", [256, 3])
def test_bm25_by_rows(spark, texts, monkeypatch, block):
    """Ten of ten, in one block of queries and in several; a row of the corpus is a row of postings, however frequent its terms are."""
    docs, queries = texts
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", block)
    q, d = spark.createDataFrame(queries, TEXT), spark.createDataFrame(docs, TEXT).repartition(3)
    got = [tuple(r) for r in retrieval.bm25_topk(q, d, 10).orderBy("query_id", "rank").collect()]
    assert same(got, brute(queries, docs, 10))
    assert retrieval.postings(d, ["the", "of", "w1"]).count() == len(docs)


def test_bm25_of_parts(spark, texts):
    """Parts of an item stand in different tasks; an item has one row, with the score of its best part."""
    docs, queries = texts
    parts = [(i % 50, t) for i, t in docs]
    got = [tuple(r) for r in retrieval.bm25_topk(spark.createDataFrame(queries, TEXT), spark.createDataFrame(parts, TEXT).repartition(5), 10, parts=True).orderBy("query_id", "rank").collect()]
    assert same(got, brute(queries, parts, 10))


def shuffled(df):
    return df._jdf.queryExecution().toString().count("Exchange")


def test_hashed_vectors_stay_in_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "--"), (4, "Éa b")], TEXT)
    vectors = retrieval.hashed_vectors(df)
    assert shuffled(vectors) == 0
    assert {r["id"]: round(sum(x * x for x in r["vector"]), 4) for r in vectors.collect()} == {1: 1.0, 4: 1.0}


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.default_rng(5).normal(size=(700, 8))
    m[100:180] = m[0]  # a large group of copies
    return spark.createDataFrame([(i, m[i].tolist(), int(i % 3)) for i in range(700)], "id long, vector array<double>, label int").repartition(5), m


def nearest(m, k, allowed=lambda q, i: q != i):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    return {(q, i, r) for q in range(0, len(m), 50) for r, i in enumerate(sorted((i for i in range(len(m)) if allowed(q, i)), key=lambda i: (-score[q, i], i))[:k], 1)}


def test_vector_search_in_small_blocks(spark, vectors, monkeypatch):
    """A task holds few scores at a time and still finds the best."""
    df, m = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    own = df.where("id % 50 = 0")
    found = lambda x: {(r["query_id"], r["item_id"], r["rank"]) for r in x.collect()}
    assert found(retrieval.vector_topk(own, df, 7)) == nearest(m, 7)
    assert found(retrieval.vector_topk(own, df, 5, same="label")) == nearest(m, 5, lambda q, i: q != i and q % 3 == i % 3)
    assert found(retrieval.vector_topk(own, df, 1, earlier=True)) == nearest(m, 1, lambda q, i: i < q)


def test_cells_and_codes_are_exact_without_pairs(spark, vectors):
    """Both indexes give the exact neighbours, and their plans join no pairs."""
    df, m = vectors
    own = df.where("id % 50 = 0")
    for index in (retrieval.CellIndex(df, sample=200), quantised.ProductIndex(df, parts=4)):
        got = index.exact_topk(own, 7)
        assert "Join" not in got._jdf.queryExecution().toString()
        assert {(r["query_id"], r["item_id"], r["rank"]) for r in got.collect()} == nearest(m, 7)


def test_best_keeps_few():
    from weftline.operators.best import SCORES, Best

    best = Best([1, 2], 3)
    for a in range(0, 1_000_000, 50_000):
        best.offer_all(np.arange(2), np.arange(a, a + 50_000), np.tile(np.linspace(0, 1, 50_000), (2, 1)))
        assert best.new <= SCORES
    (out,) = best.batches()
    assert out.column("item_id").to_pylist() == [49_999, 99_999, 149_999] * 2


def test_upper_by_characters(spark):
    import duckdb

    texts = ["Straße", "ﬁn ŉ ǰ ᾀ և", "ẞ ÿ ı ǆ", "plain", "", "ßß", None]
    mine = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], TEXT).orderBy("id").select(upper(F.col("text"))).collect()]
    assert mine == [duckdb.execute("SELECT upper(?)", [t]).fetchone()[0] for t in texts]


def test_means_do_not_depend_on_order(spark):
    means = set()
    for values in ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.2, 0.3, 0.1]):
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        means.add(df.agg(evaluation.exact_mean(F.col("v"))).head()[0])
    assert means == {0.6 / 3}
    assert spark.createDataFrame([(None,)], "v double").agg(evaluation.exact_mean(F.col("v"))).head()[0] is None


def test_state_calls_do_not_grow_with_events():
    """A key's rows and its timer cost a fixed number of calls of the state store."""
    import pandas as pd
    from weftline.streaming.sessions import Sessions

    class Value:
        def __init__(self):
            self.value, self.calls = None, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

    class Handle:
        def __init__(self):
            self.values, self.timers = {}, []

        def getValueState(self, name, _):
            return self.values.setdefault(name, Value())

        def listTimers(self):
            return list(self.timers)

        def registerTimer(self, t):
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 900_000

    def calls(n):
        handle, own = Handle(), Sessions(1_000_000)
        own.init(handle)
        rows = pd.DataFrame({"event_id": [*range(n), 0], "at": [i * 2_000_000 for i in [*range(n), 0]], "value": [1.0] * (n + 1)})
        list(own.handleInputRows((7,), iter([rows]), Times()))
        (out,) = own.handleExpiredTimer((7,), Times(), None)
        assert len(out) == min(n, 450) and out["n"].sum() == len(out)
        return sum(v.calls for v in handle.values.values())

    assert calls(400) == calls(4) <= 20


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("block", [1_000_000, 20])
def test_shared_runs(spark, texts, monkeypatch, n, block):
    """Items that hold a run of a query, by a plain search, in one block of queries and in several."""
    monkeypatch.setattr(retrieval, "RUN_WORDS", block)
    docs, queries = texts
    docs = [*docs, *((400 + i, f"w1 {t} w2 {t}") for i, t in queries), (None, queries[0][1]), (500, "é " * 9), (501, "one two É"), (502, "é é")]
    queries = [*queries, (11, "É é " * 5), (11, queries[1][1]), (12, "one two"), (13, queries[0][1])]
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    runs = lambda t: {tuple(cut(t)[i : i + n]) for i in range(len(cut(t)) - n + 1)}
    want = {(q, i) for q, t in queries for i, d in docs if runs(t) & runs(d)}
    got = [tuple(r) for r in retrieval.shared_runs(spark.createDataFrame(queries, TEXT), spark.createDataFrame(docs, TEXT).repartition(3), n).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_judgements_make_no_row_for_a_run(spark, small, monkeypatch):
    plans = []
    monkeypatch.setattr(search, "keep", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    search.judged(spark, small)
    assert len(plans) == 1 and "Generate" not in plans[0]


def alike(texts, percent=80):
    """All pairs of the first texts of equal words, by their sets of runs of five words."""
    sets, seen = {}, set()
    for i, t in sorted(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if w and tuple(w) not in seen:
            seen.add(tuple(w))
            sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))}
    both = {(a, b): (len(x & y), len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b}
    return sorted((a, b, round(o / u, 6)) for (a, b), (o, u) in both.items() if 100 * o >= percent * u)


@pytest.mark.parametrize("sample, common, hot, segment", [(10_000, 1_000_000, 200, 2_000), (10, 7, 200, 2_000), (10, 1_000_000, 2, 3), (10_000, 3, 2, 2_000)])
def test_near_duplicates_however_they_meet(spark, monkeypatch, sample, common, hot, segment):
    """The pairs are those of plain loops, whatever the order comes from, at frequent shingles and in blocks of several segments."""
    rnd = np.random.default_rng(11)
    footer = [f"f{i}" for i in range(30)]
    texts = [None, "", "...", "one two", "One, two!", "one two three four five"]
    for group, copies in enumerate((1, 1, 2, 5, 12)):
        base = [f"g{group}w{i}" for i in range(int(rnd.integers(20, 150)))]
        for _ in range(copies):
            words = list(base)
            for at in rnd.choice(len(words), rnd.integers(0, 4), replace=False):
                words[at] = f"x{rnd.integers(1000)}"
            texts += [" ".join(words), " ".join(words[: -int(rnd.integers(1, 9))]), " ".join(words + footer), " ".join(words)]
    texts += [" ".join([*footer, f"own{i}", f"own{i + 1}"]) for i in range(9)]
    for name, value in (("SAMPLE", sample), ("COMMON", common), ("HOT", hot), ("SEGMENT_TEXTS", segment)):
        monkeypatch.setattr(near, name, value)
    docs = list(zip(rnd.permutation(len(texts)).tolist(), texts, strict=True))
    got = sorted(tuple(r) for r in preparation.near_dup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    want = alike(docs)
    assert len(want) > 60 and got == want


def test_near_duplicates_shuffle_prefixes_only(spark, monkeypatch):
    """What is shuffled is well below the size of the texts, of which few are alike; the sample of a large corpus is a small part."""
    monkeypatch.setattr(near, "SAMPLE", 20)
    rnd = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 100_000, 2_000)) for _ in range(300)]
    texts += [t + " end" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).persist()
    docs.count()
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert preparation.near_dup(docs).count() == 5
    took = written() - before
    docs.unpersist()
    assert 0 < took < 0.8 * sum(map(len, texts))
