"""The logistic regression against plain numpy, and its use on labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.operators import learning
from weftline.plans import learned


def optimum(rows, width, l2):
    """The same objective by plain gradient descent over a dense matrix."""
    x = np.zeros((len(rows), width + 1))
    for i, (_, f) in enumerate(rows):
        x[i, f] = 1 / np.sqrt(max(len(f), 1))
        x[i, -1] = 1
    y = np.array([r[0] for r in rows], float)
    w = np.zeros(width + 1)
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(rows) + np.append(w[:-1], 0) * l2
        w -= 2.0 * g
    return w, (np.logaddexp(0, x @ w) - y * (x @ w)).mean() + l2 / 2 * (w[:-1] @ w[:-1])


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(8)
    truth = rnd.normal(size=12)
    rows = []
    for _ in range(300):
        f = sorted(rnd.choice(12, int(rnd.integers(0, 7)), replace=False).tolist())
        rows.append((int(rnd.random() < 1 / (1 + np.exp(-2 * truth[f].sum()))), f))
    return rows, spark.createDataFrame(rows, "y int, features array<int>")


def test_fit_equals_plain_descent(table):
    rows, df = table
    best, loss = optimum(rows, 12, 1e-2)
    fits = [learning.Logistic.fit(df.repartition(n), 12, l2=1e-2) for n in (1, 5)]
    for m in fits:
        assert np.abs(m.weights - best).max() < 1e-3 and abs(m.losses[-1] - loss) < 1e-7
        assert m.losses == sorted(m.losses, reverse=True)
    assert np.abs(fits[0].weights - fits[1].weights).max() < 1e-6


def test_score(spark, table):
    m = learning.Logistic(np.array([1.0, -2.0, 0.5]))
    got = m.score(spark.createDataFrame([(1, [0]), (2, [0, 1]), (3, []), (4, None)], "id int, features array<int>")).orderBy("id").collect()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert [r["score"] for r in got] == pytest.approx([sigmoid(1.5), sigmoid(0.5 - 1 / np.sqrt(2)), sigmoid(0.5), sigmoid(0.5)])


def test_threshold_by_every_cut(spark):
    rnd = np.random.default_rng(9)
    rows = [(int(rnd.random() < s), float(s)) for s in rnd.integers(0, 40, 200) / 40]
    cut = learning.best_threshold(spark.createDataFrame(rows, "y int, score double"))

    def f1(t):
        tp = sum(y for y, s in rows if s >= t)
        return 2 * tp / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows))

    assert f1(cut) == max(f1(t) for t in {s for _, s in rows})
    assert learning.best_threshold(spark.createDataFrame([(0, 0.2)], "y int, score double")) == 0.5
    assert learning.best_threshold(spark.createDataFrame([], "y int, score double")) == 0.5


def test_no_rows(spark):
    assert not learning.Logistic.fit(spark.createDataFrame([], "y int, features array<int>"), 8).weights.any()


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A a!! " * 20_000), (4, "é")], "doc_id long, text string")
    out = learning.judge(docs, learning.Logistic(np.zeros(65)), 0.5, True).collect()
    assert [(r["score"], r["flagged"]) for r in out] == [(0.5, True)] * 4
    got = docs.select(learning.hashed_terms(F.col("text"), 64).alias("f")).collect()
    assert [len(r["f"]) for r in got] == [0, 0, 2, 1]


def test_models_beat_the_rules_on_rows_they_have_not_seen(spark):
    for q in (learned.moderation_trained, learned.quality_trained):
        f1 = {r["method"]: r["f1"] for r in q(spark, "/root/testdata/sf0.1").collect()}
        assert f1["trained"] > f1["rules"]
