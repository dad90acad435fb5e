"""Sketches, significance and prompts against exact values and plain loops."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from weftline.operators import prompts, significance, sketches

TEXT = "id long, text string"


def test_merged_sketches_stay_in_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.xxhash64("id") % 9000).alias("user"), F.log(F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(10**6)) + 1.0).alias("value"))
    parts = sketches.build(rows.repartition(5), ["day"], "user", "value")
    one = sketches.estimates(sketches.merge(parts.withColumn("all", F.lit(1)), ["all"]), {"p50": 0.5, "p99": 0.99}).first()
    exact = rows.agg(F.count_distinct("user").alias("users")).first()["users"]
    assert one["n"] == 60_000 and abs(one["n_distinct"] - exact) <= 4 * 1.04 / 64 * exact
    for q, name in ((0.5, "p50"), (0.99, "p99")):
        rank = rows.agg(F.avg((F.col("value") <= one[name]).cast("int"))).first()[0]
        assert abs(rank - q) <= 3 * sketches.RANK_ERROR
    assert max(len(r["users"]) + len(r["values"]) for r in parts.collect()) < 12_000
    empty = sketches.estimates(sketches.build(spark.createDataFrame([(1, None, None)], "day int, user string, value double"), ["day"], "user", "value"), {"p50": 0.5}).first()
    assert (empty["n"], empty["n_distinct"], empty["p50"]) == (1, 0, None)


def test_poisson_cuts():
    share = np.diff([0, *significance.poisson_cuts(), 2**32]) / 2**32
    assert abs(sum(k * s for k, s in enumerate(share)) - 1) < 1e-5 and abs(share[0] - np.exp(-1)) < 1e-6


def test_bootstrap_by_loops(spark):
    rnd = random.Random(3)
    a = [(i, m, rnd.random()) for i in range(60) for m in ("x", "y")]
    b = [(i, m, v + (0.3 if m == "x" else rnd.gauss(0, 0.2))) for i, m, v in a if i != 5] + [(99, "x", 1.0)]
    schema = "case_id long, metric string, value double"
    got = {r["metric"]: r for r in significance.bootstrap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema).repartition(3), 50).collect()}
    for m in ("x", "y"):
        old = {i: v for i, k, v in a if k == m}
        d = {i: v - old[i] for i, k, v in b if k == m and i in old}
        means = []
        for r in range(1, 51):
            w = {i: sum(int(hashlib.md5(f"{i}:{r}".encode()).hexdigest()[:8], 16) >= c for c in significance.poisson_cuts()) for i in d}
            means.append(round(sum(d[i] * w[i] for i in d) / sum(w.values()), 9))
        assert got[m]["n"] == 59 and abs(got[m]["delta"] - np.mean(list(d.values()))) < 1e-6
        assert abs(got[m]["low"] - np.quantile(means, 0.025)) < 2e-6 and abs(got[m]["high"] - np.quantile(means, 0.975)) < 2e-6
        assert abs(got[m]["better"] - np.mean(np.array(means) > 0)) < 1e-6
    assert got["x"]["low"] > 0.29 and got["x"]["better"] == 1.0


def test_diverse_hits_by_loops(spark):
    rnd = random.Random(4)
    corpus = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6)))) for i in range(30)] + [(90, None)]
    hits = [(q, i, round(rnd.random() * 5, 3)) for q in range(4) for i in rnd.sample(range(30), 9)] + [(7, 90, 0.0)]
    ranked = [(q, i, s, 1 + sum(t > s for p, _, t in hits if p == q)) for q, i, s in hits]
    out = prompts.diverse(spark.createDataFrame(ranked, "query_id long, item_id long, score double, rank int"), spark.createDataFrame(corpus, TEXT), 4, 0.6).collect()
    words = {i: set((t or "").split()) for i, t in corpus}
    for q in (0, 1, 2, 3, 7):
        left, taken = {i: (s, r) for p, i, s, r in ranked if p == q}, []
        best = max(s for s, _ in left.values())
        while left and len(taken) < 4:
            near = lambda i: max((len(words[i] & words[j]) / max(len(words[i] | words[j]), 1) for j in taken), default=0.0)  # noqa: B023, E731
            i = max(left, key=lambda i: (round(0.6 * (left[i][0] / best if best else 0) - 0.4 * near(i), 9), -left[i][1]))  # noqa: B023
            taken.append(i)
            del left[i]
        assert [r["item_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == taken


def test_prompts_keep_to_the_budget(spark):
    corpus = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], TEXT)
    queries = spark.createDataFrame([(7, "why not"), (8, None)], TEXT)
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query_id long, item_id long, rank int")
    got = {r["query_id"]: r for r in prompts.assemble(hits, queries, corpus, "{constraints} C: {context} Q: {question}", 10, "Short.").collect()}
    assert got[7]["prompt"] == "Short. C: [1] one two three Q: why not" and got[7]["n_items"] == 1 and got[7]["n_tokens"] == 9
    assert got[8]["prompt"] == "Short. C:  Q: " and got[8]["n_items"] == 0
