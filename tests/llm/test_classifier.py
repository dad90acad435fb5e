"""The quality classifier: gradients and updates against plain loops, layout independence, held-out accuracy, odd inputs."""

import binascii
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from weftline.llm import classifier, queries

SCHEMA = "doc_id long, text string, lang string, source string, quality int, score string, y int"


def bags(texts):
    out = [{} for _ in texts]
    for a, _, data, off in classifier.chunks(pa.array(texts, pa.string()), 40):
        for doc, f, v in zip(*classifier.features(data, off), strict=True):
            out[a + doc][int(f)] = out[a + doc].get(int(f), 0) + float(v)
    return out


def test_a_text_has_the_same_features_wherever_it_stands():
    texts = ["One two two THREE!!", "", "x", "é ö ü 12,5", "a a a a b"]
    alone = [bags([t])[0] for t in texts]
    together = bags([*texts[::-1], None, *texts])
    assert together[6:] == alone and together[4::-1] == alone and together[5] == {}
    assert alone[1] == {} and len(alone[2]) == 2
    # three views of one word each have length 1
    assert math.isclose(sum(v * v for v in alone[2].values()), 2)


def test_shapes_meet_across_words():
    a, b = bags(["HELLO!!", "WORLD!!!"])
    assert len(a.keys() & b.keys()) == 1


def plain_ftrl(rows, steps):
    """The same updates by loops over dictionaries; steps holds the rows of each."""
    z, n = {}, {}

    def weight(f):
        l1 = 0 if f == "constant" else classifier.L1
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((classifier.BETA + math.sqrt(n.get(f, 0.0))) / classifier.ALPHA + classifier.L2)

    for step in steps:
        if not step:
            continue
        g = {}
        for i in step:
            bag, y = rows[i]
            p = 1 / (1 + math.exp(-(sum(weight(f) * v for f, v in bag.items()) + weight("constant"))))
            for f, v in [*bag.items(), ("constant", 1.0)]:
                g[f] = g.get(f, 0.0) + (p - y) * v / len(step)
        w = {f: weight(f) for f in g}
        for f, x in g.items():
            more = n.get(f, 0.0) + x * x
            z[f] = z.get(f, 0.0) + x - (math.sqrt(more) - math.sqrt(n.get(f, 0.0))) / classifier.ALPHA * w[f]
            n[f] = more
    return weight


def test_training_equals_plain_updates(spark):
    rnd = np.random.default_rng(3)
    texts = [" ".join(rnd.choice(["good", "fine", "BAD!!", "spam$$$", "of", "the"], 12)) for _ in range(60)]
    ys = [int("BAD!!" not in t) for t in texts]
    df = spark.createDataFrame(list(zip(texts, ys, strict=True)), "text string, y int")
    weights = classifier.train(df.repartition(3))
    step = [r[0] for r in df.select(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(classifier.STEPS))).collect()]
    rows = list(zip(bags(texts), ys, strict=True))
    weight = plain_ftrl(rows, [[i for i, s in enumerate(step) if s == k] for k in range(classifier.STEPS)] * classifier.PASSES)
    assert math.isclose(weights[-1], weight("constant"), rel_tol=1e-3, abs_tol=1e-4)
    seen = {f for bag, _ in rows for f in bag}
    assert max(abs(weights[f] - weight(f)) for f in seen) < 2e-3
    assert np.count_nonzero(weights[:-1]) <= len(seen)


def test_layout_does_not_matter(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.labelled(docs, labels)
    assert (classifier.train(rows.repartition(1)) == classifier.train(rows.repartition(7))).all()


def test_op11_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op11_quality_classifier(spark, folder)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in known)
    held = [r for r in known if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert {r["quality"] for r in held} == {0, 1}


def test_labels_of_the_held_out_fold_change_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(classifier.classify(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    rows = [(i, "fine words here and there" if i % 2 else "BUY!! NOW!! NOW!!", "en", "s", i % 2, "x", 0) for i in range(80)]
    rows += [(None, "fine words", None, None, 1, "x", 0), (3, None, "en", "s", 1, "x", 0), (3, "", "en", "s", 1, "x", 0), (90, "w " * 200_000, "en", "s", 1, "x", 0), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([*((r[0], r[4], 9) for r in rows), (1, None, 9), (1, 7, 9), (None, 1, 9), (4, 0, 9), (4, 0, 9)], "doc_id long, quality int, text int")
    out = classifier.classify(docs.repartition(3), labels).collect()
    assert len(out) == len(rows) and all(0 < r["score"] < 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 2
    good = {r["doc_id"]: r["predicted"] for r in out if r["doc_id"] not in (None, 3, 90)}
    assert all(p == i % 2 for i, p in good.items())


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 2 and all(r["score"] >= 0.5 for r in out)
    assert labels or all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    assert classifier.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
