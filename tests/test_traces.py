"""Span trees against brute force over all pairs, and the log of streams."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from weftline.operators import traces
from weftline.streaming import flows, monitor

SPAN = "trace_id string, span_id long, start long, end long"


def brute(spans):
    out = {}
    for t in {s[0] for s in spans}:
        own = [s[1:] for s in spans if s[0] == t]
        parent = {}
        for i, a, b in own:
            outer = [(y, -x, -j) for j, x, y in own if j != i and x <= a and y >= b and ((x, y) != (a, b) or j < i)]
            parent[i] = -min(outer)[2] if outer else None
        at = {i: (a, b) for i, a, b in own}
        kids = {i: [j for j in at if parent[j] == i] for i in at}
        chosen = {i for i in at if parent[i] is None}
        for i in at:
            cursor = at[i][1]
            for j in sorted(kids[i], key=lambda j: (-at[j][1], at[j][0], j)):
                if at[j][1] <= cursor:
                    chosen.add(j)
                    cursor = at[j][0]
        for i, (a, b) in at.items():
            chain, j = [], i
            while j is not None:
                chain.append(j)
                j = parent[j]
            free = sum(not any(at[k][0] <= x < at[k][1] for k in kids[i]) for x in range(a, b))
            on = all(k in chosen for k in chain)
            path = b - a - sum(at[k][1] - at[k][0] for k in kids[i] if k in chosen) if on else 0
            out[t, i] = (parent[i], len(chain) - 1, b - a, free, on, path)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    spans = []
    for i in range(240):
        a = rnd.randint(0, 40)
        spans.append((f"t{i % 12}", i, a, a + rnd.choice([0, 1, 2, 5, 10, 30])))
    df = spark.createDataFrame(spans, SPAN)
    got = {(r["trace_id"], r["span_id"]): tuple(r)[2:] for r in traces.span_tree(df.repartition(3)).collect()}
    assert got == brute(spans)
    summary = traces.trace_summary(traces.span_tree(df)).collect()
    for r in summary:
        assert r["duration"] == sum(v[5] for k, v in got.items() if k[0] == r["trace_id"])


def test_deep_wide_and_odd_spans(spark):
    spans = [("deep", i, i, 4000 - i) for i in range(1500)] + [("wide", 0, 0, 10**6), *(("wide", i, i * 10, i * 10 + 10) for i in range(1, 5000))]
    spans += [(None, 1, 0, 5), (None, 2, 1, 2), ("x", 1, None, 5), ("x", 2, 5, 1), ("x", 3, 4, None)]
    tree = traces.span_tree(spark.createDataFrame(spans, SPAN))
    got = {r["trace_id"]: r for r in traces.trace_summary(tree).collect()}
    assert got["deep"]["depth"] == 1499 and got["wide"]["path_spans"] == 5000 and got[None]["n_spans"] == 2 and "x" not in got
    assert traces.span_tree(spark.createDataFrame([], SPAN)).count() == 0


def test_progress_log(spark, tmp_path):
    log = monitor.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        schema = "user_id long, ts timestamp, value double"
        for i in range(2):
            spark.createDataFrame([(i, dt.datetime(2024, 1, 1), 1.0)] * (i + 1), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.subscribe(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files=1).observe("seen", F.count("*").alias("n"))
        flows.run_available(stream, lambda df, _: df.collect(), str(tmp_path / "ck"))

        def broken(df, _):
            raise ValueError("broken on purpose")

        with pytest.raises(Exception, match="broken on purpose"):
            flows.run_available(flows.subscribe(spark, str(tmp_path / "in"), stream.schema), broken, str(tmp_path / "ck2"))
        for _ in range(50):
            if log.failures().count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = [r for r in log.read().orderBy("batch").collect() if r["input_rows"]]
    assert sorted(r["input_rows"] for r in rows) == [1, 2] and {r["observed"]["seen"]["n"] for r in rows} == {"1", "2"}
    assert all(r["batch_ms"] >= 0 for r in rows) and "broken on purpose" in log.failures().first()["error"]
