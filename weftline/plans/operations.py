"""Upkeep of indexes and what runs over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import upper
from ..operators import significance, sketches, traces
from ..sources.manifest import BucketIndex
from ..sources.shared import shared_folder
from ..sources.tables import table
from ..streaming import flows, sessions
from .registry import query

BUCKETS = 256


def _merged(spark, folder):
    """An index of all documents, and then one of every hundred of them changed, gone or new."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"), "text")
    index = BucketIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=BUCKETS)
    index.merge(docs.where("id % 100 != 3"))
    late = docs.where("id % 100 in (1, 2, 3)").withColumns({"hash": F.when(F.col("id") % 100 == 1, F.md5(upper(F.col("text")))).otherwise(F.col("hash")), "gone": F.col("id") % 100 == 2})
    index.merge(late, deleted="gone")
    return index


_AFTER = "SELECT doc_id AS id, md5(CASE WHEN doc_id % 100 = 1 THEN upper(text) ELSE text END) AS hash FROM documents WHERE doc_id % 100 <> 2"


@query(_AFTER)
def index_merge(spark, folder):
    """An index in buckets after a change."""
    return _merged(spark, folder).read().select("id", "hash")


@query(f"""WITH h AS (SELECT doc_id, concat('0x', substring(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % {BUCKETS} AS b FROM documents),
t AS (SELECT DISTINCT b FROM h JOIN documents d USING (doc_id) WHERE doc_id % 100 IN (2, 3) OR doc_id % 100 = 1 AND upper(text) <> text)
SELECT CAST(h.b AS INTEGER) AS bucket, CASE WHEN t.b IS NULL THEN 1 ELSE 2 END AS since FROM h LEFT JOIN t ON t.b = h.b WHERE doc_id % 100 <> 2 GROUP BY ALL""")
def index_buckets(spark, folder):
    """Which version wrote each bucket of the index: only those that hold a changed row are new."""
    return _merged(spark, folder).table_of_buckets().select("bucket", "since")


def _streamed(spark, folder, name, make, mode="append"):
    """The rows that a stream of the files of a table writes until there are no more."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    out = make(flows.subscribe(spark, f"{folder}/{name}.parque[t]", schema))  # a pattern may name a file or a folder, a path of a stream a folder only
    how = "overwrite" if mode == "complete" else "append"
    flows.run_available(out, lambda df, _: df.write.mode(how).parquet(f"{place}/rows"), f"{place}/checkpoint", mode)
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


def _plain_times(df):
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS begins FROM e),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session_no FROM b),
g AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL)
SELECT * FROM g WHERE ceil((epoch_us(last) + 7200000000) / 1000.0) <= (SELECT max(us) // 1000 - 3600000 FROM e)""")
def stream_sessions(spark, folder):
    """Sessions of users that a stream of events has closed, by state with timers; those still open at the end are not out."""
    with sessions.state_store(spark):
        out = _streamed(spark, folder, "events", lambda e: sessions.closed_sessions(e, "2 hours", "1 hour"))
    return _plain_times(out).withColumn("total", F.round("total", 4))


@query("""SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark, folder):
    """Events by windows of six hours, counted by a stream."""
    out = _streamed(spark, folder, "events", lambda e: flows.window_counts(e, "6 hours", "40 days", ["event_type"]), "complete")
    return _plain_times(out).withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, folder):
    """Each user's kinds of events, once, by a stream that drops what it has seen."""
    return _streamed(spark, folder, "events", lambda e: flows.first_seen(e, ["user_id", "event_type"], "40 days").select("user_id", "event_type"))


@query("""SELECT a.user_id, a.ts AS first_ts, b.ts AS then_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_pairs(spark, folder):
    """Purchases within two hours after a click of the same user, by a join of two streams."""
    pick = lambda e, kind: e.where(F.col("event_type") == kind).select("user_id", "ts")
    out = _streamed(spark, folder, "events", lambda e: flows.near_in_time(pick(e, "click"), pick(e, "purchase"), "user_id", "2 hours"))
    return _plain_times(out)


#: Calls stand in for spans: a user is a trace, and a call lasts up to four days, by its number.
_SPANS = "sp AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id AS span_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (event_id * 7919 % 97) * 3600 AS z FROM events)"

_TREE = f"""WITH RECURSIVE {_SPANS},
par AS (
  SELECT trace_id, span_id, arg_min(p, k) AS parent_id FROM (
    SELECT c.trace_id, c.span_id, o.span_id AS p, {{'z': o.z, 'a': -o.a, 'i': -o.span_id}} AS k
    FROM sp c JOIN sp o ON o.trace_id = c.trace_id AND o.span_id <> c.span_id AND o.a <= c.a AND o.z >= c.z AND (o.a < c.a OR o.z > c.z OR o.span_id < c.span_id))
  GROUP BY ALL),
t AS (SELECT sp.*, parent_id, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY z DESC, a, span_id) AS no,
    min(a) OVER (PARTITION BY trace_id, parent_id ORDER BY z DESC, a, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
  FROM sp LEFT JOIN par USING (trace_id, span_id)),
cov AS (SELECT trace_id, parent_id AS span_id, sum(greatest(0, least(z, coalesce(low, z)) - a)) AS covered FROM t WHERE parent_id IS NOT NULL GROUP BY ALL),
-- siblings from the last backwards: one is chosen if it ends by the time at which the one chosen before began
cur AS (
  SELECT trace_id, span_id AS parent_id, CAST(0 AS BIGINT) AS no, z AS edge, CAST(NULL AS BIGINT) AS span_id, false AS chosen FROM t
  UNION ALL
  SELECT t.trace_id, t.parent_id, t.no, CASE WHEN t.z <= cur.edge THEN t.a ELSE cur.edge END, t.span_id, t.z <= cur.edge FROM cur JOIN t ON t.trace_id = cur.trace_id AND t.parent_id = cur.parent_id AND t.no = cur.no + 1),
down AS (
  SELECT trace_id, span_id, 0 AS depth, true AS on_path FROM t WHERE parent_id IS NULL
  UNION ALL
  SELECT t.trace_id, t.span_id, depth + 1, on_path AND chosen FROM down JOIN t ON t.trace_id = down.trace_id AND t.parent_id = down.span_id JOIN cur ON cur.trace_id = t.trace_id AND cur.span_id = t.span_id),
held AS (SELECT cur.trace_id, parent_id AS span_id, sum(z - a) AS held FROM cur JOIN sp ON sp.trace_id = cur.trace_id AND sp.span_id = cur.span_id WHERE chosen GROUP BY ALL),
tree AS (
  SELECT trace_id, span_id, parent_id, depth, z - a AS duration, CAST(z - a - coalesce(covered, 0) AS BIGINT) AS self_time, on_path, CAST(CASE WHEN on_path THEN z - a - coalesce(held, 0) ELSE 0 END AS BIGINT) AS path_time
  FROM t JOIN down USING (trace_id, span_id) LEFT JOIN cov USING (trace_id, span_id) LEFT JOIN held USING (trace_id, span_id))"""


def _tree(spark, folder):
    start = F.unix_seconds("ts")
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("span_id"), start.alias("start"), (start + F.col("event_id") * 7919 % 97 * 3600).alias("end"))
    return traces.span_tree(events)


@query(f"{_TREE} SELECT * FROM tree")
def trace_tree(spark, folder):
    """Spans with their parents, self times and their part of the critical path."""
    return _tree(spark, folder)


@query(f"""{_TREE} SELECT trace_id, count(*) AS n_spans, count(*) FILTER (depth = 0) AS n_roots, max(depth) AS depth, CAST(sum(CASE WHEN depth = 0 THEN duration ELSE 0 END) AS BIGINT) AS duration, CAST(sum(self_time) AS BIGINT) AS busy,
count(*) FILTER (on_path) AS path_spans FROM tree GROUP BY trace_id""")
def trace_summary(spark, folder):
    return traces.trace_summary(_tree(spark, folder))


@query("""SELECT event_type, month(ts)::INTEGER AS month, count(*) AS n, true AS distinct_in_bound, true AS median_in_bound, true AS p95_in_bound FROM events GROUP BY ALL""")
def sketch_months(spark, folder):
    """Different users and quantiles of values by month, from sketches stored by day: how they compare with exact values.

    Bounds: four standard errors for the number of users, and three times the
    usual error in rank for quantiles.
    """
    e = table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    place = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.build(e, ["event_type", "day"], "user_id", "value").write.parquet(place)
    months = sketches.merge(spark.read.parquet(place).withColumn("month", F.month("day")), ["event_type", "month"])
    found = sketches.estimates(months, {"p50": 0.5, "p95": 0.95})
    own = e.withColumn("month", F.month("day")).join(F.broadcast(found), ["event_type", "month"])  # a row for each kind and month
    off = lambda q, p: F.abs(F.avg((F.col("value") <= F.col(q)).cast("int")) - p)
    exact = own.groupBy("event_type", "month").agg(F.max("n").alias("n"), F.count_distinct("user_id").alias("users"), F.max("n_distinct").alias("n_distinct"), off("p50", 0.5).alias("o50"), off("p95", 0.95).alias("o95"))
    slack = 3 * sketches.RANK_ERROR + 1 / F.col("n")
    return exact.select("event_type", "month", "n", (F.abs(F.col("n_distinct") - F.col("users")) <= 4 * 1.04 / 2 ** (sketches.LG / 2) * F.col("users") + 0.5).alias("distinct_in_bound"), (F.col("o50") <= slack).alias("median_in_bound"), (F.col("o95") <= slack).alias("p95_in_bound"))


_WEIGHT = " + ".join(f"CAST(h >= {cut} AS INTEGER)" for cut in significance.poisson_cuts())


@query(f"""WITH c AS (SELECT event_id AS case_id, event_type AS metric, ((event_id * 31) % 17 - 7) / 10.0::DOUBLE AS d FROM events),
x AS (SELECT metric, d, r, CASE WHEN r = 0 THEN 1 ELSE {_WEIGHT} END AS w FROM (SELECT *, concat('0x', substring(md5(case_id || ':' || r), 1, 8))::BIGINT AS h FROM c, range(101) g(r))),
m AS (SELECT metric, r, count(*) AS n, sum(d * w) / sum(w) AS mean FROM x GROUP BY ALL)
SELECT metric, max(n) AS n, round(max(mean) FILTER (r = 0), 6) AS delta, round(quantile_cont(round(mean, 9), 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(round(mean, 9), 0.975) FILTER (r > 0), 6) AS high,
  round(avg(CAST(round(mean, 9) > 0 AS INTEGER)) FILTER (r > 0), 6) AS better FROM m GROUP BY metric""")
def run_significance(spark, folder):
    """Whether a run of all events' values is better than another, which stands in for the run before."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("metric"), ((F.col("event_id") * 31 % 17 - 7) / 10).alias("d"))
    before = e.select("case_id", "metric", F.lit(0.0).alias("value"))
    return significance.bootstrap(before, e.withColumnRenamed("d", "value"), 100)
