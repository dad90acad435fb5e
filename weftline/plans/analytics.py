"""Conversations, traces, cost, evaluation, training data, numeric kernels and relational queries.

The driver's tables hold no model calls. Where a query needs them, ``events``
stands in: user_id is the session, event_type the model or role, props the
arguments, and value the cost or latency.
"""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extensions
from ..functions.vectors import positions
from ..operators import conversation, cost, evaluation, numeric, temporal, training
from ..sources.tables import table
from ..sources.versions import latest_per_key
from .registry import query

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _events(spark, folder):
    return table(spark, folder, "events")


def _messages(spark, folder):
    return table(spark, folder, "conversations")


@query("""SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations) WHERE role = 'system' OR r <= 3""")
def last_n_messages(spark, folder):
    return conversation.last_n(_messages(spark, folder), 3).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(f"""WITH c AS (SELECT *, len({W}) AS n FROM conversations),
s AS (SELECT *, coalesce(sum(n) FILTER (role = 'system') OVER (PARTITION BY conv_id), 0) AS sys, sum(CASE WHEN role <> 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS back FROM c)
SELECT conv_id, turn FROM s WHERE role = 'system' OR sys + back <= 300""")
def truncate_tokens(spark, folder):
    return conversation.truncate_tokens(_messages(spark, folder), 300).select("conv_id", "turn")


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context_md5, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def multi_turn_context(spark, folder):
    return conversation.context(_messages(spark, folder)).select("conv_id", F.md5("context").alias("context_md5"), "n_turns")


@query("SELECT event_id, 'user ' || user_id AS thought, event_type AS action, regexp_extract(props, '([0-9]+)', 1) AS argument FROM events")
def parse_actions(spark, folder):
    out = F.format_string("Thought: user %d\nAction: %s[%s]", "user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1))
    return conversation.parse_actions(_events(spark, folder).withColumn("output", out)).select("event_id", "thought", "action", "argument")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_tool' WHEN (props->>'k')::INT IS NULL THEN 'bad_arguments' ELSE 'ok' END AS status FROM events")
def tool_registry_check(spark, folder):
    e = _events(spark, folder)
    registry = e.where("event_type != 'error'").select(F.col("event_type").alias("tool"))
    return conversation.check_calls(e.select("event_id", F.col("event_type").alias("tool"), F.col("props").alias("args")), registry).select("event_id", "status")


@query("SELECT n_regionkey AS kind, string_agg('- ' || n_name || ': nation ' || n_nationkey, chr(10) ORDER BY n_name) AS listing FROM nation GROUP BY n_regionkey")
def tool_listing(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_regionkey").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"))
    return conversation.describe_tools(n)


def _steps(spark, folder):
    return _events(spark, folder).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("action"), (F.col("event_type") != "error").alias("ok"))


@query("""SELECT run_id, step, next_action, coalesce(next_action = action, false) AS repeated FROM (
  SELECT user_id AS run_id, event_id AS step, event_type AS action, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_action FROM events) WHERE action = 'error'""")
def failed_steps(spark, folder):
    return conversation.failures(_steps(spark, folder)).select("run_id", "step", "next_action", "repeated")


@query("""SELECT from_role, to_role, count(*) AS n FROM (SELECT role AS from_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_role FROM conversations) WHERE to_role IS NOT NULL GROUP BY ALL""")
def handoff_pairs(spark, folder):
    return conversation.handoffs(_messages(spark, folder), "conv_id", "turn", "role")


EDGES = "e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey + 1)"


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def graph_reach(spark, folder):
    c, o, li, s = (table(spark, folder, t) for t in ("customer", "orders", "lineitem", "supplier"))
    edges = c.join(o, c["c_custkey"] == o["o_custkey"]).join(li, li["l_orderkey"] == o["o_orderkey"]).join(s, s["s_suppkey"] == li["l_suppkey"]).where("s_nationkey = c_nationkey + 1").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return conversation.reachable(edges, spark.createDataFrame([(0,)], "node int"))


@query("""WITH RECURSIVE t AS (SELECT n_nationkey AS task, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey - 1 END AS needs FROM nation),
l AS (SELECT task, 0 AS level FROM t WHERE needs IS NULL UNION ALL SELECT t.task, level + 1 FROM t JOIN l ON t.needs = l.task) SELECT task, level FROM l""")
def plan_order(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("task"))
    return conversation.plan_order(n, n.where("task % 3 != 0").withColumn("needs", F.col("task") - 1))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS latest FROM events GROUP BY user_id")
def last_state(spark, folder):
    return conversation.last_state(_events(spark, folder).select("user_id", F.col("event_type").alias("state"), F.col("event_id").alias("latest")), "user_id", "latest", ["state", "latest"])


@query("SELECT l_orderkey AS call, count(*) AS attempts, arg_max(l_returnflag, l_linenumber * 1000000000::BIGINT + l_partkey * 1000 + l_suppkey % 1000) AS final FROM lineitem GROUP BY l_orderkey")
def retry_outcomes(spark, folder):
    attempt = F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    return conversation.outcomes(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("call"), attempt.alias("attempt"), F.col("l_returnflag").alias("status")))


MODELS = [("large", 3, 100, 0.03, True), ("medium", 2, 80, 0.01, True), ("small", 1, 50, 0.002, True), ("tiny", 1, 50, 0.001, False)]


@query("""WITH m(model, level, win, price, available) AS (VALUES ('large', 3, 100, 0.03, true), ('medium', 2, 80, 0.01, true), ('small', 1, 50, 0.002, true), ('tiny', 1, 50, 0.001, false)),
r AS (SELECT event_id AS request_id, user_id % 3 + 1 AS needs, (props->>'k')::INT AS tokens FROM events)
SELECT request_id, arg_min(model, price) AS model, round(min(price)::DOUBLE * any_value(tokens), 6) AS cost FROM r LEFT JOIN m ON level >= needs AND win >= tokens AND available GROUP BY request_id""")
def model_routing(spark, folder):
    requests = _events(spark, folder).select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3 + 1).alias("needs"), F.get_json_object("props", "$.k").cast("int").alias("tokens"))
    return conversation.route(requests, spark.createDataFrame(MODELS, "model string, level int, window int, price double, available boolean"))


def _results(spark, folder):
    """Long results: case_id, metric, run_id, value."""
    return _events(spark, folder).select(F.col("event_id").alias("case_id"), F.col("event_type").alias("metric"), (F.col("user_id") % 2).alias("run_id"), "value")


@query("SELECT event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def eval_summary(spark, folder):
    return evaluation.summary(_results(spark, folder))


@query("SELECT user_id % 2 AS run_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY ALL")
def eval_pivot(spark, folder):
    return evaluation.report(_results(spark, folder), ["click", "error", "view"])


_PAIRS = "p AS (SELECT conv_id, turn, lead(role) OVER w AS r, text AS answer, lead(text) OVER w AS expected, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), own AS (SELECT * FROM p WHERE role = 'user' AND r = 'assistant')"


def _answers(spark, folder):
    pairs = training.sft_pairs(_messages(spark, folder))
    return pairs.select(F.struct("conv_id", "turn").alias("case_id"), F.col("instruction").alias("answer"), F.col("output").alias("expected"))


@query(rf"""WITH {_PAIRS},
t AS (SELECT *, list_distinct(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(expected), '[\p{{L}}\p{{N}}]+')) AS e FROM own)
SELECT conv_id, turn, trim(answer) = trim(expected) AS exact, round(CASE WHEN len(a) + len(e) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(a, e)) / (len(a) + len(e)) END, 6) AS f1,
  CAST(levenshtein(regexp_replace(answer, '[^\x00-\x7F]', '?', 'g'), regexp_replace(expected, '[^\x00-\x7F]', '?', 'g')) AS INTEGER) AS edit FROM t""")
def answer_similarity(spark, folder):
    """Answers as they are; letters beyond ASCII are one mark, as not every engine's edit distance knows them."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    pairs = _answers(spark, folder)
    both = evaluation.answer_similarity(pairs).drop("edit").join(evaluation.answer_similarity(pairs.withColumns({"answer": plain("answer"), "expected": plain("expected")})).select("case_id", "edit"), "case_id")
    return both.select("case_id.*", "exact", "f1", "edit")


@query(rf"""WITH RECURSIVE {_PAIRS},
t AS (SELECT conv_id, turn, regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(lower(expected), '[\p{{L}}\p{{N}}]+') AS e FROM own),
-- a row of the table of common subsequences: its values never fall, so it is the running maximum of what a match adds
l AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, j, 0 AS v FROM t, LATERAL (SELECT unnest(range(len(e) + 1)) AS j)
  UNION ALL
  SELECT conv_id, turn, i + 1, j, max(CASE WHEN j > 0 AND a[i + 1] = e[j] THEN before + 1 ELSE v END) OVER (PARTITION BY conv_id, turn ORDER BY j)
  FROM (SELECT l.*, a, e, lag(v) OVER (PARTITION BY l.conv_id, l.turn ORDER BY j) AS before FROM l JOIN t ON t.conv_id = l.conv_id AND t.turn = l.turn WHERE i < len(a)))
SELECT t.conv_id, t.turn, len(a) AS n_answer, len(e) AS n_expected, v::BIGINT AS common, round(v / len(a)::DOUBLE, 6) AS precision, round(v / len(e)::DOUBLE, 6) AS recall, round(2.0::DOUBLE * v / (len(a) + len(e)), 6) AS f1
FROM t JOIN l ON l.conv_id = t.conv_id AND l.turn = t.turn AND l.i = len(a) AND l.j = len(e)""")
def answer_sequence(spark, folder):
    """Answers by the longest common subsequence of their words."""
    return evaluation.sequence_similarity(_answers(spark, folder)).select("case_id.*", "n_answer", "n_expected", "common", "precision", "recall", "f1")


@query("""SELECT event_type, count(*) AS n, round(avg(CAST(value < 40 AS INTEGER)), 6) AS success_rate, round(avg((props->>'k')::INT), 6) AS avg_steps,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def run_summary(spark, folder):
    runs = _events(spark, folder).select("event_type", (F.col("value") < 40).alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("steps"), F.col("value").alias("latency"))
    return evaluation.run_summary(runs, "event_type")


@query("""WITH r AS (SELECT user_id % 7 AS task, event_type <> 'error' AS ok, (props->>'k')::INT + 1 AS steps, event_type AS tool FROM events)
SELECT task, round(avg(CAST(ok AS INTEGER)), 6) AS completion_rate, round(avg(least(10.0::DOUBLE / steps, 1.0)), 6) AS step_efficiency, round(avg(CAST(tool = 'click' AS INTEGER)), 6) AS tool_accuracy FROM r GROUP BY task""")
def completion(spark, folder):
    runs = _events(spark, folder).select((F.col("user_id") % 7).alias("task"), (F.col("event_type") != "error").alias("ok"), (F.get_json_object("props", "$.k").cast("int") + 1).alias("steps"), F.col("event_type").alias("tool"))
    expected = spark.range(7).select(F.col("id").alias("task"), F.lit(10).alias("best_steps"), F.lit("click").alias("right_tool"))
    return evaluation.completion(runs, expected)


@query("SELECT event_id, json_valid(props) AS valid, coalesce((props->>'k') IS NOT NULL, false) AS complete FROM events")
def format_compliance(spark, folder):
    return evaluation.format_compliance(_events(spark, folder), "props", ["k"]).select("event_id", "valid", "complete")


@query("""SELECT count(*) AS n, round(avg(CAST((quality >= 0.5) = (x >= 0.5) AS INTEGER)), 6) AS agreement, round(corr(quality, x), 6) AS correlation
FROM (SELECT quality::DOUBLE AS quality, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS x FROM documents JOIN labels USING (doc_id))""")
def dual_scores(spark, folder):
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("double") / F.greatest(F.length("text"), F.lit(1))
    rule = table(spark, folder, "documents").select("doc_id", letters.alias("score"))
    return evaluation.dual_scores(table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), rule, "doc_id", 0.5)


@query("""WITH a AS (SELECT user_id, event_type AS metric, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), b AS (SELECT user_id, event_type AS metric, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL)
SELECT metric, count(*) AS n, round(avg(b.v - a.v), 6) AS delta, count(*) FILTER (b.v - a.v > 1) AS win, count(*) FILTER (abs(b.v - a.v) <= 1) AS tie, count(*) FILTER (b.v - a.v < -1) AS loss FROM a JOIN b USING (user_id, metric) GROUP BY metric""")
def run_compare(spark, folder):
    own = lambda c: _events(spark, folder).where(c).groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("metric")).agg(evaluation.exact_mean(F.col("value")).alias("value"))
    return evaluation.compare_runs(own("ts < timestamp'2024-01-15'"), own("ts >= timestamp'2024-01-15'"), 1.0)


@query("SELECT metric, case_id, value, CAST(place AS INTEGER) AS place FROM (SELECT event_type AS metric, event_id AS case_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS FIRST, event_id) AS place FROM events) WHERE place <= 5")
def bad_cases(spark, folder):
    return evaluation.worst(_results(spark, folder), 5).select("metric", "case_id", "value", "place")


@query("SELECT event_type AS metric, user_id % 2 AS run_id, grouping_id(event_type, user_id % 2) AS gid, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY CUBE (event_type, user_id % 2)")
def slice_cube(spark, folder):
    return evaluation.slices(_results(spark, folder), ["metric", "run_id"])


@query("SELECT user_id, count(*) AS n, round(avg(CAST(event_type <> 'error' AS INTEGER)), 6) AS rate FROM events GROUP BY user_id HAVING round(avg(CAST(event_type <> 'error' AS INTEGER)), 6) < 0.75")
def failure_alerts(spark, folder):
    return evaluation.alerts(_events(spark, folder), "user_id", F.col("event_type") != "error", 0.75)


def _calls(spark, folder):
    return _events(spark, folder).select("event_id", "ts", F.col("event_type").alias("model"), F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("endpoint"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"), F.col("user_id").alias("session"))


@query("""SELECT model, endpoint, grouping_id(model, endpoint) AS gid, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost
FROM (SELECT event_type AS model, 'e' || (user_id % 4) AS endpoint, (props->>'k')::BIGINT AS tokens, value::DECIMAL(18,6) AS cost FROM events) GROUP BY GROUPING SETS ((model), (endpoint), (model, endpoint), ())""")
def cost_grouping_sets(spark, folder):
    return cost.cost_summary(_calls(spark, folder).withColumn("cost", F.col("cost").cast(cost.MONEY))).withColumn("cost", F.col("cost").cast("double"))


@query("""SELECT event_id, CAST(CAST((props->>'k')::BIGINT * CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'purchase' THEN 2 END / 1000 AS DECIMAL(18,6)) AS DOUBLE) AS cost FROM events""")
def cost_estimate(spark, folder):
    prices = spark.createDataFrame([("click", 0.5), ("view", 0.25), ("purchase", 2.0)], "model string, price double")
    return cost.estimate(_calls(spark, folder).select("event_id", "model", "tokens"), prices).select("event_id", F.col("cost").cast("double").alias("cost"))


@query("""SELECT model, count(*) AS calls, count(*) FILTER (nth > 1) AS hits, round(coalesce(sum(value) FILTER (nth > 1), 0), 2) AS saved FROM (
  SELECT event_type AS model, value, row_number() OVER (PARTITION BY event_type, props, user_id ORDER BY event_id) AS nth FROM events) GROUP BY model""")
def cache_savings(spark, folder):
    return cost.cache_savings(_calls(spark, folder), ["tokens", "session"], "event_id")


@query("""WITH p AS (SELECT concat_ws('>', lag(event_type, 2) OVER w, lag(event_type) OVER w, event_type) AS path, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT path, round(sum(value), 2) AS cost FROM p GROUP BY path ORDER BY 2 DESC, 1 LIMIT 10""")
def top_paths(spark, folder):
    return cost.top_paths(cost.call_paths(_calls(spark, folder)), 10)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS model, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY ALL")
def cost_over_time(spark, folder):
    return cost.over_time(_calls(spark, folder)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT conv_id, turn, text AS instruction, '' AS input, output FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'""")
def sft_pairs(spark, folder):
    return training.sft_pairs(_messages(spark, folder))


@query("""SELECT prompt, arg_max(answer, (score, answer)) AS chosen, arg_min(answer, (score, answer)) AS rejected FROM (SELECT conv_id AS prompt, text AS answer, length(text) AS score FROM conversations WHERE role = 'assistant') GROUP BY prompt HAVING max(score) > min(score)""")
def preference_pairs(spark, folder):
    return training.preference_pairs(_messages(spark, folder).where("role = 'assistant'").select(F.col("conv_id").alias("prompt"), F.col("text").alias("answer"), F.length("text").alias("score")))


@query("SELECT doc_id, CASE WHEN concat('0x', substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 10 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark, folder):
    return training.hash_split(table(spark, folder, "documents"), "doc_id", 10).select("doc_id", "split")


@query("""WITH l AS (SELECT day AS version, count(*) AS rows, round(avg(value), 6) AS score FROM (SELECT CAST(dayofyear(ts) AS INTEGER) AS day, value FROM events) GROUP BY day)
SELECT version, rows, score, rows >= 340 OR coalesce(lag(score) OVER (ORDER BY version) - score, 0) > 1 AS due FROM l""")
def retrain_trigger(spark, folder):
    log = _events(spark, folder).groupBy(F.dayofyear("ts").alias("version")).agg(F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("score"))
    return training.retrain(log, 340, 1.0)


@query("""SELECT doc_id, CAST(g AS INTEGER) AS batch_group, CAST((row_number() OVER (PARTITION BY g ORDER BY h, doc_id) - 1) // 8 AS INTEGER) AS batch
FROM (SELECT doc_id, concat('0x', substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 64 AS g, md5(doc_id::VARCHAR) AS h FROM documents)""")
def minibatches(spark, folder):
    return training.minibatches(table(spark, folder, "documents"), "doc_id", 8).select("doc_id", "batch_group", "batch")


@query("""SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS 2 PRECEDING), 6) AS smoothed
FROM (SELECT user_id AS run, event_id AS step, value AS loss FROM events)""")
def experiment_log(spark, folder):
    return training.experiments(_events(spark, folder).select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")))


@query("SELECT event_type AS model, max(event_id) AS version, arg_max(user_id, event_id) AS parent FROM events GROUP BY event_type")
def model_registry(spark, folder):
    log = _events(spark, folder).select(F.col("event_type").alias("model"), F.col("event_id").alias("version"), F.col("user_id").alias("parent"))
    return latest_per_key(log, "model", "version").select("model", "version", "parent")


V = "v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f'WITH {V} SELECT CAST(a.dim AS INTEGER) AS "row", CAST(b.dim AS INTEGER) AS col, round(sum(a.x * b.x), 5) AS value FROM v a JOIN v b USING (vec_id) GROUP BY ALL')
def matrix_product(spark, folder):
    """The vectors' matrix, turned, by itself."""
    each = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    m = each.select(F.col("vec_id").alias("row"), F.col("dim").alias("col"), F.col("x").cast("double").alias("value"))
    turned = m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return numeric.multiply(turned, m).select("row", "col", F.round("value", 5).alias("value"))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS p FROM documents GROUP BY lang, source")
def conditional_probability(spark, folder):
    return numeric.conditional(table(spark, folder, "documents"), "lang", "source")


def _sequences(spark, folder):
    """Short sequences: the vectors of a label in order of id, 20 to a sequence."""
    e = table(spark, folder, "embeddings")
    return e.select((F.col("label") * 100000 + F.floor(F.col("vec_id") / 100)).cast("long").alias("group"), F.col("vec_id").alias("at"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _attention(heads):
    width = 64 // heads
    return f"""s AS (SELECT label::BIGINT * 100000 + vec_id // 100 AS grp, vec_id AS pos, embedding::DOUBLE[] AS e FROM embeddings),
h AS (SELECT grp, pos, g.h AS head, list_slice(e, g.h * {width} + 1, (g.h + 1) * {width}) AS e FROM s, range({heads}) g(h)),
d AS (SELECT a.grp, a.head, a.pos AS q, b.pos AS k, list_dot_product(a.e, b.e) / sqrt({width}.0::DOUBLE) AS s FROM h a JOIN h b ON a.grp = b.grp AND a.head = b.head AND b.pos <= a.pos),
x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY grp, head, q)) AS e FROM d),
w AS (SELECT grp, CAST(head AS INTEGER) AS head, q, k, round(e / sum(e) OVER (PARTITION BY grp, head, q), 6) AS weight FROM x)"""


@query(f'WITH {_attention(1)} SELECT grp AS "group", head, q, k, weight FROM w')
def attention_heatmap(spark, folder):
    return numeric.attention_weights(_sequences(spark, folder))


@query(f"""WITH {_attention(4)}, y AS (SELECT grp, pos AS k, CAST(head AS INTEGER) AS head, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS x FROM h)
SELECT w.grp AS "group", w.head, q, CAST(dim AS INTEGER) AS dim, round(sum(weight * x), 5) + 0.0::DOUBLE AS value FROM w JOIN y ON y.grp = w.grp AND y.head = w.head AND y.k = w.k GROUP BY ALL""")
def multi_head_attention(spark, folder):
    return numeric.attend(_sequences(spark, folder), 4).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query("""SELECT x AS pos, CAST(i AS INTEGER) AS dim, round(CASE WHEN i % 2 = 0 THEN sin(x / pow(10000.0::DOUBLE, (i - i % 2) / 8.0)) ELSE cos(x / pow(10000.0::DOUBLE, (i - i % 2) / 8.0)) END, 6) AS value FROM (SELECT DISTINCT l_linenumber AS x FROM lineitem), range(0, 8) g(i)""")
def position_codes(spark, folder):
    at = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("pos")).distinct()
    return at.select("pos", F.posexplode(positions(8, F.col("pos"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH RECURSIVE p AS (SELECT (l_quantity - 25) / 15 AS x, l_extendedprice / 10000 AS y FROM lineitem),
m AS (SELECT avg(x) AS sx, avg(y) AS sy, avg(x * x) AS sxx, avg(x * y) AS sxy, avg(y * y) AS syy FROM p),
g AS (SELECT 0 AS step, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT step + 1, w - 0.2 * (w * sxx + b * sx - sxy), b - 0.2 * (b + w * sx - sy) FROM g, m WHERE step < 20)
SELECT step, round(w, 6) AS w, round(b, 6) AS b, round(syy + w * w * sxx + b * b - 2 * w * sxy - 2 * b * sy + 2 * w * b * sx, 6) AS loss FROM g, m""")
def gradient_descent(spark, folder):
    li = table(spark, folder, "lineitem")
    return numeric.linear_fit(li.select(((F.col("l_quantity") - 25) / 15).alias("x"), (F.col("l_extendedprice") / 10000).alias("y")))


# Relational queries over the star schema.


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, folder):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, folder, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, folder):
    li, o, c, n, r = (table(spark, folder, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return both.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def customers_except(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    urgent = c.join(o.where("o_orderpriority = '1-URGENT'"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")
    return urgent.subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) INTERSECT SELECT s_nationkey FROM supplier")
def nations_intersect(spark, folder):
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return c.select(F.col("c_nationkey").alias("n_nationkey")).intersect(s.select("s_nationkey"))


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def nation_balance(spark, folder):
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, round(sum(o_totalprice), 2) AS total, CAST(rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS INTEGER) AS place FROM orders GROUP BY o_custkey QUALIFY place <= 20""")
def best_customers(spark, folder):
    own = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    # the least of the 20 best totals bounds the rows that a rank without a partition orders
    least = own.orderBy(F.col("total").desc()).limit(20).agg(F.min("total").alias("least"))
    best = own.join(F.broadcast(least), F.col("total") >= F.col("least")).drop("least")
    return best.withColumn("place", F.rank().over(Window.orderBy(F.col("total").desc()))).where("place <= 20")


@query("SELECT c_mktsegment, status, n FROM (SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) UNPIVOT (n FOR status IN (F, O, P))")
def segment_status(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    wide = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.unpivot("c_mktsegment", ["F", "O", "P"], "status", "n")


@query("""SELECT o.o_orderkey, r.band FROM orders o JOIN (SELECT i AS band, i * 5000.0 AS low, (i + 1) * 5000.0 AS high FROM range(0, 200) g(i)) r ON o.o_totalprice >= r.low AND o.o_totalprice < r.high""")
def price_bands(spark, folder):
    bands = spark.range(200).select(F.col("id").alias("band"), (F.col("id") * 5000.0).alias("low"), ((F.col("id") + 1) * 5000.0).alias("high"))
    return temporal.range_join(table(spark, folder, "orders"), bands, "o_totalprice", "low", "high", 10000.0).select("o_orderkey", "band")


@query("""SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_tumbling(spark, folder):
    return temporal.tumbling(_events(spark, folder), "1 hour", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT w AS start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT CAST(date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS TIMESTAMP) AS w, value FROM events, range(0, 2) g(i)) GROUP BY w""")
def event_sliding(spark, folder):
    return temporal.sliding(_events(spark, folder), "2 hours", "1 hour", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, folder):
    return temporal.sessions(_events(spark, folder), "user_id", "4 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_events(spark, folder):
    e = _events(spark, folder)
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return temporal.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["view_id"]).select("event_id", "view_id")


@query(f"WITH {EDGES}" + """
SELECT src, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = e.dst AND n_regionkey = 1) GROUP BY src""")
def exists_edges(spark, folder):
    """A correlated subquery."""
    for t in ("customer", "orders", "lineitem", "supplier", "nation"):
        table(spark, folder, t).createOrReplaceTempView(f"_x_{t}")
    return spark.sql(
        """WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM _x_customer JOIN _x_orders ON o_custkey = c_custkey JOIN _x_lineitem ON l_orderkey = o_orderkey JOIN _x_supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey + 1)
        SELECT src, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM _x_nation WHERE n_nationkey = e.dst AND n_regionkey = 1) GROUP BY src"""
    )


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) JOIN customer ON c_custkey = o_custkey WHERE r <= 2 AND c_mktsegment = 'BUILDING'""")
def lateral_top_orders(spark, folder):
    """A lateral subquery: the two largest orders of each customer of a segment."""
    table(spark, folder, "customer").createOrReplaceTempView("_l_customer")
    table(spark, folder, "orders").createOrReplaceTempView("_l_orders")
    return spark.sql("SELECT c_custkey, o_orderkey, o_totalprice FROM _l_customer, LATERAL (SELECT o_orderkey, o_totalprice FROM _l_orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) WHERE c_mktsegment = 'BUILDING'")


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN nation ON n_nationkey = node * 2 + 1 OR n_nationkey = node * 2 + 2) SELECT node, depth FROM t")
def recursive_tree(spark, folder):
    """A recursive query over a small hierarchy; large graphs take conversation.reachable()."""
    table(spark, folder, "nation").createOrReplaceTempView("_r_nation")
    return spark.sql("WITH RECURSIVE t AS (SELECT n_nationkey AS node, 0 AS depth FROM _r_nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN _r_nation ON n_nationkey = node * 2 + 1 OR n_nationkey = node * 2 + 2) SELECT node, depth FROM t")


@query("SELECT event_id, CASE WHEN (props->>'k')::INT >= 50 THEN 2 ELSE 1 END AS n_tags, event_type AS kind, CASE WHEN (props->>'k')::INT >= 50 THEN 'large' END AS size FROM events")
def metadata_maps(spark, folder):
    """Metadata as maps: tags with a value are kept, and looked up by name."""
    e = _events(spark, folder)
    tags = F.map_from_arrays(F.array(F.lit("kind"), F.lit("size")), F.array("event_type", F.when(F.get_json_object("props", "$.k").cast("int") >= 50, "large")))
    kept = F.map_filter(tags, lambda k, v: v.isNotNull())
    return e.select("event_id", kept.alias("m")).select("event_id", F.size("m").alias("n_tags"), F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("size")).alias("size"))


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
def rolling_day(spark, folder):
    w = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"
    return _events(spark, folder).select("event_id", F.expr(f"count(*) {w}").alias("n"), F.expr(f"round(sum(value) {w}, 2)").alias("total"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def priorities_except_all(spark, folder):
    o = table(spark, folder, "orders")
    own = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderpriority").alias("priority"))
    return own("F").exceptAll(own("O")).groupBy("priority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def priorities_intersect_all(spark, folder):
    o = table(spark, folder, "orders")
    own = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderpriority").alias("priority"))
    return own("F").intersectAll(own("O")).groupBy("priority").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_type AS metric, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
SELECT line_no, line FROM (VALUES (0, '# Results'), (1, ''), (2, '| metric | n | mean | low | high |'), (3, '|---|---|---|---|---|')) v(line_no, line)
UNION ALL SELECT CAST(row_number() OVER (ORDER BY metric) + 3 AS INTEGER), '| ' || metric || ' | ' || n || ' | ' || printf('%.2f', mean) || ' | ' || printf('%.2f', low) || ' | ' || printf('%.2f', high) || ' |' FROM s""")
def eval_report(spark, folder):
    return evaluation.report_lines(_results(spark, folder), "Results")


@query("SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events")
def observed_metrics(spark, folder):
    """Metrics that an action collects on its way."""
    df, watch = evaluation.observed(_events(spark, folder), "events", rows=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"), mean=F.round(F.avg("value"), 6))
    df.write.format("noop").mode("overwrite").save()
    got = watch.get
    return spark.createDataFrame([(got["rows"], got["errors"], got["mean"])], "rows long, errors long, mean double")


@query("""SELECT event_type AS metric, count(*) AS n, round(avg((props->>'k')::BIGINT * 0.3::DOUBLE - value), 6) AS delta, count(*) FILTER ((props->>'k')::BIGINT * 0.3::DOUBLE - value > 5) AS win, count(*) FILTER (abs((props->>'k')::BIGINT * 0.3::DOUBLE - value) <= 5) AS tie,
  count(*) FILTER ((props->>'k')::BIGINT * 0.3::DOUBLE - value < -5) AS loss FROM events GROUP BY event_type""")
def cost_compare(spark, folder):
    """The cost of each call, as it was and at the price of a local model."""
    calls = _calls(spark, folder).select(F.col("event_id").alias("case_id"), F.col("model").alias("metric"), "tokens", "cost")
    return evaluation.compare_runs(calls.select("case_id", "metric", F.col("cost").alias("value")), calls.select("case_id", "metric", (F.col("tokens") * 0.3).alias("value")), 5.0)


@query("""SELECT item_id, CAST(i - 1 AS INTEGER) AS sentence_no, trim(s[i]) AS sentence FROM (SELECT item_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$') AS s FROM benchmark), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE trim(s[i]) <> ''""")
def sentences(spark, folder):
    """A table function of our own, called for each row."""
    spark.udtf.register("sentences_of", extensions.Sentences)
    table(spark, folder, "benchmark").createOrReplaceTempView("_s_benchmark")
    return spark.sql("SELECT item_id, sentence_no, sentence FROM _s_benchmark, LATERAL sentences_of(text)")


@query("SELECT event_type, round(exp(avg(ln(value)) FILTER (value > 0)), 5) AS mean FROM events GROUP BY event_type")
def geometric_means(spark, folder):
    """An aggregate function of our own."""
    return _events(spark, folder).groupBy("event_type").agg(F.round(extensions.geometric_mean("value"), 5).alias("mean"))


@query("SELECT CAST(d AS DATE) AS day, CAST(isodow(d) AS INTEGER) AS weekday, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = CAST(d AS DATE)) AS n FROM range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) g(d)")
def events_by_day(spark, folder):
    """A source of our own: all days of a calendar, with the events of each."""
    spark.dataSource.register(extensions.Calendar)
    days = spark.read.format("calendar").option("start", "2024-01-01").option("days", "35").load()
    n = _events(spark, folder).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", "weekday", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
