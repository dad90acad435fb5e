"""Retrieval, evaluation of retrieval, and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import upper
from ..operators import conversation, evaluation, retrieval
from ..operators.text import chunk
from ..sources.shared import keep
from ..sources.tables import table
from ..sources.versions import apply_diff, index_diff
from .preparation import LINE_CHUNKS, RECURSIVE_CHUNKS
from .registry import query


def _queries(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")


def _corpus(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


BM25 = r"""
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
d AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT item_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
sc AS (
  SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), st GROUP BY query_id, item_id)"""


def _top(name, k, source="sc"):
    return f"{name} AS (SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {source}) WHERE rank <= {k})"


OVERLAP = r"""
qo AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
so AS (
  SELECT query_id, item_id, round(count(*)::DOUBLE / any_value(n), 6) AS score
  FROM q JOIN (SELECT DISTINCT item_id, term FROM p) USING (term) JOIN qo USING (query_id) GROUP BY query_id, item_id)"""


def bm25(spark, folder, k=10):
    return retrieval.bm25_topk(_queries(spark, folder), _corpus(spark, folder), k)


@query(f"WITH {BM25}, {_top('t', 10)} SELECT * FROM t")
def bm25_topk(spark, folder):
    return bm25(spark, folder)


@query(f"WITH {BM25}, {OVERLAP}, {_top('t', 10, 'so')} SELECT * FROM t")
def overlap_topk(spark, folder):
    return retrieval.overlap_topk(_queries(spark, folder), _corpus(spark, folder), 10)


def _hashed(name, source, key):
    """CTEs of hashed_embedding() over (key, text) rows, as name(id, bucket, w)."""
    return rf"""
{name}_t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {source}),
{name}_c AS (SELECT id, concat('0x', substring(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS w FROM {name}_c),
{name}_n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY id)"""


RRF = f"""{BM25}, {_hashed('hq', 'benchmark', 'item_id')}, {_hashed('hd', 'documents', 'doc_id')}, {_top('a', 20)},
hs AS (
  SELECT query_id, item_id, round(dot / (x.norm * y.norm), 6) AS score
  FROM (SELECT hq.id AS query_id, hd.id AS item_id, sum(hq.w * hd.w) AS dot FROM hq JOIN hd USING (bucket) GROUP BY ALL) JOIN hq_n x ON x.id = query_id JOIN hd_n y ON y.id = item_id),
{_top('b', 20, 'hs')},
u AS (SELECT query_id, item_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM a UNION ALL SELECT query_id, item_id, rank FROM b) GROUP BY ALL),
{_top('fused', 10, 'u')}"""


@query(f"WITH {RRF} SELECT * FROM fused")
def hybrid_rrf(spark, folder):
    near = retrieval.vector_topk(retrieval.hashed_vectors(_queries(spark, folder)), retrieval.hashed_vectors(_corpus(spark, folder)), 20, skip_self=False)
    return retrieval.rrf([bm25(spark, folder, 20), near])


@query(f"""WITH {RRF}
SELECT query_id, item_id, score, rank FROM (
  SELECT f.*, row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY rank) AS nth FROM fused f JOIN documents ON doc_id = item_id) WHERE nth = 1""")
def fused_dedup(spark, folder):
    return retrieval.dedup_hits(keep(hybrid_rrf(spark, folder)), _corpus(spark, folder))


RERANK = f"""{BM25}, {_top('t', 20)},
qs AS (SELECT query_id, list(term) AS q FROM q GROUP BY query_id),
r AS (
  SELECT query_id, item_id, t.score AS first_score, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))))::DOUBLE / len(q), 6) AS score
  FROM t JOIN qs USING (query_id) JOIN documents ON doc_id = item_id),
rr AS (SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_score DESC, item_id) AS rank FROM r) WHERE rank <= 5)"""


@query(f"WITH {RERANK} SELECT * FROM rr")
def rerank_topk(spark, folder):
    return retrieval.rerank(bm25(spark, folder, 20), _queries(spark, folder), _corpus(spark, folder))


VECTORS = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_COSINE = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)"


@query(f"WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id), {_top('t', 10)} SELECT * FROM t")
def vector_topk(spark, folder):
    v = _vectors(spark, folder)
    return retrieval.vector_topk(v.where("id % 50 = 0"), v, 10)


@query(f"WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a JOIN v b ON a.label = b.label WHERE a.id % 50 = 0 AND a.id <> b.id), {_top('t', 5)} SELECT * FROM t")
def vector_topk_filtered(spark, folder):
    v = _vectors(spark, folder)
    return retrieval.vector_topk(v.where("id % 50 = 0"), v, 5, same="label")


@query(f"""WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a, v b WHERE a.id % 50 = 0 AND b.id < a.id), {_top('t', 1)}
SELECT query_id, item_id, score FROM t WHERE score >= 0.2""")
def semantic_cache(spark, folder):
    return retrieval.cached_answers(_vectors(spark, folder), 0.2)


@query(f"""WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id AND b.id >= 100 AND b.id < 300), {_top('t', 10)} SELECT * FROM t""")
def vector_topk_in_time(spark, folder):
    """The vectors stand in for texts that came in one an hour from the beginning of 2024."""
    v = _vectors(spark, folder).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.col("id").cast("int")))
    return retrieval.vector_topk(v.where("id % 50 = 0"), retrieval.in_time(v, "ts", "2024-01-05 04:00:00", "2024-01-13 12:00:00"), 10)


@query()
def ann_topk(spark, folder):
    """Approximate; the tests hold its recall against brute force."""
    v = _vectors(spark, folder)
    return retrieval.CellIndex(v).topk(v.where("id % 50 = 0"))


@query(f"WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id), {_top('t', 10)} SELECT * FROM t")
def ann_topk_exact(spark, folder):
    v = _vectors(spark, folder)
    return retrieval.CellIndex(v).exact_topk(v.where("id % 50 = 0"))


def _messages(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", F.struct("conv_id", "turn").alias("id"))


MEMORY = f"""c AS (SELECT {{'c': conv_id, 't': turn}} AS id, conv_id, turn, role, text FROM conversations), {_hashed('h', 'c', 'id')},
lastq AS (SELECT conv_id, max(turn) AS turn FROM c WHERE role = 'user' GROUP BY conv_id),
ms AS (
  SELECT l.conv_id, l.turn AS query_turn, m.turn, round(dot / (x.norm * y.norm), 6) AS score
  FROM (SELECT a.id AS qid, b.id AS mid, sum(a.w * b.w) AS dot FROM h a JOIN h b ON a.bucket = b.bucket AND a.id.c = b.id.c AND b.id.t < a.id.t GROUP BY ALL)
  JOIN lastq l ON l.conv_id = qid.c AND l.turn = qid.t JOIN c m ON m.id = mid JOIN h_n x ON x.id = qid JOIN h_n y ON y.id = mid),
mem AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, query_turn ORDER BY score DESC, turn) AS INTEGER) AS rank FROM ms WHERE score >= 0.2) WHERE rank <= 3)"""


@query(f"WITH {MEMORY} SELECT conv_id, query_turn, turn, score, rank FROM mem")
def memory_recall(spark, folder):
    """The three earlier messages of a conversation most like its last question."""
    m = _messages(spark, folder)
    vectors = retrieval.hashed_vectors(m).select("id.conv_id", "id.turn", "vector")
    last = m.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return retrieval.recall_memory(vectors, vectors.join(last, ["conv_id", "turn"]), 3, 0.2)


HYBRID = f"""{MEMORY},
r AS (SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations) WHERE role = 'system' OR r <= 2),
hm AS (SELECT conv_id, turn FROM r UNION SELECT conv_id, turn FROM mem)"""


def _hybrid_memory(spark, folder):
    return conversation.hybrid_memory(_messages(spark, folder), memory_recall(spark, folder), 2)


@query(f"WITH {HYBRID} SELECT conv_id, turn FROM hm")
def hybrid_memory(spark, folder):
    return _hybrid_memory(spark, folder).select("conv_id", "turn")


@query(f"WITH {HYBRID} SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context_md5, count(*) AS n_turns FROM hm JOIN conversations USING (conv_id, turn) GROUP BY conv_id")
def memory_context(spark, folder):
    """What is recalled, put into the context at its place before the newest messages."""
    return conversation.context(_hybrid_memory(spark, folder)).select("conv_id", F.md5("context").alias("context_md5"), "n_turns")


@query(r"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
c AS (SELECT id, concat('0x', substring(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT id, CAST(bucket AS INTEGER) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM c""")
def hashed_embedding(spark, folder):
    return retrieval.hashed_embedding(_corpus(spark, folder))


#: An item's relevant documents hold a run of 8 of its tokens.
JUDGED = r"""
js AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT item_id AS item, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
jd AS (
  SELECT DISTINCT doc, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
j AS (SELECT DISTINCT item AS query_id, doc AS item_id FROM js JOIN jd USING (s))"""


def judged(spark, folder):
    """query_id, item_id, rel: documents with a run of 8 tokens of the item."""
    found = retrieval.shared_runs(_queries(spark, folder), _corpus(spark, folder), 8)
    return keep(found).withColumn("rel", F.lit(1))  # few rows, that the metrics read more than once


def _metrics(hits, k):
    return f"""
tot AS (SELECT query_id, count(*) AS n_rel FROM j GROUP BY query_id),
idl AS (SELECT query_id, n_rel, (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, least(n_rel, {k}) + 1) g(i)) AS idcg FROM tot),
own AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM {hits} JOIN j USING (query_id, item_id) WHERE rank <= {k} GROUP BY query_id),
m AS (
  SELECT b.item_id AS query_id, round(coalesce(found, 0)::DOUBLE / n_rel, 6) AS recall, round(coalesce(found, 0) / {k}.0::DOUBLE, 6) AS precision,
    round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(CASE WHEN n_rel IS NOT NULL THEN coalesce(dcg, 0) / idcg END, 6) AS ndcg
  FROM benchmark b LEFT JOIN idl ON idl.query_id = b.item_id LEFT JOIN own ON own.query_id = b.item_id)"""


def metrics(spark, folder, hits, k=10, relevant=None):
    return evaluation.retrieval_metrics(hits, judged(spark, folder) if relevant is None else relevant, _queries(spark, folder).select(F.col("id").alias("query_id")), k)


@query(f"WITH {BM25}, {_top('t', 10)}, {JUDGED}, {_metrics('t', 10)} SELECT * FROM m")
def retrieval_metrics(spark, folder):
    return metrics(spark, folder, bm25(spark, folder))


@query(f"""WITH {RERANK}, {JUDGED}, {_metrics('(SELECT * FROM t WHERE rank <= 5)', 5)},
own2 AS (SELECT query_id, min(rank) AS first FROM rr JOIN j USING (query_id, item_id) GROUP BY query_id)
SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / own2.first, 0) - m.rr), 5) AS rr_gain FROM m LEFT JOIN own2 USING (query_id)""")
def rerank_gain(spark, folder):
    first, relevant = bm25(spark, folder, 20), judged(spark, folder)
    before = metrics(spark, folder, first, 5, relevant).select("query_id", F.col("rr").alias("a"))
    after = metrics(spark, folder, retrieval.rerank(first, _queries(spark, folder), _corpus(spark, folder)), 5, relevant).select("query_id", F.col("rr").alias("b"))
    return before.join(after, "query_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 5).alias("rr_gain"))


@query(f"""WITH {BM25}, {_top('t', 10)}
SELECT b.item_id AS query_id, CASE WHEN best >= 30 THEN 'retrieval' ELSE 'fallback' END AS answer_source
FROM benchmark b LEFT JOIN (SELECT query_id, max(score) AS best FROM t GROUP BY query_id) x ON x.query_id = b.item_id""")
def with_fallback(spark, folder):
    return retrieval.with_fallback(_queries(spark, folder), bm25(spark, folder), 30.0)


@query(f"""WITH {BM25}, {_top('t', 10)},
c AS (SELECT t.*, text, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS k FROM t JOIN documents ON doc_id = item_id),
s AS (SELECT *, sum(k) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM c)
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, CAST(sum(k) AS BIGINT) AS n_tokens FROM s WHERE so_far <= 1000 GROUP BY query_id""")
def context_budget(spark, folder):
    return retrieval.context_budget(bm25(spark, folder), _corpus(spark, folder), 1000)


def _snapshots(spark, folder):
    """The index before (labelled documents; those of low quality had another text) and the documents now (without the toxic ones)."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    old = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("quality") == 0, upper(F.col("text"))).otherwise(F.col("text"))).alias("hash"))
    new = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    return new, old


SNAPSHOTS = """
o AS (SELECT doc_id AS id, md5(CASE WHEN quality = 0 THEN upper(text) ELSE text END) AS hash FROM documents JOIN labels USING (doc_id)),
n AS (SELECT doc_id AS id, md5(text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(f"""WITH {SNAPSHOTS}
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS action
FROM n FULL JOIN o ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL OR n.hash <> o.hash""")
def incremental_diff(spark, folder):
    return index_diff(*_snapshots(spark, folder))


@query(f"WITH {SNAPSHOTS} SELECT id, hash FROM n")
def index_apply(spark, folder):
    new, old = _snapshots(spark, folder)
    return apply_diff(new, old, index_diff(new, old))


CHUNKS = {
    "fixed": "SELECT doc_id, i AS chunk_no, substring(text, CAST(i * 450 + 1 AS BIGINT), 500) AS t FROM documents, LATERAL (SELECT unnest(range(0, greatest(CAST(floor((length(text) - 51) / 450.0) AS BIGINT), 0) + 1)) AS i) WHERE length(text) > 0",
    "structural": r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, t FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM documents)) WHERE length(trim(t)) > 0",
    "lines": "SELECT doc_id, chunk_no, text AS t FROM line_chunks",
    "recursive": "SELECT doc_id, chunk_no, text AS t FROM recursive_chunks",
}


def _chunk_hits(strategy):
    """CTEs of the ten best documents of each query by their best chunk."""
    s = strategy
    return rf"""
{s}_c AS ({CHUNKS[s]}),
{s}_d AS (SELECT {{'d': doc_id, 'c': chunk_no}} AS item_id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM {s}_c),
{s}_st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM {s}_d),
{s}_p AS (SELECT item_id, dl, term, count(*)::DOUBLE AS tf FROM (SELECT item_id, len(w) AS dl, unnest(w) AS term FROM {s}_d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
{s}_f AS (SELECT term, count(*)::DOUBLE AS df FROM {s}_p GROUP BY term),
{s}_sc AS (
  SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN {s}_f USING (term) JOIN {s}_p USING (term), {s}_st GROUP BY query_id, item_id),
{s}_b AS (SELECT query_id, item_id.d AS item_id, max(score) AS score FROM {s}_sc GROUP BY ALL),
{_top(s + '_h', 10, s + '_b')},
{_metrics(s + '_h', 10).replace('tot AS', s + '_tot AS').replace('FROM tot', f'FROM {s}_tot').replace('idl AS', s + '_idl AS').replace('JOIN idl ON idl.', f'JOIN {s}_idl ON {s}_idl.').replace('own AS', s + '_own AS').replace('JOIN own ON own.', f'JOIN {s}_own ON {s}_own.').replace('m AS (', s + '_m AS (')}"""


def _chunker_sql():
    rows = " UNION ALL ".join(f"SELECT '{s}' AS strategy, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(rr), 5) AS rr, round(avg(ndcg), 5) AS ndcg FROM {s}_m" for s in CHUNKS)
    return f"WITH {RECURSIVE_CHUNKS}, {LINE_CHUNKS}, {BM25}, {JUDGED}, {', '.join(_chunk_hits(s) for s in CHUNKS)} {rows}"


@query(_chunker_sql())
def chunker_compare(spark, folder):
    """Each chunking strategy by how well the chunks are found: mean metrics of documents ranked by their best chunk."""
    docs, queries, out = table(spark, folder, "documents"), _queries(spark, folder), None
    relevant = judged(spark, folder)
    for strategy in CHUNKS:
        chunks = chunk(docs, strategy).where(F.length(F.trim("text")) > 0).select(F.col("doc_id").alias("id"), "text")
        best = retrieval.bm25_topk(queries, chunks, 10, parts=True)
        found = evaluation.retrieval_metrics(best, relevant, queries.select(F.col("id").alias("query_id")))
        part = found.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "rr", "ndcg"))).select(F.lit(strategy).alias("strategy"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(r"""WITH c AS (SELECT doc_id, i AS chunk_no, substring(text, CAST(i * 450 + 1 AS BIGINT), 500) AS t FROM documents, LATERAL (SELECT unnest(range(0, greatest(CAST(floor((length(text) - 51) / 450.0) AS BIGINT), 0) + 1)) AS i) WHERE length(text) > 0),
w AS (SELECT doc_id, chunk_no, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM c)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(concat('0x', substring(md5(term), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, count(*)::DOUBLE AS n FROM w GROUP BY ALL""")
def encode_chunks(spark, folder):
    """Chunks encoded in batches; the encoder stands in for a sentence model."""
    chunks = chunk(table(spark, folder, "documents"), "fixed").withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    coded = retrieval.encode_batches(chunks, retrieval.hashing_encoder())
    return coded.select("doc_id", "chunk_no", F.posexplode("vector").alias("bucket", "n")).where("n > 0").withColumn("n", F.col("n").cast("double"))


@query(f"""WITH {BM25}, {_top('t', 10)}, {JUDGED}, {_metrics('t', 10)}
SELECT CAST(date_trunc('day', TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * query_id) AS TIMESTAMP) AS start, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(rr), 5) AS rr FROM m GROUP BY 1""")
def retrieval_over_time(spark, folder):
    """The metrics of retrieval by day; the queries stand in for questions that came in one an hour."""
    m = metrics(spark, folder, bm25(spark, folder)).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.col("query_id").cast("int")))
    return evaluation.over_time(m, "1 day", ["recall", "rr"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT vec_id AS id, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE vec_id % 5 <> 0""")
def vector_store_apply(spark, folder):
    """The next version of a store of vectors: some are new, some have changed, some are gone."""
    v = _vectors(spark, folder).select("id", "vector").withColumn("hash", F.xxhash64("vector").cast("string"))
    turned = F.transform("vector", lambda x: -x)
    old = v.where("id % 3 != 0").withColumn("vector", F.when(F.col("id") % 7 == 0, turned).otherwise(F.col("vector"))).withColumn("hash", F.xxhash64("vector").cast("string"))
    new = v.where("id % 5 != 0")
    return apply_diff(new, old, index_diff(new, old)).select("id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))
