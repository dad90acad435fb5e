"""Ranking by places of words: reranking by proximity, its gain, phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import prompts, proximity, quantised, subwords
from ..sources.shared import keep
from ..sources.tables import table
from .registry import query
from .search import _COSINE, BM25, JUDGED, VECTORS, _corpus, _metrics, _queries, _top, _vectors, bm25, judged, metrics

#: CTEs of the smallest span of each of the 20 best documents: for each place of a term, the last place of every other.
SPANS = rf"""{BM25}, {_top('t', 20)},
qn AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY query_id),
w AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE doc_id IN (SELECT item_id FROM t)),
pos AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM w),
own AS (SELECT t.query_id, t.item_id, pos.term, place FROM t JOIN q USING (query_id) JOIN pos ON pos.item_id = t.item_id AND pos.term = q.term),
nf AS (SELECT query_id, item_id, count(DISTINCT term) AS n_found FROM own GROUP BY ALL),
lasts AS (SELECT a.query_id, a.item_id, a.place, b.term, max(b.place) AS l FROM own a JOIN own b ON a.query_id = b.query_id AND a.item_id = b.item_id AND b.place <= a.place GROUP BY ALL),
ends AS (SELECT query_id, item_id, place - min(l) + 1 AS span, count(*) AS held FROM lasts GROUP BY query_id, item_id, place),
sp AS (SELECT query_id, item_id, n_found, min(span) FILTER (held = n_found) AS span FROM ends JOIN nf USING (query_id, item_id) GROUP BY ALL),
ps AS (
  SELECT t.query_id, t.item_id, coalesce(n_found, 0) AS n_found, span, t.score AS first_score,
    round(coalesce(n_found / n_terms::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * round(n_found / span::DOUBLE, 6)), 0), 6) AS score
  FROM t LEFT JOIN sp USING (query_id, item_id) JOIN qn USING (query_id)),
pr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_score DESC, item_id) AS INTEGER) AS rank FROM ps) WHERE rank <= 5)"""


def _reranked(spark, folder, hits=None):
    return proximity.proximity_rerank(bm25(spark, folder, 20) if hits is None else hits, _queries(spark, folder), _corpus(spark, folder))


@query(f"WITH {SPANS} SELECT query_id, item_id, CAST(n_found AS INTEGER) AS n_found, CAST(span AS INTEGER) AS span, score, rank FROM pr")
def proximity_rerank(spark, folder):
    """The best documents of each item again, by how near its words stand to each other."""
    return _reranked(spark, folder)


@query(f"""WITH {SPANS}, {JUDGED}, {_metrics('(SELECT * FROM t WHERE rank <= 5)', 5).replace('own AS', 'mine AS').replace('JOIN own ON own.', 'JOIN mine ON mine.')},
own2 AS (SELECT query_id, min(rank) AS first FROM pr JOIN j USING (query_id, item_id) GROUP BY query_id)
SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / own2.first, 0) - m.rr), 5) AS rr_gain FROM m LEFT JOIN own2 USING (query_id)""")
def proximity_gain(spark, folder):
    """Mean change of the reciprocal rank by reranking on proximity."""
    first, relevant = bm25(spark, folder, 20), judged(spark, folder)
    before = metrics(spark, folder, first, 5, relevant).select("query_id", F.col("rr").alias("a"))
    after = metrics(spark, folder, _reranked(spark, folder, first), 5, relevant).select("query_id", F.col("rr").alias("b"))
    return before.join(after, "query_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 5).alias("rr_gain"))


@query(r"""WITH b AS (SELECT item_id AS query_id, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1, 4) AS p FROM benchmark),
d AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT item_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s, k FROM d, (SELECT DISTINCT len(p) AS k FROM b), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k)
SELECT query_id, item_id, count(*) AS n FROM b JOIN g ON g.k = len(p) AND g.s = array_to_string(p, ' ') GROUP BY ALL""")
def phrase_hits(spark, folder):
    """Documents that hold the first four words of an item side by side."""
    heads = _queries(spark, folder).select("id", F.array_join(F.slice(tokens(F.col("text")), 1, 4), " ").alias("text"))
    return proximity.phrase_hits(heads, _corpus(spark, folder))


@query()
def pq_topk(spark, folder):
    """Nearest vectors by codes of 16 bytes; approximate, the tests hold its recall against brute force."""
    v = _vectors(spark, folder)
    return quantised.ProductIndex(v).topk(v.where("id % 50 = 0"))


@query(f"WITH {VECTORS}, sc AS (SELECT a.id AS query_id, b.id AS item_id, {_COSINE} AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id), {_top('t', 10)} SELECT * FROM t")
def pq_topk_exact(spark, folder):
    """Nearest vectors by codes and what these can be off by; exact."""
    v = _vectors(spark, folder)
    return quantised.ProductIndex(v).exact_topk(v.where("id % 50 = 0"))


MMR = rf"""{BM25}, {_top('t', 20)},
hw AS (SELECT query_id, item_id, t.rank, score / max(score) OVER (PARTITION BY query_id) AS rel, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS words FROM t JOIN documents ON doc_id = item_id),
-- every step takes the best of what is left, and what is left comes nearer to it
mm AS (
  SELECT query_id, item_id, rank, rel, words, 0.0::DOUBLE AS near, 0 AS step, CAST(NULL AS INTEGER) AS taken, CAST(NULL AS DOUBLE) AS gain FROM hw
  UNION ALL
  SELECT query_id, item_id, rank, rel, words, greatest(near, len(list_intersect(words, top.words)) / greatest(len(list_distinct(list_concat(words, top.words))), 1)::DOUBLE), step + 1,
    CASE WHEN taken IS NULL AND rank = top.rank THEN step + 1 ELSE taken END, CASE WHEN taken IS NULL AND rank = top.rank THEN top.gain ELSE gain END
  FROM (SELECT *, first_value({{'rank': rank, 'words': words, 'gain': own}}) OVER (PARTITION BY query_id ORDER BY taken IS NOT NULL, own DESC, rank) AS top
    FROM (SELECT *, round(0.5::DOUBLE * rel - 0.5::DOUBLE * near, 9) AS own FROM mm WHERE step < 5))),
dv AS (SELECT query_id, item_id, gain, taken AS rank FROM mm WHERE step = 5 AND taken IS NOT NULL)"""


def _diverse(spark, folder):
    return keep(prompts.diverse(bm25(spark, folder, 20), _corpus(spark, folder)))  # five rows an item, read more than once by what follows


@query(f"WITH RECURSIVE {MMR} SELECT query_id, item_id, round(gain, 6) AS gain, rank FROM dv")
def diverse_hits(spark, folder):
    """Five of the 20 best documents of each item, each unlike those before."""
    return _diverse(spark, folder).withColumn("gain", F.round("gain", 6))


_TEMPLATE = "Answer from the context.\n{constraints}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"


@query(rf"""WITH RECURSIVE {MMR},
pt AS (SELECT query_id, dv.rank, '[' || dv.rank || '] ' || text AS part FROM dv JOIN documents ON doc_id = item_id),
so AS (SELECT *, sum(len(regexp_extract_all(part, '[\p{{L}}\p{{N}}]+'))) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM pt),
ft AS (SELECT query_id, count(*) AS n_items, string_agg(part, chr(10) || chr(10) ORDER BY so.rank) AS context FROM so JOIN benchmark b ON b.item_id = query_id
  WHERE 9 + len(regexp_extract_all(b.text, '[\p{{L}}\p{{N}}]+')) + so_far <= 1500 GROUP BY query_id),
pp AS (SELECT b.item_id AS query_id, coalesce(n_items, 0) AS n_items,
  'Answer from the context.' || chr(10) || 'Be brief.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:' AS prompt
  FROM benchmark b LEFT JOIN ft ON ft.query_id = b.item_id)
SELECT query_id, md5(prompt) AS prompt_md5, n_items, len(regexp_extract_all(lower(prompt), '[\p{{L}}\p{{N}}]+')) AS n_tokens FROM pp""")
def prompt_assembly(spark, folder):
    """The prompt of every item: diverse context, question and constraints in 1,500 tokens."""
    out = prompts.assemble(_diverse(spark, folder), _queries(spark, folder), _corpus(spark, folder), _TEMPLATE, 1500, "Be brief.")
    return out.select("query_id", F.md5("prompt").alias("prompt_md5"), "n_items", "n_tokens")


# A vocabulary of frequent runs of letters; every letter is in it besides.
RUNS = (
    "al an and ar as at be ble ce ch co de de di ed el en ent er es est for ge ha he her hi ic ie ight in ing ion is it iti le ll ly ma me ment mi nd ne ng no nt of "
    "on one or ou our per pro ra re ri ro sh si so st str ta te ter th tha the ther ti tion to tr un ur us ve ver was wh with"
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH RECURSIVE v AS (SELECT DISTINCT p FROM (SELECT unnest(string_split('{RUNS}', ' ')) AS p UNION ALL SELECT unnest(string_split('{LETTERS}', '')))),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
c AS (
  SELECT word, 0 AS at_, '' AS pieces, 0 AS n FROM w
  UNION ALL
  SELECT word, at_ + len(p), pieces || CASE WHEN at_ = 0 THEN '' ELSE ' ##' END || p, n + 1
  FROM (SELECT c.*, (SELECT arg_max(p, len(p)) FROM v WHERE p = substr(word, at_ + 1, len(p))) AS p FROM c WHERE at_ < len(word)) WHERE p IS NOT NULL),
l AS (SELECT word, arg_max(pieces, at_) AS pieces, max(at_) AS reached FROM c GROUP BY word)
SELECT word, CASE WHEN reached = len(word) THEN pieces ELSE '[UNK]' END AS pieces FROM l""")
def wordpiece_words(spark, folder):
    """Every word of the documents in pieces by longest match."""
    pieces = [x for p in [*RUNS.split(), *LETTERS] for x in (p, f"##{p}")]
    vocabulary = spark.createDataFrame([(p,) for p in sorted(set(pieces))], "piece string")
    words = table(spark, folder, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return subwords.wordpiece(words, vocabulary).select("word", F.array_join("pieces", " ").alias("pieces"))


@query()
def unigram_words(spark, folder):
    """Every word of the documents in the pieces that add up to the best score; a run of letters scores the more the longer it is. The tests try all cuts."""
    vocabulary = spark.createDataFrame([(p, -10.0 + 1.5 * len(p)) for p in sorted({*RUNS.split(), *LETTERS})], "piece string, score double")
    words = table(spark, folder, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return subwords.unigram(words, vocabulary).select("word", F.array_join("pieces", " ").alias("pieces"), F.round("score", 6).alias("score"))
