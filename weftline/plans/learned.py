"""Moderation and quality by models trained on labels, beside the fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, safety, text
from ..sources.shared import among, keep
from ..sources.tables import table
from .registry import query


def _compared(docs, labels, model, rules, with_clues=False):
    """method and confusion on the test fold, which neither the weights nor the threshold has seen. rules(docs): doc_id, flagged."""
    test = keep(labels.where(learning.folds(F.col("doc_id")) == "test").select("doc_id", "y"))
    own = among(docs, test, "doc_id")
    found = {"trained": learning.judge(own, *model, with_clues), "rules": rules(own)}
    parts = [learning.confusion(f.select("doc_id", "flagged").join(test, "doc_id"), F.col("flagged")).select(F.lit(m).alias("method"), "*") for m, f in found.items()]
    return parts[0].unionByName(parts[1])


@query()
def moderation_trained(spark, folder):
    """Toxic documents of the test fold as found by a trained model and by the word list."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").withColumn("y", F.col("toxic"))
    return _compared(docs, labels, learning.trained(docs, labels), safety.moderate)


@query()
def quality_trained(spark, folder):
    """Good documents of the test fold as found by a trained model and by the quality rules."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").withColumn("y", F.col("quality"))
    rules = lambda own: text.quality_filter(own).select("doc_id", F.col("reason").isNull().alias("flagged"))
    return _compared(docs, labels, learning.trained(docs, labels, with_clues=True), rules, True)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, concat('0x', substring(md5(term), 1, 8))::BIGINT % 16384 AS b FROM (SELECT doc_id, unnest(w) AS term FROM t))
SELECT d.doc_id, count(b) AS n_features, CAST(coalesce(sum(b), 0) AS BIGINT) AS bucket_sum, CASE WHEN concat('0x', substring(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 6 THEN 'train'
  WHEN concat('0x', substring(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 8 THEN 'tune' ELSE 'test' END AS fold
FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def training_features(spark, folder):
    """The features and the fold of every document, as the models see them."""
    f = table(spark, folder, "documents").select("doc_id", learning.hashed_terms(F.col("text"), 1 << 14).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n_features"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("bucket_sum"), learning.folds(F.col("doc_id")).alias("fold"))
