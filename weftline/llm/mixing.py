"""Mixing sources to target weights by blocks.

The words of each source form one stream, cut into blocks of ``BLOCK`` words.
The output is a row of slots, a block each, in strata of about ``STRATUM`` slots
that hold each source in proportion, and in these in shards of ``SHARD`` slots.
How many slots each source has in a shard is a multinomial draw, conditioned on
each source's total in the stratum (that is, multivariate hypergeometric), so
that the whole mix meets the targets. A shard finds its draw, and the slots of
each source before it, by descending a tree of seeded splits; shards need not
know each other. The j-th slot of a source holds the block with index
p(j mod blocks), where p is a pseudorandom permutation of the source's blocks
for each round j div blocks; the blocks are then joined by source and index.

Rows that are equal in source, doc_id and text are one record with a count,
and records have their place in the stream by hash, so neither depends on how
rows are dealt, and no id, null or not, gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .words import Words, chunks, mix, space_table

BLOCK = 64
SHARD = 4096
STRATUM = 1 << 26
SEED = 20240611
#: A source's words are taken at most so many times.
MOST = 3
#: Records of one source in one group of the stream, and groups in one group of groups.
GROUP_ROWS = 2_000
GROUPS = 1_024
#: Sources up to which their table is broadcast, at under 100 bytes and a name each.
BROADCAST_SOURCES = 10_000


def _sizes(batches):
    table = space_table()
    for batch in batches:
        n = [np.zeros(0, np.int64), *(Words(data, off, table).counts for _, _, data, off in chunks(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "text_hash")), pa.array(np.concatenate(n).astype(np.int64))], ["doc_id", "source", "text_hash", "size"])


def targets(sizes: list[int]) -> list[float]:
    """Words to take from each source, in order: shares of the sum by weights 1, 2, 3, repeating, none above MOST times the size."""
    weight = np.array([i % 3 + 1 for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), size.sum()
    while open_.any() and left > 0:
        share = np.where(open_, left * weight / weight[open_].sum(), 0)
        full = open_ & (share > MOST * size)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = MOST * size[full]
        left -= MOST * size[full].sum()
        open_ &= ~full
    return out.tolist()


def strata(slots: np.ndarray) -> int:
    """In how many strata the slots are dealt."""
    return max(1, -(-int(slots.sum()) // STRATUM))


def quotas(slots: np.ndarray, stratum: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the strata before, and in this one), in proportion."""
    n = strata(slots)
    upto = lambda i: np.array([int(s) * i // n for s in slots.tolist()], np.int64)  # noqa: E731  exact at any size
    before = upto(stratum)
    return before, upto(stratum + 1) - before


def shard_counts(slots: np.ndarray, stratum: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard of the stratum, slots of each source in it)."""
    before, counts = quotas(slots, stratum)
    lo, hi = 0, -(-int(counts.sum()) // SHARD)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([SEED, stratum, lo, hi]).multivariate_hypergeometric(counts, (mid - lo) * SHARD, method="marginals")
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return before, counts


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n) at the places i: a Feistel network, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(6):
            left, right = right, left ^ (mix(right + np.uint64((key * 31 + r * 0x9E3779B97F4A7C15) % 2**64)) & low)
        out[todo] = x = (left << np.uint64(half)) | right
        todo = todo[x >= n]
    return out.astype(np.int64)


def _slots(slots: np.ndarray, blocks: np.ndarray, shards: int):
    """Rows of slots from shard numbers; each stratum has ``shards`` of them, of which the last may be empty."""

    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                stratum, own_shard = divmod(shard, shards)
                if own_shard * SHARD >= int(quotas(slots, stratum)[1].sum()):
                    continue
                before, counts = shard_counts(slots, stratum, own_shard)
                source = np.repeat(np.arange(len(counts)), counts)
                j = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + c) for b, c in zip(before, counts, strict=True))])
                block = np.zeros(len(j), np.int64)
                turn = j // np.maximum(blocks[source], 1)
                for k in np.unique(source):
                    for t in np.unique(turn[source == k]):
                        own = (source == k) & (turn == t)
                        block[own] = permuted(j[own] % blocks[k], int(blocks[k]), SEED + 1_000_003 * int(k) + int(t))
                place = permuted(np.arange(len(j)), len(j), SEED ^ (shard + 1)) if len(j) else j
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard)), pa.array(place), pa.array(source), pa.array(block)], ["shard", "slot", "source_no", "block"])

    return run


def _placed(records: DataFrame, groups: int) -> DataFrame:
    """records with ``at``, the word of their source's stream where they begin: sums by group of groups, by group, and inside the group."""
    records = records.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups))).withColumn("top", F.floor(F.col("grp") / GROUPS))
    until = lambda keys, order, value: F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    group = keep(records.groupBy("source_no", "top", "grp").agg(F.sum("all").alias("all")))
    tops = group.groupBy("source_no", "top").agg(F.sum("all").alias("all"))
    tops = tops.select("source_no", "top", until(["source_no"], ["top"], "all").alias("a"))
    group = group.select("source_no", "top", "grp", until(["source_no", "top"], ["grp"], "all").alias("b"))
    before = group.join(tops, ["source_no", "top"]).select("source_no", "grp", (F.col("a") + F.col("b")).alias("before"))
    inside = records.withColumn("inside", until(["source_no", "grp"], ["doc_id", "size", "text_hash"], "all"))
    return inside.join(before, ["source_no", "grp"]).withColumn("at", F.col("before") + F.col("inside")).drop("grp", "top", "inside", "before")


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: id, doc_id, source, size, source_size, target, one row per row
    of docs (id: the record and its copy); pieces: id, doc_id, source_no, block,
    start (word of the document), n; slots: shard, slot, source_no, block. Null
    and empty texts have size 0; a null source comes last; a null doc_id is an
    id like others. The driver holds one number for each source.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    sized = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sizes, "doc_id long, source string, text_hash long, size long")
    # equal texts have equal sizes: each of these is a record, and n rows
    records = keep(sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies")))
    keyed = records.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = sorted(keyed.groupBy("key").agg(F.sum("all"), F.count("*")).collect(), key=lambda r: (r[0][0] == "n", r[0]))
    sizes = [r[1] for r in rows]
    want = targets(sizes)
    blocks = np.array([-(-s // BLOCK) for s in sizes], np.int64)
    slots = np.array([min(MOST * int(b), round(t * int(b) / s)) if s else 0 for t, b, s in zip(want, blocks, sizes, strict=True)], np.int64)
    known = spark.createDataFrame([(r[0], i, r[1], float(t)) for i, (r, t) in enumerate(zip(rows, want, strict=True))], "key string, source_no long, source_size long, target double")
    base = keyed.join(F.broadcast(known) if len(rows) <= BROADCAST_SOURCES else known, "key", "left").drop("key")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    ident = F.struct("source_no", "doc_id", "text_hash", "copy").alias("id")
    documents = base.select("*", copy).select(ident, "doc_id", "source", "size", "source_size", "target")
    groups = max(1, -(-sum(r[2] for r in rows) // GROUP_ROWS))
    placed = _placed(base.where("size > 0"), groups).select("*", copy).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    pieces = placed.select(ident, "doc_id", "source_no", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))).alias("block"))
    start = F.greatest(F.col("block") * BLOCK - F.col("at"), F.lit(0))
    pieces = pieces.select("id", "doc_id", "source_no", "block", start.alias("start"), (F.least((F.col("block") + 1) * BLOCK - F.col("at"), F.col("size")) - start).alias("n"))
    n = strata(slots)
    shards = -(-(-(-int(slots.sum()) // n) + len(slots)) // SHARD)  # quotas are rounded
    slot_rows = spark.range(n * shards).mapInArrow(_slots(slots, blocks, shards), "shard long, slot long, source_no long, block long")
    return documents, pieces, slot_rows


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, doc_id, start and n, the words of documents in each slot's block."""
    _, pieces, slots = plan(docs)
    return slots.hint("merge").join(pieces, ["source_no", "block"]).select("shard", "slot", "doc_id", "start", "n")


def taken(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target (of the source) and taken, the words the mix has of it.

    Repeated rows are documents of their own; which of them the mix takes more
    of is not said, as they are equal. No docs give no rows.
    """
    documents, pieces, slots = plan(docs)
    # the slots come from a small range, which tells Spark nothing of their number: no broadcast
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    used = pieces.join(times, ["source_no", "block"]).groupBy("id").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    both = documents.join(used, documents["id"].eqNullSafe(used["id"]), "left")
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
