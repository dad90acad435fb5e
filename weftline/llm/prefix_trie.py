"""The prefix trie of conversations, from the LCP array of their sorted sequences.

A turn is a digest of 16 bytes of its role and text; a conversation is a sequence
of them. Equal sequences are one record with a count and their least conv_id.
The records are sorted over all tasks by range, and ``lcp[i]`` is the number of
first turns that records i - 1 and i share (-1 before the first and after the
last). The Cartesian tree over this array is the trie without its single-child
nodes: the subtree at i spans the records between the nearest smaller values of
lcp[i] on both sides.

Those come from parallel all-nearest-smaller-values. A sorted partition is a
block. A stack finds the values inside a block; for what is left, a block's
minimum, one number a block, says in which block the value lies, and there it is
one of the minima met from that block's edge, which a join by block and value
finds. Values of a block that ask for the same are one question, so texts
without a common turn, however many, ask once for each block.

Positions of the array with the same span are one node. A node's span gives its
sums as differences of running sums over the records, and its least conv_id as
the least of the minima met on the way to both of its ends. At last the depths
that have one child only are written out between a node and its parent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Bytes of a turn's digest.
DIGEST = 16
#: Records of a block, at some hundred bytes in memory; fewer while there are idle cores.
BLOCK = 100_000
LEAST_BLOCK = 1_000
NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of at, digest in hex, bytes of the text) of conversations (conv_id, turn, role, text).

    Turns go by turn with nulls first, then role and text; a null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text")).where("conv_id is not null")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    turn = F.struct("at", F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return rows.withColumn("at", at).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def branched(found: DataFrame) -> DataFrame:
    """sequences() rebuilt as branches: the first h turns of conversation c - c % 5, then c's own after its first h; h is crc32 of c in decimal, modulo 9."""
    found = keep(found)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = found.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    own = found.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"), "turns")
    both = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns") + 1)).alias("turns"))


def _ends(batches):
    """Digests of the sorted conv_ids of each sequence, as a stream of rows sorted by (seq, conv_id)."""
    seq, sha = None, None
    for batch in batches:
        out = []
        for s, c in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if s == seq:
                sha.update(b",%d" % c)
                continue
            if seq is not None:
                out.append((seq, sha.hexdigest()))
            seq, sha = s, hashlib.sha256(b"%d" % c)
        yield _two(out)
    yield _two([(seq, sha.hexdigest())] if seq is not None else [])


def _two(out):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["seq", "ends"])


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // DIGEST


_RECORD = "block long, at long, lcp long, size long, total long, shared long, n long, least long, ends string, upto array<long>, key binary"


def _lcps(batches):
    """Sorted records with their place in the block and what they share with the record before; upto: bytes of the first 0, 1, ... turns."""
    block, at, before = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        lists = [np.concatenate([[0], np.cumsum(np.asarray(b, np.int64))]).astype(np.int64) for b in batch.column("bytes").to_pylist()]
        lcp = [None] * len(keys)
        for i, k in enumerate(keys):
            if before is not None:
                lcp[i] = shared_turns(before, k)
            before = k
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [long([block] * len(keys)), long(range(at, at + len(keys))), long(lcp), long([len(x) - 1 for x in lists]), long([int(x[-1]) for x in lists])]
            + [long([None if v is None else int(x[v]) for v, x in zip(lcp, lists, strict=True)]), *(batch.column(c) for c in ("n", "least", "ends"))]
            + [pa.array(lists, pa.list_(pa.int64())), batch.column("key")],
            ["block", "at", "lcp", "size", "total", "shared", "n", "least", "ends", "upto", "key"],
        )
        at += len(keys)


def _edges(batches):
    """(block, rows, lcp, shared) of each block's first record, from its key and that of the last record before."""
    for batch in batches:
        rows = batch.to_pylist()
        lcp = [-1 if r["before"] is None else shared_turns(r["before"], r["first"]) for r in rows]
        shared = [0 if v < 0 else r["upto"][v] for v, r in zip(lcp, rows, strict=True)]
        cols = [[r["block"] for r in rows], [r["rows"] for r in rows], lcp, shared]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["block", "rows", "lcp", "shared"])


SUMS = ("n", "total", "new", "leaf")


class _Block:
    """A block's columns in numpy, its first record's lcp filled in."""

    def __init__(self, table: pa.Table, known: dict):
        col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        self.no = int(col("block")[0])
        b = self.b = int(np.searchsorted(known["block"], self.no))
        fill = lambda c, v: np.concatenate([[v], table.column(c).slice(1).to_numpy(zero_copy_only=False)]).astype(np.int64)
        self.lcp, shared = fill("lcp", known["lcp"][b]), fill("shared", known["shared"][b])
        self.size, total, n, self.least = (col(c).astype(np.int64) for c in ("size", "total", "n", "least"))
        after = known["lcp"][b + 1] if b + 1 < len(known["lcp"]) else -1
        self.next = np.append(self.lcp[1:], after)
        new = total - shared
        self.each = {"n": n, "total": n * total, "new": new, "leaf": (self.size > np.maximum(self.lcp, self.next)).astype(np.int64)}
        self.own_total, self.new = total, new
        self.start = int(known["start"][b])

    def before(self, known: dict) -> dict[str, np.ndarray]:
        """Running sums over all records before each of this block's, and after its last."""
        return {k: known[f"{k}_before"][self.b] + np.concatenate([[0], np.cumsum(v)]) for k, v in self.each.items()}


def _whole(batches) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


_STATS = ("block", "least_lcp", "last_lcp", "least", *SUMS)


def _stats(known):
    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        x = _Block(table, known)
        row = (x.no, x.lcp.min(), x.lcp[-1], x.least.min(), *(x.each[k].sum() for k in SUMS))
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in row], list(_STATS))

    return run


_WALL = ("side", "block", "v", "place", "lcp", *SUMS, "least")


def _walls(known):
    """What other blocks may ask of a block: for each side and value, the first smaller value met from that side, and the least conv_id up to there."""

    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        x = _Block(table, known)
        sums, out, n = x.before(known), [], len(x.lcp)
        for side, order in ((0, range(n - 1, -1, -1)), (1, range(n))):
            low, least = None, NONE
            for j in order:
                v = int(x.lcp[j])
                if side == 0:  # looked for from the right: the span begins with record j
                    least = min(least, int(x.least[j]))
                if low is None or v < low:
                    row = [j + x.start, v, *(int(sums[k][j]) for k in SUMS), least]
                    out += [(side, x.no, ask, *row) for ask in range(v + 1, (v + 1 if low is None else low) + 1)]
                    low = v
                if side == 1:  # and ends before it
                    least = min(least, int(x.least[j]))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_WALL))

    return run


def _nearest(lcp: list[int], least: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(left, its least, right, its least): places of the nearest smaller values, -1 and n if there is none, and the minima of the records from there to each place."""
    n = len(lcp)
    left, low_left, right, low_right = [0] * n, [NONE] * n, [0] * n, [NONE] * n
    for i in range(n):
        j, low = i - 1, least[i - 1] if i else NONE
        while j >= 0 and lcp[j] >= lcp[i]:
            low = min(low, low_left[j])
            j = left[j]
        left[i], low_left[i] = j, low
    for i in range(n - 1, -1, -1):
        j, low = i + 1, least[i]
        while j < n and lcp[j] >= lcp[i]:
            low = min(low, low_right[j])
            j = right[j]
        right[i], low_right[i] = j, low
    return left, low_left, right, low_right


_SPAN_SIDE = ("place", "lcp", *SUMS, "least")
_SPAN = ("block", "i", "v", "next", "size", "own_total", "own_new", "own_n", "own_least", *(f"{s}_{c}" for s in ("left", "right") for c in _SPAN_SIDE))


def _spans(known):
    """For every record its lcp's nearest smaller values as far as the block has them; null places are asked for elsewhere."""

    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        x = _Block(table, known)
        sums, n = x.before(known), len(x.lcp)
        left, low_left, right, low_right = _nearest(x.lcp.tolist(), x.least.tolist())
        cols = [np.full(n, x.no), x.start + np.arange(n), x.lcp, x.next, x.size, x.own_total, x.new, x.each["n"], x.least]
        arrays = [pa.array(c, pa.int64()) for c in cols]
        for place, low in ((np.array(left), low_left), (np.array(right), low_right)):
            unknown = (place < 0) | (place >= n)
            at = np.where(unknown, 0, place)
            found = [at + x.start, x.lcp[at], *(sums[k][at] for k in SUMS)]
            arrays += [pa.array(c, pa.int64(), mask=unknown) for c in found] + [pa.array(low, pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, *(table.column(c).combine_chunks() for c in ("ends", "upto"))], [*_SPAN, "ends", "upto"])

    return run


_ASK = ("side", "block", "v", "wall_block", "wall_v", "between")


def _asks(known):
    """One question for each side and value that a block can't answer: the block to ask, the value to look up there, and the least conv_id of the blocks between."""

    def run(batches):
        table = _whole(batches)
        if table is None:
            return
        x = _Block(table, known)
        out, ids, lows = [], known["block"], known["least_lcp"]
        forward, backward = np.minimum.accumulate(x.lcp), np.minimum.accumulate(x.lcp[::-1])
        for v in np.unique(forward).tolist():
            if v >= 0:  # the first record's -1 has nothing smaller before it
                t = int(np.flatnonzero(lows[: x.b] < v)[-1]) if x.b else -1
                if t >= 0:
                    out.append((0, x.no, v, int(ids[t]), min(v, int(known["last_lcp"][t]) + 1), int(known["least"][t + 1 : x.b].min(initial=NONE))))
        for v in np.unique(backward).tolist():
            if v >= 0:
                later = np.flatnonzero(lows[x.b + 1 :] < v)
                t = x.b + 1 + int(later[0]) if len(later) else -1
                between = known["least"][x.b + 1 : t if t >= 0 else None]
                out.append((1, x.no, v, int(ids[t]) if t >= 0 else -1, min(v, int(known["lcp"][t]) + 1) if t >= 0 else -1, int(between.min(initial=NONE))))
        cols = list(zip(*out, strict=True)) or [[]] * len(_ASK)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_ASK))

    return run


def _longs(names) -> str:
    return ", ".join(f"{c} long" for c in names)


def records(found: DataFrame) -> DataFrame:
    """The distinct sequences in order: block, at, lcp (null for a block's first), size, total, shared, n, least, ends, upto, key."""
    spark = found.sparkSession
    digests = F.transform("turns", lambda t: t["digest"])
    keyed = keep(found.select("conv_id", F.unhex(F.array_join(digests, "")).alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")))
    seq = F.substring(F.sha2("key", 256), 1, 2 * DIGEST).alias("seq")
    ends = keyed.select(seq, "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ends, "seq string, ends string")
    one = keyed.groupBy("key", "bytes").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    one = keep(one.withColumn("seq", seq).join(ends, "seq").drop("seq"))
    many = one.count()
    blocks = max(-(-many // BLOCK), min(spark.sparkContext.defaultParallelism, many // LEAST_BLOCK), 1)
    ordered = one.repartitionByRange(blocks, "key").sortWithinPartitions("key")
    return keep(ordered.mapInArrow(_lcps, _RECORD))


def _known(rows: DataFrame) -> dict:
    """What every task needs to know of all blocks: a dozen numbers for each."""
    edge = rows.groupBy("block").agg(F.count("*").alias("rows"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.min_by("upto", "at").alias("upto"))
    edge = edge.withColumn("before", F.lag("last").over(Window.orderBy("block"))).select("block", "rows", "first", "before", "upto")
    found = sorted(edge.mapInArrow(_edges, "block long, rows long, lcp long, shared long").collect())
    known = {k: np.array([r[i] for r in found], np.int64) for i, k in enumerate(("block", "rows", "lcp", "shared"))}
    known["start"] = np.concatenate([[0], np.cumsum(known["rows"])]).astype(np.int64)
    known |= {f"{k}_before": np.zeros(len(found) + 1, np.int64) for k in SUMS}
    stats = sorted(rows.drop("key").mapInArrow(_stats(known), _longs(_STATS)).collect())
    of = {k: np.array([r[i] for r in stats], np.int64) for i, k in enumerate(_STATS)}
    known |= {k: of[k] for k in ("least_lcp", "last_lcp", "least")}
    return known | {f"{k}_before": np.concatenate([[0], np.cumsum(of[k])]).astype(np.int64) for k in SUMS}


def _answered(rows: DataFrame, known: dict) -> DataFrame:
    """_spans() rows with both sides known: left_place, left_lcp, ..., and least, the least conv_id of the span."""
    spark = rows.sparkSession
    slim = rows.drop("key")
    walls = slim.mapInArrow(_walls(known), _longs(_WALL))
    end = (1, -1, -1, int(known["start"][-1]), -1, *(int(known[f"{k}_before"][-1]) for k in SUMS), NONE)  # what stands after the last record
    walls = walls.union(spark.createDataFrame([end], _longs(_WALL)))
    asks = slim.mapInArrow(_asks(known), _longs(_ASK))
    asks = asks.join(walls.select("side", F.col("block").alias("wall_block"), F.col("v").alias("wall_v"), "place", "lcp", *SUMS, "least"), ["side", "wall_block", "wall_v"])
    asks = keep(asks.withColumn("least", F.least("least", "between")).select("side", "block", "v", *_SPAN_SIDE))
    spans = slim.mapInArrow(_spans(known), f"{_longs(_SPAN)}, ends string, upto array<long>")
    for side, name in ((0, "left"), (1, "right")):
        own = asks.where(F.col("side") == side).select("block", "v", *(F.col(c).alias(f"asked_{c}") for c in _SPAN_SIDE))
        spans = spans.join(own, ["block", "v"], "left")
        unknown = F.col(f"{name}_place").isNull()
        least = F.when(unknown, F.least(f"{name}_least", "asked_least")).otherwise(F.col(f"{name}_least"))
        spans = spans.withColumns({f"{name}_least": least} | {f"{name}_{c}": F.coalesce(f"{name}_{c}", f"asked_{c}") for c in _SPAN_SIDE if c != "least"})
        spans = spans.drop(*(f"asked_{c}" for c in _SPAN_SIDE))
    return keep(spans.withColumn("least", F.least("left_least", "right_least")))


def nodes(found: DataFrame) -> DataFrame:
    """The trie's nodes over sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct run of first turns; its members are the conversations
    that begin with it, and conv_id is the least of them. The root, of depth 0
    and without a text, has every conversation, those without turns too.
    saved_tokens adds up, over the node and all below it, the bytes of the
    node's last text for each member but one. ends_sha256 is of the conv_ids of
    the members that end there. No conversations give no nodes. A sequence, 16
    bytes for each turn, is one value of a row; nothing else is gathered.
    """
    rows = records(found)
    if not rows.head(1):
        return found.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    spans = _answered(rows, _known(rows))
    span = ("lo", "hi", "depth", "lcp_lo", "lcp_hi", "n", "leaves", "all_bytes", "new_bytes", "least")
    difference = lambda k: F.col(f"right_{k}") - F.col(f"left_{k}")
    inner = spans.where("i > 0").select(
        F.col("left_place").alias("lo"), F.col("right_place").alias("hi"), F.col("v").alias("depth"), F.col("left_lcp").alias("lcp_lo"), F.col("right_lcp").alias("lcp_hi"),
        difference("n").alias("n"), difference("leaf").alias("leaves"), difference("total").alias("all_bytes"), difference("new").alias("new_bytes"), "least",
    )
    inner = inner.groupBy(*span).agg(F.count("*").alias("splits"))
    leaf = spans.where("size > greatest(v, next)").select(
        F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"), F.col("size").alias("depth"), F.col("v").alias("lcp_lo"), F.col("next").alias("lcp_hi"),
        F.col("own_n").alias("n"), F.lit(1).cast("long").alias("leaves"), (F.col("own_n") * F.col("own_total")).alias("all_bytes"), F.col("own_new").alias("new_bytes"), F.col("own_least").alias("least"),
        F.lit(-1).cast("long").alias("splits"),
    )
    tree = inner.union(leaf).withColumn("above", F.greatest("lcp_lo", "lcp_hi")).withColumn("parent_at", F.when(F.col("lcp_lo") >= F.col("lcp_hi"), F.col("lo")).otherwise(F.col("hi")))
    tree = tree.join(spans.select(F.col("i").alias("lo"), "size", "own_total", "own_new", "ends", "upto"), "lo")
    tree = tree.join(spans.select(F.col("i").alias("parent_at"), F.col("least").alias("parent")), "parent_at", "left")
    # bytes of the turns before each depth's own, from the depth below the parent's
    before = F.when(F.col("above") < 0, F.concat(F.array(F.lit(0).cast("long")), F.slice("upto", F.lit(1), F.col("depth").cast("int")))).otherwise(F.slice("upto", (F.col("above") + 1).cast("int"), (F.col("depth") - F.col("above")).cast("int")))
    each = tree.select("*", F.posexplode(before).alias("step", "before")).withColumn("d", F.col("above") + 1 + F.col("step"))
    bottom = F.col("d") == F.col("depth")
    children = F.when(~bottom, 1).when(F.col("splits") < 0, 0).otherwise(F.col("splits") + 1 - (F.col("size") == F.col("depth")).cast("long"))
    once = F.col("new_bytes") - F.col("own_new") + F.col("own_total") - F.col("before")
    return each.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("step") > 0, F.col("least")).when(F.col("above") >= 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        children.cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("all_bytes") - F.col("n") * F.col("before") - once).alias("saved_tokens"),
        F.when(bottom & (F.col("size") == F.col("depth")), F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
