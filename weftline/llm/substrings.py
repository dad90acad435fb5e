"""Removal of long repeated word spans by compaction of a k-mer graph.

1. Word k-mers are sampled by minimizers: of every ``window - KMER + 1``
   consecutive k-mers the one with the smallest hash. Equal windows hold equal
   minimizers, so a window can only repeat if its minimizer does.
2. Minimizers that stand in more than one document mark the stretches of text
   that may repeat. There every window becomes an edge of a De Bruijn graph: it
   leads from the node of its first ``window - 1`` words to that of its last
   ones. Edges of one word sequence are one edge, which carries the smallest
   coordinate (document, word) at which it stands.
3. Of the edges that stand in several documents, those that meet at a node with
   one edge in and one out follow one another, if their coordinates do too. A
   join on the nodes finds these places; what lies between the others is a
   nonbranching path, with a source document and a first word there.
4. A run of a document's windows along a path is a span (document, start,
   length; source document, source start). The two sides of each span are read
   back from the texts at their coordinates and compared word by word before
   anything is removed.

Whole documents with equal words are reduced to the one with the smallest
doc_id before step 1: each copy's windows all start in that one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import having, keep
from .words import Words, chunks, cover, signed, space_table, span_hashes

#: Words of a sampled k-mer; the longer, the fewer windows that share one but do not repeat.
KMER = 24
#: Bits of a place in the order of k-mers; 2**36 words are more than a text can have.
_PLACE_BITS = 36
#: Bits of a text's hash that stand before a word's place in a coordinate; they tell the texts of one doc_id apart.
_TEXT_BITS = 27
#: Windows in one row of the table of edges.
PIECE = 1 << 16
_PACKED = "doc_id long, begin long, edge array<long>, ends array<long>, word array<int>"


def _words(column):
    table = space_table()
    for a, b, data, off in chunks(column):
        w = Words(data, off, table)
        yield a, b, w, w.hashes()


def minimizers(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words at which windows begin, the word at which each one's minimizer begins, k-mer hashes by word).

    The order is by the upper bits of the hash, then by place, so equal windows
    choose the same place within them.
    """
    k = min(KMER, window)
    at = np.arange(max(0, len(h) - k + 1))
    mers = span_hashes(h, at, at + k, 21)
    wins = w.windows(window)
    if not len(wins):
        return wins, wins, mers
    span = window - k + 1
    size = -(-len(mers) // span) * span
    value = np.full(size, np.uint64(2**64 - 1))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    value[: len(mers)] = (mers & ~low) | at.astype(np.uint64)
    block = value.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return wins, (np.minimum(behind[wins], ahead[wins + span - 1]) & low).astype(np.int64), mers


def _short(ver: np.ndarray) -> np.ndarray:
    return ver & ((1 << _TEXT_BITS) - 1)


def _joined(w: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """The words of text i, or those to keep, joined by one space."""
    own = slice(w.bound[i], w.bound[i + 1])
    a, b = w.starts[own], w.ends[own]
    if keep is not None:
        a, b = a[keep], b[keep]
    if not len(a):
        return b""
    if keep is None:
        piece = w.data[a[0] : b[-1]]
        inside = w.inside[a[0] : b[-1]].copy()
    else:
        piece = w.data[w.off[i] : w.off[i + 1]]
        d = np.zeros(len(piece) + 1, np.int32)
        d[a - w.off[i]] += 1
        d[b - w.off[i]] -= 1
        inside = np.cumsum(d[:-1]) > 0
    # the byte after each word but the last becomes its space
    out = piece.copy()
    after = b[:-1] - (a[0] if keep is None else w.off[i])
    out[after] = 0x20
    inside[after] = True
    return out[inside].tobytes()


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


_FIRST = "doc_id long, n_words long, ver long, ver2 long, sha string, marks array<long>"


def _first_pass(window: int):
    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for a, b, w, h in _words(batch.column("text")):
                wins, where, mers = minimizers(w, h, window)
                doc = w.doc[wins]
                change = np.append(True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])) if len(wins) else np.zeros(0, bool)
                marks, of = mers[where[change]], doc[change]
                bounds = np.searchsorted(of, np.arange(b - a + 1))
                cols[0].append(batch.column("doc_id").slice(a, b - a))
                cols[1].append(pa.array(w.counts))
                for c, seed in ((2, 31), (3, 32)):
                    cols[c].append(pa.array(signed(span_hashes(h, w.bound[:-1], w.bound[1:], seed))))
                cols[4].append(pa.array([_digest(_joined(w, i)) for i in range(b - a)]))
                cols[5].append(pa.array([np.unique(signed(marks[bounds[i] : bounds[i + 1]])) for i in range(b - a)], pa.list_(pa.int64())))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["doc_id", "n_words", "ver", "ver2", "sha", "marks"])

    return run


def _edges(window: int):
    """The windows whose minimizer is among the text's marks, in rows of at most PIECE windows of a text: begin is the coordinate of its first word, ends are 32 bits of the hash of each end node.

    Nodes whose bits are equal by chance seem to branch, which only cuts paths.
    """

    def run(batches):
        for batch in batches:
            marks = batch.column("marks")
            for a, b, w, h in _words(batch.column("text")):
                wins, where, mers = minimizers(w, h, window)
                if not len(wins):
                    continue
                own = marks.slice(a, b - a)
                lists, flat = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy(zero_copy_only=False)
                # a window's (text, minimizer) among the (text, mark) pairs, by one mixed key
                of = np.repeat(np.arange(b - a), lists).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                known = np.unique(flat.view(np.uint64) ^ of)
                key = mers[where] ^ (w.doc[wins].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                wins = wins[known[place] == key] if len(known) else wins[:0]
                if not len(wins):
                    continue
                doc = w.doc[wins]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]) | (np.arange(len(doc)) % PIECE == 0))
                of, bounds = doc[first], pa.array(np.append(first, len(doc)).astype(np.int32))
                ver = signed(span_hashes(h, w.bound[:-1], w.bound[1:], 31))
                ids = batch.column("doc_id").slice(a, b - a).to_numpy(zero_copy_only=False)
                u, v = (span_hashes(h, wins + x, wins + x + window - 1, 23) for x in (0, 1))
                ends = (u & np.uint64(0xFFFFFFFF00000000)) | (v >> np.uint64(32))
                lists = (pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (signed(span_hashes(h, wins, wins + window, 22)), signed(ends), (wins - w.bound[doc]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(_short(ver)[of] << _PLACE_BITS), *lists], ["doc_id", "begin", "edge", "ends", "word"])

    return run


def _source_digests(batches):
    """Digests of the asked spans of source texts; ask: [(ver, start, n)]."""
    for batch in batches:
        out = []
        ids, asks = batch.column("doc_id").to_pylist(), batch.column("ask").to_pylist()
        for a, b, w, h in _words(batch.column("text")):
            ver = _short(signed(span_hashes(h, w.bound[:-1], w.bound[1:], 31)))
            for i in range(a, b):
                words = _joined(w, i - a).split(b" ")
                out += [(ids[i], x["ver"], x["start"], x["n"], _digest(b" ".join(words[x["start"] : x["start"] + x["n"]]))) for x in asks[i] if x["ver"] == ver[i - a]]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["sdoc", "sver", "sstart", "n", "digest"])


def _apply(batches):
    """Drop the spans whose words have the digest of their source; spans: [(ver, start, n, digest)]."""
    for batch in batches:
        out = []
        ids, spans = batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()
        for a, b, w, h in _words(batch.column("text")):
            ver = signed(span_hashes(h, w.bound[:-1], w.bound[1:], 31))
            for i in range(a, b):
                words = _joined(w, i - a).split(b" ")
                good = [x for x in spans[i] if x["ver"] == _short(ver[i - a]) and _digest(b" ".join(words[x["start"] : x["start"] + x["n"]])) == x["digest"]]
                if good:
                    gone = cover(int(w.counts[i - a]), np.array([x["start"] for x in good]), np.array([x["n"] for x in good]))
                    kept = _joined(w, i - a, ~gone)
                    out.append((ids[i], int(ver[i - a]), int(gone.sum()), _digest(kept), kept.decode("utf-8", "replace")))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)], ["doc_id", "ver", "n_removed", "sha", "text"])


def repeated_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, n_words, ver, ver2, sha, rep; the spans: doc_id, ver, start, n, sdoc, sver, sstart).

    The spans' ver and sver are the last bits of the texts' ver. ``rep`` is the smallest doc_id with the same words. Spans are given for the
    representatives only.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = keep(docs.mapInArrow(_first_pass(window), _FIRST))
    same = base.groupBy("ver", "ver2", "n_words").agg(F.min("doc_id").alias("rep"))
    lead = base.where(F.size("marks") > 0).groupBy("ver", "ver2", "n_words").agg(F.min("doc_id").alias("doc_id"), F.first("marks").alias("marks"))
    marks = lead.where("doc_id is not null").select("doc_id", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark")
    wanted = keep(marks.join(shared, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")))
    packed = keep(having(docs, wanted).join(wanted, "doc_id").select("doc_id", "text", "marks").mapInArrow(_edges(window), _PACKED))
    edges = packed.select("doc_id", "begin", F.explode(F.arrays_zip("edge", "ends", "word")).alias("w")).select("w.edge", "w.ends", "doc_id", (F.col("begin") + F.col("w.word")).alias("place"))
    paths = _paths(edges)
    along = Window.partitionBy("doc_id", "sdoc", "head", "shift").orderBy("place")
    met = edges.select("edge", "doc_id", "place").join(paths, "edge").where("sdoc < doc_id").select("doc_id", "place", "sdoc", "head", (F.col("splace") - F.col("place")).alias("shift"))
    runs = (
        met.withColumn("run", F.dense_rank().over(along) - F.col("place"))  # a repeated row of docs has the same places
        .groupBy("doc_id", "sdoc", "head", "shift", "run")
        .agg(F.min("place").alias("start"), (F.max("place") - F.min("place") + F.lit(window)).alias("n"))
        .withColumn("sstart", F.col("start") + F.col("shift"))
    )
    text, word = (lambda c: F.shiftright(c, _PLACE_BITS)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    spans = runs.select("doc_id", text("start").alias("ver"), word("start").alias("start"), "n", "sdoc", text("sstart").alias("sver"), word("sstart").alias("sstart"))
    return base.drop("marks").join(same, ["ver", "ver2", "n_words"], "left"), spans


def _paths(edges: DataFrame) -> DataFrame:
    """edge, sdoc, splace (its smallest coordinate) and head (where the nonbranching path it is on begins there) of the edges that stand in several documents."""
    at = F.min(F.struct("doc_id", "place"))
    first = edges.groupBy("edge", "ends").agg(at.alias("at"), F.max("doc_id").alias("last")).where("at.doc_id < last")
    first = keep(first.select("edge", F.shiftrightunsigned("ends", 32).alias("u"), F.col("ends").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"), F.col("at.doc_id").alias("sdoc"), F.col("at.place").alias("splace")))
    place = F.min(F.struct("sdoc", "splace"))
    into = first.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), place.alias("before"))
    out = first.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), place.alias("after"))
    follows = (F.col("before.sdoc") == F.col("after.sdoc")) & (F.col("before.splace") + 1 == F.col("after.splace"))
    inner = into.where("n_in = 1").join(out.where("n_out = 1"), "node").where(follows).select("after.sdoc", "after.splace", F.lit(True).alias("inner"))
    upto = Window.partitionBy("sdoc", F.shiftright("splace", _PLACE_BITS)).orderBy("splace").rowsBetween(Window.unboundedPreceding, 0)
    heads = first.join(inner, ["sdoc", "splace"], "left").withColumn("head", F.max(F.when(F.col("inner").isNull(), F.col("splace"))).over(upto))
    return keep(heads.select("edge", "sdoc", "splace", "head"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words under a window that also starts in a document with a smaller doc_id
    go. ``kept_text`` holds the words left, joined by one space, where some but
    not all went; it is null where the text stays as it is, and empty where
    nothing is left. Null and empty texts have no words; a null doc_id is
    neither a source nor judged. Rows with the same doc_id are judged one by
    one and never against each other. Other columns of docs are dropped.
    """
    base, spans = repeated_spans(docs, window)
    spans = keep(spans)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ask = keep(spans.select("sdoc", "sver", "sstart", "n").distinct().groupBy(F.col("sdoc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("sver").alias("ver"), F.col("sstart").alias("start"), "n")).alias("ask")))
    digests = having(texts, ask).join(ask, "doc_id").select("doc_id", "text", "ask").mapInArrow(_source_digests, "sdoc long, sver long, sstart long, n long, digest string").distinct()
    sure = keep(spans.join(digests, ["sdoc", "sver", "sstart", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("ver", "start", "n", "digest")).alias("spans")))
    changed = having(texts, sure).join(sure, "doc_id").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, ver long, n_removed long, sha string, text string")
    changed = changed.groupBy("doc_id", "ver").agg(F.first("n_removed").alias("gone"), F.first("sha").alias("left_sha"), F.first("text").alias("kept_text"))
    whole = (F.col("rep") < F.col("doc_id")) & (F.col("n_words") >= window)
    return base.join(changed, ["doc_id", "ver"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
