"""Benchmark decontamination: a prefix-filtered set join on rare shingles.

An item's windows of ``window`` words are the records to find, each once, with
the items that have it. Each window is a set of ``SHINGLE``-word shingles, ordered by how often the shingles occur in the
documents, rarest first. As a window must be contained whole, its prefix is one
shingle: the rarest. Documents are probed for these prefix shingles only. The
shingle's offset in the window then fixes where the window would start (the
positional bound), the document's ends bound it (the length bound), and the
window's words are compared one by one.

The items are a stated query set. They are broadcast in blocks of at most
``BLOCK_WORDS`` words; a larger benchmark takes several passes over the
documents. No document row is shuffled unless there is more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, alnum_table, chunks, cover, lower_ascii, span_hashes

SHINGLE = 3
#: Most words of benchmark items in one broadcast: about 100 MB of index.
BLOCK_WORDS = 1_000_000
#: Candidates (place, window) that are compared at a time.
PAIRS = 500_000
_MASK_BITS = 22


def _words(column) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    table = alnum_table()
    for a, b, data, off in chunks(column):
        w = Words(lower_ascii(data), off, table)
        yield a, b, w, w.hashes()


class Index:
    """Windows of a block of items, and the table of the shingles that lead to them."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.ids = ids
        groups: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for a, _, w, h in _words(pa.array(texts, pa.large_string())):
            for i in range(len(w.counts)):
                own, n = h[w.bound[i] : w.bound[i + 1]], int(w.counts[i])
                if n:
                    k = min(window, n)
                    rows = np.lib.stride_tricks.sliding_window_view(own, k)
                    groups.setdefault(k, []).append((rows, np.full(len(rows), a + i)))
        self.words: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, v in sorted(groups.items()):
            # equal windows are one record, with a run of items
            self.words[k], which = np.unique(np.concatenate([x for x, _ in v]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate([x for _, x in v])]), axis=1)
            self.items[k] = np.searchsorted(pairs[0], np.arange(len(self.words[k]) + 1)), pairs[1]
        self.sizes = sorted({min(SHINGLE, k) for k in self.words})
        self.shingles = {s: np.unique(np.concatenate([self._of(k, s).ravel() for k in self.words if min(SHINGLE, k) == s])) for s in self.sizes}
        self.masks = {s: self._mask(v) for s, v in self.shingles.items()}
        self.first: dict[int, tuple[np.ndarray, ...]] = {}

    def _of(self, k: int, s: int) -> np.ndarray:
        """Hashes of the s-word shingles of each window of k words, by offset."""
        flat = self.words[k].ravel()
        at = (np.arange(len(self.words[k]))[:, None] * k + np.arange(k - s + 1)[None, :]).ravel()
        return span_hashes(flat, at, at + s, 11).reshape(len(self.words[k]), -1)

    @staticmethod
    def _mask(values: np.ndarray) -> np.ndarray:
        m = np.zeros(1 << _MASK_BITS, bool)
        m[(values & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)] = True
        return m

    @staticmethod
    def _look_up(values: np.ndarray, table: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in values that hold a value of the sorted table, and its place there."""
        at = np.flatnonzero(mask[(values & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(table, values[at]), max(0, len(table) - 1))
        ok = table[place] == values[at] if len(table) else np.zeros(0, bool)
        return at[ok], place[ok]

    def count(self, w: Words, h: np.ndarray, counts: dict[int, np.ndarray]) -> None:
        """Add how often each shingle occurs in these documents."""
        for s in self.sizes:
            at = w.windows(s)
            _, place = self._look_up(span_hashes(h, at, at + s, 11), self.shingles[s], self.masks[s])
            counts[s] += np.bincount(place, minlength=len(counts[s]))

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Give every window its rarest shingle; ties go to the earlier offset."""
        for k in self.words:
            s = min(SHINGLE, k)
            own = self._of(k, s)
            often = counts[s][np.searchsorted(self.shingles[s], own)]
            offset = np.argmin(often, axis=1)
            key = own[np.arange(len(own)), offset]
            order = np.argsort(key, kind="stable")
            keys, begin = np.unique(key[order], return_index=True)
            self.first[k] = (keys, np.append(begin, len(order)), order, offset, self._mask(keys))

    def find(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starting words, lengths) of the occurrences of windows, and the (text, item) pairs that follow from them."""
        starts, lengths, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((2, 0), np.int64)]
        for k, (keys, begin, order, offset, mask) in self.first.items():
            s = min(SHINGLE, k)
            at = w.windows(s)
            hit, place = self._look_up(span_hashes(h, at, at + s, 11), keys, mask)
            times = begin[place + 1] - begin[place]
            upto = np.append(0, np.cumsum(times))
            a = 0
            while a < len(hit):  # runs of at most PAIRS candidates, or one place
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
                t = times[a:b]
                rows = order[np.repeat(begin[place[a:b]], t) + np.arange(upto[b] - upto[a]) - np.repeat(upto[a:b] - upto[a], t)]
                word = np.repeat(at[hit[a:b]], t)
                doc, start = w.doc[word], word - offset[rows]
                ok = (start >= w.bound[doc]) & (start + k <= w.bound[doc + 1])
                rows, start, doc = rows[ok], start[ok], doc[ok]
                for x in range(k):
                    ok = h[start + x] == self.words[k][rows, x]
                    rows, start, doc = rows[ok], start[ok], doc[ok]
                starts.append(start)
                lengths.append(np.full(len(start), k))
                pairs = np.unique(np.stack([doc, rows]), axis=1)
                bounds, items = self.items[k]
                n = bounds[pairs[1] + 1] - bounds[pairs[1]]
                ends = np.cumsum(n)
                own = items[np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[pairs[1]] - (ends - n), n)]
                owners.append(np.unique(np.stack([np.repeat(pairs[0], n), own]), axis=1))
                a = b
        doc, item = np.unique(np.concatenate(owners, axis=1), axis=1)
        return np.concatenate(starts), np.concatenate(lengths), doc, item


def _blocks(items: DataFrame, window: int) -> Iterator[Index]:
    """Indexes of the items, each of a bounded number of words."""
    items = items.select(F.col("item_id").cast("string").alias("id"), "text").where("id is not null")
    words = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))) / 2).first()[0] or 0
    n = max(1, -(-int(words) // BLOCK_WORDS))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        rows = part.orderBy("id", "text").collect()  # bounded: BLOCK_WORDS on average
        yield Index([r[0] for r in rows], [r[1] for r in rows], window)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside occurrences of windows) and the sorted ids of the items found.

    A null or empty text has no words. Items without words find nothing; items
    with fewer than ``window`` words are one window. Items with equal texts are
    all named. Null item ids are left out. Other columns of docs are dropped.
    Rows with the same doc_id are judged one by one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, parts = docs.sparkSession, []
    for index in _blocks(items, window):
        shared = spark.sparkContext.broadcast(index)

        def count(batches, shared=shared):
            index, counts = shared.value, {s: np.zeros(len(v), np.int64) for s, v in shared.value.shingles.items()}
            for batch in batches:
                for _, _, w, h in _words(batch.column("text")):
                    index.count(w, h, counts)
            for s, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(c[at])], ["s", "place", "n"])

        counts = {s: np.zeros(len(v), np.int64) for s, v in index.shingles.items()}
        for s, place, n in docs.select("text").mapInArrow(count, "s int, place long, n long").groupBy("s", "place").agg(F.sum("n")).collect():
            counts[s][place] = n  # at most a row for each shingle of the block
        index.choose(counts)
        chosen = spark.sparkContext.broadcast(index)

        def probe(batches, chosen=chosen):
            for batch in batches:
                yield _probe(batch, chosen.value)

        parts.append(docs.mapInArrow(probe, "doc_id long, n_words long, key binary, hits binary, n_hit long, items array<string>"))
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "n_hit", "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    @F.pandas_udf("long")
    def union_size(many: pd.Series) -> pd.Series:
        return many.map(lambda x: int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in x])).sum()))

    return (
        every.groupBy("doc_id", "n_words", "key")
        .agg(F.collect_set("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"), (F.count("*") / len(parts)).cast("int").alias("times"))
        .withColumn("n_hit", union_size("hits"))
        .select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), F.explode(F.sequence(F.lit(1), "times")))
        .drop("col")
    )


def _probe(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    n_words, n_hit, keys, hits, items = [], [], [], [], []
    for _, _, w, h in _words(batch.column("text")):
        start, k, doc, item = index.find(w, h)
        inside = cover(len(w), start, k)
        found: dict[int, set[str]] = {}
        for d, i in zip(doc.tolist(), item.tolist(), strict=True):
            found.setdefault(d, set()).add(index.ids[i])
        upto = np.append(0, np.cumsum(inside))
        n_words.append(w.counts)
        n_hit.append(upto[w.bound[1:]] - upto[w.bound[:-1]])
        for i in range(len(w.counts)):
            own = slice(w.bound[i], w.bound[i + 1])
            keys.append(hashlib.md5(h[own].tobytes()).digest())
            hits.append(np.packbits(inside[own]).tobytes())
            items.append(sorted(found.get(i, ())))
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.concatenate([none, *n_words])), pa.array(keys, pa.binary()), pa.array(hits, pa.binary()), pa.array(np.concatenate([none, *n_hit])), pa.array(items, pa.list_(pa.string()))],
        ["doc_id", "n_words", "key", "hits", "n_hit", "items"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id has no hit; a null doc_id is kept."""
    bad = find_contamination(docs, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
