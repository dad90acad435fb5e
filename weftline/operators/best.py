"""The best items of many queries within a task, from scores that come in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FOUND = "query_id long, item_id long, score double"
#: Scores that a task holds at once.
SCORES = 262_144


class Best:
    """The k best items of each query by score rounded to six digits, ties by item.

    A task keeps k items of each query and what has come in since these were
    last cut, so its memory doesn't depend on how many rows it reads. With
    ``parts`` an item may come more than once, and its best score counts.
    """

    def __init__(self, ids: list, k: int, parts: bool = False):
        self.ids, self.k, self.parts = np.array(ids, np.int64), k, parts
        self.floor = np.full(len(ids), -np.inf)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.new = 0

    def offer(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """Scores of items by query numbers, three arrays of one length."""
        score = np.round(score, 6)
        at = np.flatnonzero(score >= self.floor[query])
        self.kept.append((query[at], item[at], score[at]))
        self.new += len(at)
        if self.new > max(SCORES // 4, len(self.ids) * self.k):
            self._cut()

    def offer_all(self, query: np.ndarray, item: np.ndarray, score: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """A matrix of scores, a row for each query number and a column for each item."""
        good = score >= self.floor[query][:, None] - 1e-6
        r, c = np.nonzero(good if allowed is None else good & allowed)
        self.offer(query[r], item[c], score[r, c])

    def _cut(self) -> None:
        q, item, score = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        if self.parts:
            by = np.lexsort((-score, item, q))
            q, item, score = q[by], item[by], score[by]
            first = np.ones(len(q), bool)
            first[1:] = (q[1:] != q[:-1]) | (item[1:] != item[:-1])
            q, item, score = q[first], item[first], score[first]
        by = np.lexsort((item, -score, q))
        q, item, score = q[by], item[by], score[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.floor[q[full]] = score[full]
        at = place < self.k
        self.kept, self.new = [(q[at], item[at], score[at])], 0

    def batches(self):
        self._cut()
        q, item, score = self.kept[0]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(item), pa.array(score)], ["query_id", "item_id", "score"])


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of an array of vectors that are usable, and these as a matrix: of the given width, without nulls, not zero."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    width = width or int(max(size.max(initial=0), 0))
    same = np.flatnonzero((size == width) & (width > 0))
    flat = column.take(pa.array(same)).flatten()
    m = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(same), width) if len(same) else np.zeros((0, width))
    ok = ~np.isnan(m).any(axis=1) & m.any(axis=1)
    return same[ok], m[ok]
