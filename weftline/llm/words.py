"""Vectorised word kernels over Arrow string columns.

A batch of texts is one byte buffer with offsets. Words, their hashes and the
hashes of word windows are computed for the whole buffer with numpy, without a
Python step per document or per word. All separators are ASCII, so working on
UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one text alone may exceed it.
CHUNK_BYTES = 1 << 20

U = np.uint64


def space_table() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (lower-cased text)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t[data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``most`` bytes."""
    data, off = column_bytes(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    p = _POWERS.get(base)
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 16), base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if len(p) <= 4 * CHUNK_BYTES:
            _POWERS[base] = p
    return p


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of the runs values[start:end]; equal runs have equal hashes wherever they stand."""
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 5
    back = pow(base, -1, 2**64)
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(back, n)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


class Words:
    """Words of a run of texts: byte spans, the text of each, and its first word's index by text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        inside = table[data] if len(data) else np.zeros(0, bool)
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = off[1:] - 1
        after[last[(last >= 0) & (off[1:] > off[:-1])]] = False
        self.data, self.off, self.inside = data, off, inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, off[:-1])
        self.bound = np.append(self.first, len(self.starts))
        self.counts = np.diff(self.bound)
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        letters = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))
        return span_hashes(letters[self.data], self.starts, self.ends, seed)

    def windows(self, k: int) -> np.ndarray:
        """Indices of words where a window of k words of one text begins."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])


def cover(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """True for positions inside any [start, start + k)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as int64, which Spark stores as LONG."""
    return h.view(np.int64)
