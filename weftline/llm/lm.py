"""Language-model scoring with a small causal self-attention model on subword ids.

Text is a sequence of words and an end token. Words are cut into subwords of a
public byte-level vocabulary, which is read, never trained. The ``TOP - 1``
most frequent subwords of the training documents are the model's symbols; any
other one is an escape symbol followed by a draw from the smoothed counts of
the rest. One attention layer sees up to ``CONTEXT + STRIDE`` symbols before
the one to score; windows overlap by CONTEXT and score STRIDE symbols each, so
every symbol is scored once. The output is a softmax over classes of symbols,
then one within the class.

Subword ids are computed once and kept, two bytes each. Subword counts and the
weights cover all training documents. The weights are trained in numpy on every
window of these once, in ``ROUNDS`` rounds that deal the documents by a hash. In
a round they are dealt to shards of about ``SHARD_WINDOWS`` windows, as many as
the corpus asks for; each shard trains in a fixed order from the same weights, and
the results, weighed by their windows, are averaged by a distributed sum of
integers. So the weights don't depend on how rows are dealt to tasks, and a shard
learns as much however many tasks there are.

The base score needs the count of every word of the corpus. Distinct words with
their counts, and which text has them how often, are packed into arrays by hash
bucket; a bucket adds up the counts and returns packed sums for each run of
texts. A frequent word is one entry for each run, however often it stands there.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep
from .words import U, Words, chunks, lower_ascii, signed, space_table, span_hashes

#: A file of base64 tokens and ranks, one pair a line, in the layout that tiktoken reads.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SIDE = 32
TOP = SIDE * SIDE
WIDTH = 16
STRIDE = 32
CONTEXT = 16
ROUNDS = 2
#: Windows in one step of training.
STEP_WINDOWS = 256
#: Windows that one set of weights is trained on before it is averaged with others.
SHARD_WINDOWS = 50_000
#: Shards that a task adds up before it sends their sum, which fits 64 bits.
SUM_SHARDS = 128
#: Entries of (text, word) in one bucket.
BUCKET = 4_000_000
CHUNK = 2 << 20
#: Words whose subwords a task remembers from one chunk of text to the next.
KNOWN_WORDS = 250_000


class Subwords:
    """Subword ids of words; the id after the last one of the vocabulary ends a text."""

    def __init__(self, content: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.end = self.size
        if self.end >= 1 << 16:
            raise ValueError("a vocabulary of over 65,535 subwords")
        self.length = np.zeros(self.size + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        """No known words: their hashes in order, and where the ids of each begin and how many they are."""
        self.values, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def known(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin among them, how many they are); only words that no chunk before had are cut."""
        values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.values) > KNOWN_WORDS:
            self._forget()
        at = np.searchsorted(self.values, values)
        new = np.append(self.values, U(0))[at] != values
        new[at == len(self.values)] = True
        if new.any():
            raw = w.data.tobytes()
            ids, bound = self.cut([raw[a:b] for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)])
            self.begin = np.insert(self.begin, at[new], bound[:-1] + len(self.ids))
            self.count = np.insert(self.count, at[new], np.diff(bound))
            self.values = np.insert(self.values, at[new], values[new])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.values, values)
        return self.ids, self.begin[at][inverse], self.count[at][inverse]

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, bounds): each word with a blank before it."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        text = b" " + b" ".join(words)
        ends = np.cumsum(np.array([len(w) + 1 for w in words]))
        try:
            ids = np.array(self.encoding.encode_ordinary(text.decode()), np.int32)
            upto = np.cumsum(self.length[ids])
            at = np.searchsorted(upto, ends)
            if (upto[np.minimum(at, len(upto) - 1)] == ends).all():
                return ids, np.append(0, at + 1)
        except UnicodeDecodeError:
            pass
        each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]  # tokens that span words, or bytes that aren't text
        return np.array([i for e in each for i in e], np.int32), np.append(0, np.cumsum([len(e) for e in each]))


def held_out(ids: list[int | None]) -> np.ndarray:
    """Whether the texts with these ids are kept from learning; a null id counts as an empty string."""
    return np.array([binascii.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    table, out = space_table(), held_out(batch.column("doc_id").to_pylist())
    for a, b, data, off in chunks(batch.column("text"), CHUNK):
        w = Words(lower_ascii(data), off, table)
        yield a, b, w, w.hashes(), out[a:b]


class Symbols:
    """The model's symbols: subwords by falling frequency, the escape symbol at the place of the last."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        # and a place for the beginning of a text
        self.of = np.full(len(counts) + 1, TOP - 1, np.int64)
        self.of[order[: TOP - 1]] = np.arange(TOP - 1)
        self.of[-1] = TOP
        rest = order[TOP - 1 :]
        n = np.append(counts[order[: TOP - 1]], counts[rest].sum()).astype(float)
        self.share = np.full(TOP, 0.5 / (n.sum() + 1))
        self.share[: len(n)] = (n + 0.5) / (n.sum() + 1)
        self.rare = np.zeros(len(counts))
        self.rare[rest] = np.log((counts[rest] + 1.0) / (counts[rest].sum() + len(rest)))


def first_weights(share: np.ndarray) -> dict[str, np.ndarray]:
    """Seeded weights; the output biases are the symbols' frequencies."""
    rng = np.random.default_rng(7)
    part = share.reshape(SIDE, SIDE)
    r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "emb": r(TOP + 1, WIDTH),
        "q": r(WIDTH, WIDTH),
        "k": r(WIDTH, WIDTH),
        "v": r(WIDTH, WIDTH),
        "far": np.zeros(CONTEXT + STRIDE, np.float32),
        "cw": r(WIDTH, SIDE),
        "cb": np.log(part.sum(1) / share.sum()).astype(np.float32),
        "ww": r(SIDE, WIDTH, SIDE),
        "wb": np.log(part / part.sum(1, keepdims=True)).astype(np.float32),
    }


_DISTANCE = (CONTEXT + np.arange(STRIDE))[:, None] - np.arange(CONTEXT + STRIDE)[None, :]


def _within(a: np.ndarray, b: np.ndarray, most: float) -> bool:
    """Whether no product of a row of a and a column of b can exceed most, by their lengths."""
    return bool(np.einsum("ij,ij->i", a, a).max(initial=0) * np.einsum("...ij,...ij->...j", b, b).max(initial=0) <= most * most)


#: Windows whose attention is computed at once, so that it stays in the processor's cache.
BLOCK_WINDOWS = 64


def attend(weights: dict, x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, dict]:
    """Hidden states [windows, STRIDE, WIDTH] for inputs x [windows, CONTEXT + STRIDE], and what they were made of."""
    e = weights["emb"]
    scale = np.float32(WIDTH**-0.5)
    now = np.ascontiguousarray(x[:, CONTEXT:])
    q, k, v = e @ weights["q"] * scale, e @ weights["k"], e @ weights["v"]
    small = _within(q, k.T, 50)
    q, k, v = q.take(now, axis=0), k.take(x, axis=0), v.take(x, axis=0)
    near = np.where(_DISTANCE >= 0, np.exp(weights["far"])[np.maximum(_DISTANCE, 0)], np.float32(0))
    p, o = np.empty((len(x), STRIDE, CONTEXT + STRIDE), e.dtype), np.empty((len(x), STRIDE, WIDTH), e.dtype)
    total, ones = np.empty((len(x), STRIDE, 1), e.dtype), np.ones((CONTEXT + STRIDE, 1), e.dtype)
    cut = ~valid.all(axis=1)  # windows at an end of their text
    for a in range(0, len(x), BLOCK_WINDOWS):
        own = slice(a, a + BLOCK_WINDOWS)
        s = np.matmul(q[own], k[own].transpose(0, 2, 1), out=p[own])
        if not small:
            np.clip(s, -50, 50, out=s)
        np.exp(s, out=s)
        s *= near
        at = np.flatnonzero(cut[own])
        if len(at):
            s[at] *= valid[own][at][:, None, :]
        np.matmul(s.reshape(-1, CONTEXT + STRIDE), ones, out=total[own].reshape(-1, 1))
        np.matmul(s, v[own], out=o[own])
    total += np.float32(1e-30)
    o /= total
    h = e.take(now, axis=0)
    h += o
    return h, {"p": p, "total": total, "q": q, "k": k, "v": v, "o": o}


def _outputs(weights: dict) -> tuple[np.ndarray, np.ndarray]:
    """The output weights of classes and of symbols within each class, with the biases as a last row."""
    return np.concatenate([weights["cw"], weights["cb"][None, :]]), np.concatenate([weights["ww"], weights["wb"][:, None, :]], axis=1)


def _with_one(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of h at these places, with a one behind each."""
    out = np.ones((len(at), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h.take(at, axis=0)
    return out


def _logits(h: np.ndarray, w: np.ndarray, small: bool) -> np.ndarray:
    z = h @ w
    return z if small else np.clip(z, -80, 80, out=z)


def log_probabilities(weights: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of symbols y after hidden states h [n, WIDTH]."""
    order = np.argsort((y // SIDE).astype(np.uint8), kind="stable")
    h, y, row = _with_one(h, order), y[order], np.arange(len(y))
    c, inner = y // SIDE, y % SIDE
    cw, ww = _outputs(weights)
    small = _within(h, cw, 80) and _within(h, ww, 80)
    ones = np.ones(SIDE, h.dtype)
    z = _logits(h, cw, small)
    found = z[row, c]
    total = (np.exp(z, out=z) @ ones).astype(np.float64)  # of two sums, their product
    bound = np.searchsorted(c, np.arange(SIDE + 1)).tolist()
    for i in range(SIDE):
        a, b = bound[i], bound[i + 1]
        if a < b:
            z = _logits(h[a:b], ww[i], small)
            found[a:b] += z[row[: b - a], inner[a:b]]
            total[a:b] *= np.exp(z, out=z) @ ones
    found -= np.log(total).astype(found.dtype)
    out = np.empty_like(found)
    out[order] = found
    return out


def _rows_added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of the rows whose place it is."""
    width = rows.shape[1]
    place = (at[:, None] * width + np.arange(width)[None, :]).ravel()
    return np.bincount(place, weights=rows.ravel(), minlength=n * width).reshape(n, width)


def gradients(weights: dict, x: np.ndarray, valid: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict:
    """Of the mean loss over the masked targets y [windows, STRIDE]."""
    h3, t = attend(weights, x, valid)
    flat = y.ravel()
    at = np.flatnonzero(mask.ravel())
    at = at[np.argsort(flat[at].astype(np.uint16), kind="stable")]  # by class and symbol
    h, goal = _with_one(h3.reshape(-1, WIDTH), at), flat[at]
    n = max(1, len(at))
    part = h.dtype.type(1 / n)
    g = {k: np.zeros_like(v) for k, v in weights.items()}
    cw, ww = _outputs(weights)
    gc, gw = np.zeros_like(cw), np.zeros_like(ww)
    small = _within(h, cw, 80) and _within(h, ww, 80)
    ones = np.ones((SIDE, 1), h.dtype)

    def pull(h: np.ndarray, w: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The softmax's part of the gradients, of the weights into out and of the hidden states."""
        z = _logits(h, w, small)
        np.exp(z, out=z)
        share = 1 / (z @ ones)
        np.matmul((h * share).T, z, out=out)
        d = z @ w[:-1].T
        d *= share
        return d

    dh = pull(h, cw, gc)
    bound = np.searchsorted(goal, np.arange(SIDE + 1) * SIDE).tolist()
    for i in range(SIDE):
        a, b = bound[i], bound[i + 1]
        if a < b:
            dh[a:b] += pull(h[a:b], ww[i], gw[i])
    # and the part of the symbols that did come
    held = _rows_added(goal, h, TOP).reshape(SIDE, SIDE, WIDTH + 1)
    gc -= held.sum(axis=1).T
    gw -= held.transpose(0, 2, 1)
    dh -= (weights["cw"].T[:, None, :] + weights["ww"].transpose(0, 2, 1)).reshape(TOP, WIDTH).take(goal, axis=0)
    g["cw"], g["cb"], g["ww"], g["wb"] = gc[:-1] * part, gc[-1] * part, gw[:, :-1] * part, gw[:, -1] * part
    dh *= part
    full = np.zeros((x.shape[0] * STRIDE, WIDTH), dh.dtype)
    full[at] = dh
    da = full.reshape(-1, STRIDE, WIDTH) / t["total"]  # so that p needn't be divided
    mean = np.matmul(da * t["o"], np.ones((WIDTH, 1), da.dtype))
    dq, dk, dv = np.empty_like(t["q"]), np.empty_like(t["k"]), np.empty_like(t["v"])
    seen = np.zeros(_DISTANCE.size, da.dtype)
    for a in range(0, len(x), BLOCK_WINDOWS):
        own = slice(a, a + BLOCK_WINDOWS)
        p, d = t["p"][own], da[own]
        np.matmul(p.transpose(0, 2, 1), d, out=dv[own])
        ds = np.matmul(d, t["v"][own].transpose(0, 2, 1))
        ds -= mean[own]
        ds *= p
        np.matmul(ds, t["k"][own], out=dq[own])
        np.matmul(ds.transpose(0, 2, 1), t["q"][own], out=dk[own])
        seen += np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)
    behind = _DISTANCE.ravel() >= 0
    g["far"] += np.bincount(_DISTANCE.ravel()[behind], weights=seen[behind], minlength=CONTEXT + STRIDE)
    dq *= dq.dtype.type(WIDTH**-0.5)
    e, now = weights["emb"].take(x, axis=0), np.s_[:, CONTEXT:]
    eq, ek = np.ascontiguousarray(e[now]).reshape(-1, WIDTH), e.reshape(-1, WIDTH)
    dq, dk, dv = dq.reshape(-1, WIDTH), dk.reshape(-1, WIDTH), dv.reshape(-1, WIDTH)
    g["q"], g["k"], g["v"] = eq.T @ dq, ek.T @ dk, ek.T @ dv
    dx = dk @ weights["k"].T
    dx += dv @ weights["v"].T
    own = full + dq @ weights["q"].T
    dx.reshape(x.shape[0], -1, WIDTH)[now] += own.reshape(-1, STRIDE, WIDTH)
    g["emb"] += _rows_added(x.ravel(), dx, TOP + 1)
    return g


def fit(weights: dict, x: np.ndarray, valid: np.ndarray, y: np.ndarray, mask: np.ndarray, state: dict, rate: float = 0.01) -> None:
    """One Adam step, in place."""
    state["t"] = state.get("t", 0) + 1
    for k, g in gradients(weights, x, valid, y, mask).items():
        m = state[k, "m"] = 0.9 * state.get((k, "m"), 0) + 0.1 * g
        v = state[k, "v"] = 0.99 * state.get((k, "v"), 0) + 0.01 * g * g
        weights[k] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-6)).astype(np.float32)


def subwords_of(w: Words, h: np.ndarray, sub: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids of the texts, each text's followed by the end; where each text's begin, and the end of all)."""
    ids, begin, size = sub.known(w, h)
    upto = np.append(0, np.cumsum(size))
    start = np.append(0, np.cumsum(upto[w.bound[1:]] - upto[w.bound[:-1]] + 1))
    y = np.full(int(start[-1]), sub.end, np.int32)
    at = np.repeat(np.arange(len(w)), size)
    y[np.arange(len(at)) + w.doc[at]] = ids[np.arange(len(at)) + (begin - upto[:-1])[at]]
    return y, start


class Stream:
    """Symbols of a run of texts (start: where each begins, and the end of all) and their windows."""

    def __init__(self, y: np.ndarray, start: np.ndarray):
        self.y, self.start = y, start
        each = -(-np.diff(start) // STRIDE)
        self.doc = np.repeat(np.arange(len(each)), each)
        self.first = start[self.doc] + STRIDE * (np.arange(len(self.doc)) - np.repeat(np.cumsum(each) - each, each))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs, which of them are of the text, targets, which of them are) of the windows; a text begins with the symbol TOP."""
        first, doc = self.first[which], self.doc[which]
        at = first[:, None] + np.arange(-CONTEXT, STRIDE)[None, :]
        begin = self.start[doc][:, None]
        valid = (at >= begin) & (at < self.start[doc + 1][:, None])
        at = np.clip(at, 0, max(0, len(self.y) - 1))
        x = np.where(at == begin, TOP, self.y[at - 1])
        return x, valid, self.y[at[:, CONTEXT:]], valid[:, CONTEXT:]


_IDS = "doc_id long, ver long, held_out boolean, n_words long, ids binary, id int, n long"


def _encode(content):
    """A row (doc_id, ver, held_out, n_words, ids) for each text, with its subword ids as 16-bit numbers, and rows (id, n) of their counts in training texts."""

    def run(batches):
        sub = Subwords(content.value)
        total = np.zeros(sub.size + 1, np.int64)
        none = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            for a, b, w, h, out in _texts(batch):
                y, start = subwords_of(w, h, sub)
                total += np.bincount(y[~np.repeat(out, np.diff(start))], minlength=len(total))
                raw = y.astype(np.uint16).tobytes()
                ids = pa.array([raw[2 * x : 2 * z] for x, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)], pa.binary())
                ver = signed(span_hashes(h, w.bound[:-1], w.bound[1:], 62))
                m = b - a
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, m), pa.array(ver), pa.array(out), pa.array(w.counts), ids, none(m, pa.int32()), none(m, pa.int64())], ["doc_id", "ver", "held_out", "n_words", "ids", "id", "n"])
        at = np.flatnonzero(total)
        m = len(at)
        yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.int64()), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.binary()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["doc_id", "ver", "held_out", "n_words", "ids", "id", "n"])

    return run


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, subword ids, starts) of runs of rows with about CHUNK bytes of ids."""
    ids = batch.column("ids")
    for a, b, data, off in chunks(ids, CHUNK):
        yield a, b, np.ascontiguousarray(data).view(np.uint16), off // 2


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _train(shared, symbols, rate):
    """Sums over shards of the weights after a pass over a shard's windows, times their number, in integers; rows come sorted by shard.

    A shard's texts are cut into runs by their own lengths, so neither the
    batches that Arrow makes nor the shards before play a part.
    """

    def step(texts: list[bytes], weights: dict, state: dict) -> int:
        start = np.append(0, np.cumsum([len(t) // 2 for t in texts]))
        s = Stream(symbols.value.of[np.frombuffer(b"".join(texts), np.uint16)], start)
        order = np.random.default_rng(len(s.first)).permutation(len(s.first))
        for a in range(0, len(order), STEP_WINDOWS):
            fit(weights, *s.windows(order[a : a + STEP_WINDOWS]), state, rate)
        return len(order)

    def shards(batches) -> Iterator[tuple[np.ndarray, int]]:
        shard = None
        for batch in batches:
            for own, raw in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if own != shard:
                    if shard is not None:
                        seen += step(texts, weights, state) if texts else 0
                        yield _flat(weights), seen
                    shard, weights, state, texts, held, seen = own, {k: v.copy() for k, v in shared.value.items()}, {}, [], 0, 0
                texts.append(raw.as_py())
                held += len(texts[-1])
                if held >= CHUNK:
                    seen += step(texts, weights, state)
                    texts, held = [], 0
        if shard is not None:
            seen += step(texts, weights, state) if texts else 0
            yield _flat(weights), seen

    def run(batches):
        total, windows, n = 0, 0, 0

        def sums():
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), windows))], ["i", "w", "seen"])

        for flat, seen in shards(batches):
            total = total + np.round(flat.astype(np.float64) * FIXED).astype(np.int64) * seen
            windows, n = windows + seen, n + 1
            if n == SUM_SHARDS:
                yield sums()
                total, windows, n = 0, 0, 0
        if n:
            yield sums()

    return run


#: Weights are added up as integers, in steps of 1/FIXED.
FIXED = 2**30


def train(ids: DataFrame, symbols, rounds: int | None = None) -> dict[str, np.ndarray]:
    """Weights from the rows (doc_id, ver, ids) of the training texts; rows that are equal in doc_id and text are in one shard."""
    spark = ids.sparkSession
    rounds = ROUNDS if rounds is None else rounds
    weights = first_weights(symbols.value.share)
    windows = ids.agg(F.sum(F.ceil(F.octet_length("ids") / (2 * STRIDE)))).first()[0] or 0
    shards = max(1, round(windows / max(1, rounds) / SHARD_WINDOWS))
    dealt = ids.select(F.xxhash64("doc_id", "ver").alias("lot"), "doc_id", "ver", "ids")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        own = dealt.where(F.pmod("lot", F.lit(rounds)) == r).withColumn("shard", F.pmod(F.xxhash64("lot", F.lit(r)), F.lit(shards)))
        part = own.repartition("shard").sortWithinPartitions("shard", "lot", "doc_id", "ver").select("shard", "ids")
        sums = part.mapInArrow(_train(shared, symbols, 0.02 / (1 + r)), "i int, w long, seen long").groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("seen").alias("seen"))
        got = sums.collect()  # one row for each weight, however many shards there are
        if got:
            flat = np.zeros(len(got), np.float32)
            flat[[g[0] for g in got]] = [int(g[1]) / g[2] / FIXED for g in got]
            at = 0
            for k in sorted(weights):
                n = weights[k].size
                weights[k] = flat[at : at + n].reshape(weights[k].shape)
                at += n
    return weights


def scores(weights: dict, symbols: Symbols, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each subword of texts, given those before it in its window."""
    s = Stream(symbols.of[y], start)
    out = symbols.rare[y]
    for a in range(0, len(s.first), 512):
        which = np.arange(a, min(a + 512, len(s.first)))
        x, valid, goal, mask = s.windows(which)
        hidden, _ = attend(weights, x, valid)
        at = np.flatnonzero(mask.ravel())
        place = (s.first[which][:, None] + np.arange(STRIDE)[None, :]).ravel()[at]
        out[place] += log_probabilities(weights, hidden.reshape(-1, WIDTH)[at], goal.ravel()[at])
    return out


def _score(symbols, shared):
    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, y, start in _streams(batch):
                out.append(np.add.reduceat(scores(shared.value, symbols.value, y, start), start[:-1]) / np.log(10))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ver", "held_out", "n_words")), pa.array(np.concatenate(out))], ["doc_id", "ver", "held_out", "n_words", "score"])

    return run


_POSTINGS = "bucket int, part long, ids array<long>, vers array<long>, words binary, counts binary, sizes binary, owners binary, times binary"
_SUMS = "part long, ids array<long>, vers array<long>, owners binary, logs binary, known binary, distinct long"


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    cols = list(zip(*out, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _postings(buckets: int):
    """For each run of texts (a part) and bucket a row of its distinct words, their training counts, and the texts that have them; and a row with the texts, in a bucket of negative number."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, w, h, out in _texts(batch):
                vers = signed(span_hashes(h, w.bound[:-1], w.bound[1:], 62))
                rows = [(-1 - part % buckets, part, ids[a:b], vers.tolist(), None, None, None, None, None)]
                key = np.lexsort((w.doc, h))
                hs, ds = h[key], w.doc[key]
                new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])) if len(hs) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                times, word, owner = np.diff(np.append(at, len(hs))), hs[at], ds[at]
                begin = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else at
                values, size = word[begin], np.diff(np.append(begin, len(word)))
                counts = np.add.reduceat(times * ~out[owner], begin) if len(begin) else times
                # hashes are in order, and buckets are ranges of them
                edge = [*np.searchsorted(values, np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)).tolist(), len(values)]
                begin = np.append(begin, len(word))
                for i in range(buckets):
                    x, y = edge[i], edge[i + 1]
                    if x < y:
                        own = slice(begin[x], begin[y])
                        rows.append((i, part, None, None, values[x:y].tobytes(), counts[x:y].astype(np.int32).tobytes(), size[x:y].astype(np.int32).tobytes(), owner[own].astype(np.int32).tobytes(), times[own].astype(np.int32).tobytes()))
                yield _rows(rows, _POSTINGS)
                part += 1

    return run


def _bucket_sums(group: pa.Table) -> pa.Table:
    """A row of sums for each row of postings, the rows of texts as they are, and a row with the number of distinct training words."""
    rows = group.to_pylist()
    if rows[0]["bucket"] < 0:
        return pa.Table.from_batches([_rows([(r["part"], r["ids"], r["vers"], None, None, None, None) for r in rows], _SUMS)])
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    counts = [np.frombuffer(r["counts"], np.int32) for r in rows]
    values, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(values))
    out = [(-1 - rows[0]["bucket"], None, None, None, None, None, int((total > 0).sum()))]
    log, at = np.log10(total + 0.1), 0
    for r, own in zip(rows, words, strict=True):
        place = inverse[at : at + len(own)]
        at += len(own)
        owner, back = np.unique(np.frombuffer(r["owners"], np.int32), return_inverse=True)
        times = np.frombuffer(r["times"], np.int32)
        each = np.repeat(place, np.frombuffer(r["sizes"], np.int32))
        logs = np.bincount(back, weights=log[each] * times, minlength=len(owner))
        known = np.bincount(back, weights=(total[each] > 0) * times, minlength=len(owner)).astype(np.int64)
        out.append((r["part"], None, None, owner.tobytes(), logs.tobytes(), known.tobytes(), None))
    return pa.Table.from_batches([_rows(out, _SUMS)])


def _part_sums(group: pa.Table) -> pa.Table:
    """(doc_id, ver, logs, known) of each text of a part; for the numbers of distinct words a row with ver null and the number as known."""
    rows = group.to_pylist()
    texts = next((r for r in rows if r["ids"] is not None), None)
    if texts is None:
        return pa.Table.from_batches([_rows([(None, None, 0.0, r["distinct"]) for r in rows], _TEXTS)])
    logs, known = np.zeros(len(texts["ids"])), np.zeros(len(texts["ids"]), np.int64)
    for r in rows:
        if r["owners"] is not None:
            owner = np.frombuffer(r["owners"], np.int32)
            logs[owner] += np.frombuffer(r["logs"], np.float64)
            known[owner] += np.frombuffer(r["known"], np.int64)
    return pa.Table.from_batches([_rows(list(zip(texts["ids"], texts["vers"], logs.tolist(), known.tolist(), strict=True)), _TEXTS)])


_TEXTS = "doc_id long, ver long, logs double, known long"


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end token. Rows with the same doc_id are scored
    one by one. Other columns of docs are dropped. Without training documents
    nothing is known, and base_score is that of an empty count. ``vocabulary``
    is a file that the driver reads; without it there is no score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # the vocabulary file, under a megabyte
    encoded = keep(docs.mapInArrow(_encode(content), _IDS))
    texts = encoded.where("ids is not null")
    counts = np.zeros(Subwords(content.value).size + 1, np.int64)
    for i, n in encoded.where("id is not null").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n  # a row for each subword of the vocabulary
    symbols = spark.sparkContext.broadcast(Symbols(counts))
    weights = spark.sparkContext.broadcast(train(texts.where("not held_out").select("doc_id", "ver", "ids"), symbols, rounds))
    scored = keep(texts.select("doc_id", "ver", "held_out", "n_words", "ids").mapInArrow(_score(symbols, weights), "doc_id long, ver long, held_out boolean, n_words long, score double"))
    row = scored.agg(F.sum("n_words"), F.sum(F.when(~F.col("held_out"), F.col("n_words") + 1)), F.count(F.when(~F.col("held_out"), 1))).first()
    words, train_tokens, train_docs = (x or 0 for x in row)
    buckets = max(1, -(-words // BUCKET))
    postings = docs.mapInArrow(_postings(buckets), _POSTINGS)
    sums = keep(postings.groupBy("bucket").applyInArrow(_bucket_sums, _SUMS).groupBy("part").applyInArrow(_part_sums, _TEXTS))
    distinct = (sums.where("ver is null").agg(F.sum("known")).first()[0] or 0) + (train_docs > 0)
    # rows with the same doc_id and words have the same sums
    sums = sums.where("ver is not null").dropDuplicates(["doc_id", "ver"]).select(F.col("doc_id").alias("_id"), F.col("ver").alias("_ver"), "logs", "known")
    below = float(np.log10(train_tokens + 0.1 * (distinct + 1)))
    tokens = F.col("n_words") + 1
    return scored.join(sums, scored["doc_id"].eqNullSafe(F.col("_id")) & (F.col("ver") == F.col("_ver")), "left").select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.coalesce("known", F.lit(0)) + F.lit(int(train_docs > 0))).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10(train_docs + 0.1))) - tokens * F.lit(below)).alias("base_score"),
        "score",
    )
