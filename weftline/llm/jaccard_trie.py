"""Near-duplicate documents by an exact n-gram Jaccard join on prefix trees.

1. Every text becomes the set of the hashes of its word n-grams. Texts with
   equal sets form a class; only its member with the smallest doc_id goes on.
2. Globally ordered prefixes find the candidates. N-grams whose hash lies in
   the lowest ``SHARE`` come first, rarest first, then the others. Two sets
   that link have an n-gram in common among the first n - ceil(t n) + 1 of
   each. Document frequencies are counted exactly, in hash buckets of packed
   arrays; n-grams of one document only use up its prefix, and a document all
   of whose prefix is unique is done. Very frequent n-grams, found in the first
   pass, come last and are not counted, so no bucket gathers a hot one.
3. Each n-gram of a prefix ties its documents to the least of them. The
   connected parts of these ties are the blocks; all links are inside a block.
4. The sets of a block are stored in a radix trie. Every set is looked up among
   those that are not longer: overlaps are summed along shared paths, level by
   level, and a subtree is left as soon as the n-grams that remain can't reach
   the required overlap, or if all its sets are connected with the probe
   already. A block of over ``BLOCK_SETS`` sets is dealt into segments, and
   each pair of segments is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import having, keep
from .words import Words, chunks, lower_ascii, signed, space_table, span_hashes

#: Part of the n-grams, by hash, that is counted and ordered by frequency.
SHARE = 0.4
#: N-grams in this share of the documents or more come last in the order.
FREQUENT = 0.01
#: Counted n-grams in one bucket.
BUCKET = 1_000_000
#: N-grams that are packed together.
PACK = 500_000
#: Bytes of text whose n-grams are made at once: some 60 bytes of temporary arrays for each.
TEXT_BYTES = 1 << 18
#: Sets in one segment; a trie holds those of two segments at most.
BLOCK_SETS = 2_000

_LIMIT = np.uint64(int(SHARE * 2**64))


def _sets(column, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct n-gram hashes of each text); fewer than n words are one n-gram."""
    table = space_table()
    for a, b, data, off in chunks(column, TEXT_BYTES):
        w = Words(lower_ascii(data), off, table)
        h = w.hashes()
        grams = span_hashes(h, (at := w.windows(n)), at + n, 51)
        bounds = np.searchsorted(at, w.bound)
        out = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
        for i in np.flatnonzero((w.counts > 0) & (w.counts < n)):
            out[i] = span_hashes(h, w.bound[i : i + 1], w.bound[i + 1 : i + 2], 51)
        yield a, out
    pa.default_memory_pool().release_unused()  # a worker stays, and what it keeps for later batches would count in the stages after this one


def _prints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    bound = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    return [signed(span_hashes(flat, bound[:-1], bound[1:], seed)) for seed in (52, 53)]


def _prefix_size(n, num: int):
    """How many n-grams of a set of n must be looked at: n - ceil(num n / 100) + 1."""
    return n - (num * n + 99) // 100 + 1


def _first_pass(n: int):
    """Rows of documents (doc_id, n, k, f1, f2), and rows of n-grams (gram, df) that are frequent in a run of texts."""

    def run(batches):
        for batch in batches:
            for a, sets in _sets(batch.column("text"), n):
                f1, f2 = _prints(sets)
                size = np.array([len(s) for s in sets], np.int64)
                low = np.array([np.searchsorted(s, _LIMIT) for s in sets], np.int64)
                m = len(sets)
                kinds = [pa.int64()] * 7
                names = ["doc_id", "n", "k", "f1", "f2", "gram", "df"]
                own = [batch.column("doc_id").slice(a, m), size, low, f1, f2, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(own, kinds, strict=True)], names)
                seen, often = _frequent(sets, max(3, FREQUENT / 2 * m))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(seen), pa.int64()) for _ in range(5)), pa.array(signed(seen)), pa.array(often)], names)

    return run


def _frequent(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Low n-grams that stand in ``least`` or more of the sets, and in how many."""
    part = np.sort(np.concatenate([np.zeros(0, np.uint64), *(s[: np.searchsorted(s, _LIMIT)] for s in sets)]))
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(part)))
    big = count >= least
    return part[start[big]], count[big].astype(np.int64)


def _packed(n: int, num: int, buckets: int, frequent):
    """Rows (bucket, ids, grams, owners): the n-grams to count, by bucket, each with the place of its set among ids.

    Frequent n-grams go to buckets of negative number, one for each run of
    texts, which are not counted.
    """

    def run(batches):
        hot = frequent.value
        width = int(_LIMIT) // buckets + 1
        number = -1 - (TaskContext.get().partitionId() << 32)

        def flush(ids, grams, owners):
            ids, g, o = np.array(list(ids), np.int64), np.concatenate(grams), np.concatenate(owners)
            grams.clear()
            owners.clear()
            bucket = ((g % _LIMIT) // np.uint64(width)).astype(np.int64)
            if len(hot):
                bucket[hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g] = number
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            g, o, bucket = g[order], o[order], bucket[order]
            which, start = np.unique(bucket, return_index=True)
            stop = np.append(start[1:], len(bucket))
            rows = []
            for b, x, y in zip(which.tolist(), start, stop, strict=True):
                docs, own = np.unique(o[x:y], return_inverse=True)
                rows.append((b, ids[docs].tobytes(), g[x:y].tobytes(), own.astype(np.uint32 if len(docs) > 65_000 else np.uint16).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "ids", "grams", "owners"])

        ids, grams, owners, held = {}, [], [], 0
        for batch in batches:
            for _, sets in _sets(batch.column("text"), n):
                for s, f in zip(sets, _prints(sets)[0].tolist(), strict=True):
                    if len(s) and f not in ids:
                        own = s[: max(int(np.searchsorted(s, _LIMIT)), _prefix_size(len(s), num))]
                        grams.append(own.copy())  # a view would hold the whole set
                        owners.append(np.full(len(own), len(ids), np.uint32))
                        ids[f] = True
                        held += len(own)
                if held >= PACK:
                    yield flush(ids, grams, owners)
                    number -= 1
                    ids, grams, owners, held = {}, [], [], 0
        if held:
            yield flush(ids, grams, owners)

    return run


def _counted(group: pa.Table) -> pa.Table:
    """(f1, gram, df): of each set the n-grams of this bucket that other sets have too."""
    g, d = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ids, grams, owners in zip(*(group.column(c).to_pylist() for c in ("ids", "grams", "owners")), strict=True):
        ids = np.frombuffer(ids, np.int64)
        g.append(np.frombuffer(grams, np.uint64))
        d.append(ids[np.frombuffer(owners, np.uint32 if len(ids) > 65_000 else np.uint16)])
    g, d = np.concatenate(g), np.concatenate(d)
    order = np.lexsort((d, g)) if len(g) else np.zeros(0, np.int64)
    g, d = g[order], d[order]
    new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])) if len(g) else np.zeros(0, bool)
    g, d = g[new], d[new]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(g)))
    df = np.repeat(count, count)
    if group.column("bucket")[0].as_py() < 0:
        df[:] = 2**31 - 1
    several = df > 1
    return pa.Table.from_arrays([pa.array(d[several]), pa.array(signed(g[several])), pa.array(df[several].astype(np.int32))], ["f1", "gram", "df"])


def _prefixes(num: int):
    """(node, gram) of the shared n-grams in each set's prefix.

    Of k low n-grams, those that no other set has stand first in the order;
    then the shared by frequency, the frequent, and those that aren't low by hash.
    """

    def run(batches):
        for batch in batches:
            ids, sizes, lows = (batch.column(c).to_pylist() for c in ("f1", "n", "k"))
            grams, dfs = batch.column("grams"), batch.column("dfs")
            go, fo = grams.offsets.to_numpy(), dfs.offsets.to_numpy()
            gv, fv = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), dfs.values.to_numpy(zero_copy_only=False)
            nodes, out = [], [np.zeros(0, np.int64)]
            for i in range(len(ids)):
                g, at = np.unique(gv[go[i] : go[i + 1]], return_index=True)  # a frequent one comes from each run of texts with the set
                f = fv[fo[i] : fo[i + 1]][at]
                low = g < _LIMIT
                p = _prefix_size(sizes[i], num)
                room = p - (lows[i] - int(low.sum()))
                if room <= 0:
                    continue
                take = g[low][np.lexsort((g[low], f[low]))][:room]
                if p > lows[i]:  # all that is low is in the prefix, and what was sent beyond it
                    take = np.concatenate([take, g[~low]])
                out.append(signed(take))
                nodes.append(np.full(len(take), ids[i], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([out[0], *nodes])), pa.array(np.concatenate(out))], ["node", "gram"])

    return run


def _full_sets(n: int):
    """(f1, f2, n, rep, grams) of the texts whose set is asked for."""

    def run(batches):
        for batch in batches:
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist()
            rows = []
            for a, sets in _sets(batch.column("text"), n):
                f1, f2 = _prints(sets)
                rows += [(int(f1[i]), int(f2[i]), len(s), ids[a + i], s.tobytes()) for i, s in enumerate(sets) if int(f1[i]) in asked[a + i]]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["f1", "f2", "n", "rep", "grams"])

    return run


class Trie:
    """Sets of n-grams (sorted arrays) as a radix trie in flat arrays, and a union-find over them.

    Nodes are runs of n-grams that all sets below share. The sets are in
    lexicographic order, so that the sets below a node are neighbours.
    """

    def __init__(self, sets: list[np.ndarray], num: int):
        self.num = num
        # n-grams by their rank among those of the sets, which keeps their order
        size = np.array([len(s) for s in sets], np.int64)
        own = np.append(0, np.cumsum(size))
        self.grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ranks = [flat[own[i] : own[i + 1]].astype(np.int32) for i in range(len(sets))]
        self.order = sorted(range(len(sets)), key=lambda i: ranks[i].astype(">i4").tobytes())
        self.sets, self.size = [ranks[i] for i in self.order], size[self.order]
        self.up = np.arange(len(sets))
        self._build()

    def _build(self) -> None:
        n = len(self.sets)
        common = np.zeros(n + 1, np.int64)
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[i] = differ[0] if len(differ) else m
        # nodes as (first set, end, depth, parent), from the common prefixes of neighbours
        nodes: list[list[int]] = [[0, n, 0, -1]]
        stack = [0]
        for i in range(n):
            depth = int(common[i])
            last = -1
            while nodes[stack[-1]][2] > depth:
                last = stack.pop()
                nodes[last][1] = i
            if nodes[stack[-1]][2] < depth:  # a new branching point over what was closed last
                new = len(nodes)
                nodes.append([nodes[last][0], n, depth, stack[-1]])
                nodes[last][3] = new
                stack.append(new)
            nodes.append([i, i + 1, len(self.sets[i]), stack[-1]])
            stack.append(len(nodes) - 1)
            # a set's own node is closed by the next common prefix, which is never deeper
            if i + 1 < n and nodes[stack[-1]][2] <= common[i + 1]:
                stack.pop()
                if nodes[stack[-1]][2] < common[i + 1]:
                    new = len(nodes)
                    nodes.append([i, n, int(common[i + 1]), stack[-1]])
                    nodes[new - 1][3] = new
                    stack.append(new)
        low, high, depth, parent = (np.array(c, np.int64) for c in zip(*nodes, strict=True))
        self.low, self.high, self.depth = low, high, depth
        self.leaf = np.full(len(nodes), -1, np.int64)
        own = (high - low == 1) & (depth == self.size[np.minimum(low, n - 1)])
        self.leaf[own] = low[own]
        above = np.where(parent >= 0, depth[np.maximum(parent, 0)], 0)
        self.above = above
        runs = [self.sets[low[i]][above[i] : depth[i]] for i in range(len(nodes))]
        self.run_start = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int64)
        self.runs = np.concatenate(runs)
        self.kids = np.argsort(parent, kind="stable")
        self.kid_start = np.searchsorted(parent[self.kids], np.arange(len(nodes) + 1))
        self.least = np.array([self.size[a:b].min() for a, b in zip(low, high, strict=True)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(low, high, strict=True)])
        # the order in which a walk enters and leaves the nodes: sums along paths are then one running sum
        self.enter, self.leave = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        walk, at = [0], 0
        while walk:
            i = walk.pop()
            (self.enter if i >= 0 else self.leave)[i if i >= 0 else ~i] = at
            at += 1
            if i >= 0:
                walk += [~i, *self.kids[self.kid_start[i] : self.kid_start[i + 1]].tolist()]
        self.ends = np.flatnonzero(self.leaf >= 0)
        size = np.diff(self.run_start)
        walk = np.zeros(2 * len(nodes), np.int64)
        walk[self.enter] = size
        walk = np.cumsum(walk)
        self.below = walk[self.leave] - walk[self.enter] + size
        self._refresh()

    def _all(self, mark: np.ndarray, n: int) -> np.ndarray:
        """The sets, not longer than n, that link with the marked one, from the overlaps of all."""
        upto = np.zeros(len(self.runs) + 1, np.int32)
        np.cumsum(mark[self.runs], out=upto[1:])
        hits = upto[self.run_start[1:]] - upto[self.run_start[:-1]]
        walk = np.zeros(2 * len(hits), np.int32)
        walk[self.enter], walk[self.leave] = hits, -hits
        shared = np.cumsum(walk)[self.enter[self.ends]]
        own = self.leaf[self.ends]
        size = self.size[own]
        return own[(size <= n) & (shared >= -(-self.num * (n + size) // (100 + self.num)))]

    def _refresh(self) -> None:
        """Which single component the sets below each node belong to, or -1."""
        root = self.up
        while not np.array_equal(root, root[root]):
            root = root[root]
        change = np.append(0, np.cumsum(root[1:] != root[:-1]))
        self.root = root
        self.only = np.where(change[self.high - 1] == change[self.low], root[self.low], -1)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return int(i)

    def link_all(self) -> None:
        """Look every set up among those that are not longer, and unite it with what it links to."""
        mark = np.zeros(len(self.grams), bool)
        for turn, i in enumerate(np.argsort(self.size, kind="stable").tolist()):
            if turn % 64 == 0:
                self._refresh()
            s = self.sets[i]
            mark[s] = True
            linked = self._probe(s, mark, self.find(i))
            for j in np.unique(self.root[linked]).tolist():  # one of each component, as last refreshed
                a, b = self.find(i), self.find(j)
                self.up[max(a, b)] = min(a, b)
            mark[s] = False

    def _probe(self, s: np.ndarray, mark: np.ndarray, component: int) -> np.ndarray:
        """The sets, not longer than s, that link with it; those known to be in its component may be left out.

        All nodes of a level are handled together.
        """
        n, num = len(s), self.num
        least_size = -(-num * n // 100)
        found = [np.zeros(0, np.int64)]
        nodes, shared = self.kids[self.kid_start[0] : self.kid_start[1]], 0
        shared = np.zeros(len(nodes), np.int64)
        while len(nodes):
            low = np.maximum(self.least[nodes], least_size)
            need = -(-num * (n + low) // (100 + num))
            start = self.run_start[nodes]
            length = self.run_start[nodes + 1] - start
            left = n - np.searchsorted(s, self.runs[np.minimum(start, len(self.runs) - 1)])
            left = np.where(length > 0, left, n)
            ok = (self.most[nodes] >= least_size) & (self.least[nodes] <= n) & (self.only[nodes] != component)
            ok &= shared + np.minimum(self.most[nodes] - self.above[nodes], left) >= need
            nodes, shared, start, length, need = nodes[ok], shared[ok], start[ok], length[ok], need[ok]
            if not len(nodes):
                break
            ends = np.cumsum(length)
            if self.below[nodes].sum() * 4 > len(self.runs) and len(self.leaf) > 64:
                return np.concatenate([*found, self._all(mark, n)])  # little was left out: all paths at once are cheaper
            hits = np.append(0, np.cumsum(mark[self.runs[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)]]))
            shared = shared + hits[ends] - hits[ends - length]
            own = self.leaf[nodes]
            done = own >= 0
            good = own[done][shared[done] >= -(-num * (n + self.size[own[done]]) // (100 + num))]
            found.append(good)
            go = ~done & (shared + np.minimum(self.most[nodes] - self.depth[nodes], n) >= need)
            nodes, shared = nodes[go], shared[go]
            times = self.kid_start[nodes + 1] - self.kid_start[nodes]
            ends = np.cumsum(times)
            nodes, shared = self.kids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.kid_start[nodes] - (ends - times), times)], np.repeat(shared, times)
        return np.concatenate(found)


def _join(num: int):
    """Links (a, b) as sets' places (rep, f1, f2) of every set to its component's least, from rows sorted by block and segments."""

    def flush(rows, sets):
        trie = Trie(sets, num)
        trie.link_all()
        least: dict[int, tuple] = {}
        root = [0] * len(rows)
        for at, i in enumerate(trie.order):
            root[i] = r = trie.find(at)
            least[r] = min(least.get(r, rows[i]), rows[i])
        cols = list(zip(*((*own, *least[r]) for own, r in zip(rows, root, strict=True)), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "f1", "f2", "root_rep", "root_f1", "root_f2"])

    def run(batches):
        key, rows, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j")), strict=True))
            own = list(zip(*(batch.column(c).to_pylist() for c in ("rep", "f1", "f2")), strict=True))
            grams = batch.column("grams")
            for at, k in enumerate(keys):
                if k != key:
                    if rows:
                        yield flush(rows, sets)
                    key, rows, sets = k, [], []
                sets.append(np.frombuffer(grams[at].as_py(), np.uint64))
                rows.append(own[at])
        if rows:
            yield flush(rows, sets)

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union of their sets
    of word n-grams; component_id is the smallest doc_id that can be reached.
    Null and empty texts have no n-grams and link with nothing. A row with a
    null doc_id links with nothing and has a null component_id. Rows that share
    a doc_id are judged one by one. Other columns of docs are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    found = keep(docs.mapInArrow(_first_pass(n), "doc_id long, n long, k long, f1 long, f2 long, gram long, df long"))
    base = found.where("n is not null").select("doc_id", "n", "k", "f1", "f2")
    rows, grams = base.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    # at most 2 / FREQUENT times the n-grams of an average document
    hot = found.where("gram is not null").groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= FREQUENT * rows).select("gram").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64)))
    buckets = max(1, -(-int(grams) // BUCKET))

    sets = base.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n", "k").agg(F.min("doc_id").alias("rep"))
    counted = docs.where("doc_id is not null").mapInArrow(_packed(n, percent, buckets, frequent), "bucket long, ids binary, grams binary, owners binary").groupBy("bucket").applyInArrow(_counted, "f1 long, gram long, df int")
    shared = counted.groupBy("f1").agg(F.collect_list(F.struct("gram", "df")).alias("s")).select("f1", F.col("s.gram").alias("grams"), F.col("s.df").alias("dfs"))
    ties = keep(sets.select("f1", "n", "k").join(shared, "f1").mapInArrow(_prefixes(percent), "node long, gram long"))
    least = ties.groupBy("gram").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last")
    edges = ties.join(least, "gram").where("node > b").select(F.col("node").alias("a"), "b").distinct()
    blocks = keep(components(edges).select(F.col("node").alias("f1"), F.col("root").alias("block")))

    asked = keep(sets.join(blocks.select("f1"), "f1").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("f1").alias("asked")))
    full = having(docs, asked).join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_full_sets(n), "f1 long, f2 long, n long, rep long, grams binary")
    sizes = blocks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("segments"))
    segment = F.pmod(F.xxhash64("f1"), F.col("segments")).cast("int")
    work = full.dropDuplicates(["f1", "f2"]).join(blocks, "f1").join(sizes, "block").withColumn("own", segment)
    other = F.explode(F.sequence(F.lit(0), F.col("segments") - 1))
    work = work.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    # a set meets each segment, its own included, in one task
    ordered = work.select("block", "i", "j", "n", "f1", "f2", "rep", "grams").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "f1", "f2")
    links = keep(ordered.mapInArrow(_join(percent), "rep long, f1 long, f2 long, root_rep long, root_f1 long, root_f2 long").where("rep != root_rep or f1 != root_f1 or f2 != root_f2"))
    if sizes.where("segments > 1").isEmpty():
        roots = links.select("f1", "f2", "root_rep")
    else:
        node = lambda p: F.struct(F.col(f"{p}rep").alias("rep"), F.col(f"{p}f1").alias("f1"), F.col(f"{p}f2").alias("f2"))
        roots = components(links.select(node("").alias("a"), node("root_").alias("b"))).select("node.f1", "node.f2", F.col("root.rep").alias("root_rep"))
    known = sets.join(roots, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("root_rep", "rep").alias("root"))
    out = base.join(known, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, that are not a duplicate of one with a smaller doc_id."""
    gone = near_duplicates(docs, n, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
