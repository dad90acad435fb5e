"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line's shingles are all its runs of ``SHINGLE`` characters (UTF-16 units); a
shorter line is one shingle. They are cut from the line's UTF-16 bytes, where a
character's place is known, so a long line takes no longer a character than a
short one.
Lines of equal content are one class from the start.

A class's signature is a one-permutation MinHash: one hash of every shingle
says which of ``HALVES`` * ``BANDS`` * ``ROWS`` bins it falls into and its value
there, and each bin keeps its least value. Of a line with many shingles only
values that are low enough to be a least one are aggregated, some ``PER_BIN``
for each bin; a line that leaves many bins empty by that, as its shingles
repeat, is gone through once more without the limit. An empty bin takes the
value of another one of its half, in a fixed random order. The minima are plain
``min`` aggregates, so partial sums are made before the shuffle.

Classes with equal values in all rows of a band share a bucket. Of each bucket
all members are compared with its pivot, the member that stands most often, by
the exact Jaccard similarity of their shingle sets, and distributed union-find
joins the links: of variants of one line that are less like each other than like
the line they come from, that line is mostly the pivot. Where the lines of one
pivot are in several components by then, they are compared with up to ``REFERENCES``
frequent ones of them, too. What still is apart is compared with each other by an
exact prefix join: their shingles are ordered, those that none of the references
has first, and of a line's n shingles one of the first n - ceil(t n) + 1 stands
among those of every line that it links with, with enough others behind it (the
positional bound). Of shingles that stand in the same lines only the first is a
key, as a pair of lines that meets at one of them meets at all. Of the prefixes
only ``MARKS`` bits go along, one set for each shingle. A bit that the other line
hasn't is a shingle that it hasn't, so most pairs with too few in common don't
meet; the others are looked up, a row for each pair. What lines of a bucket
have in common, one of the references has mostly too, so unlike lines hardly
meet. Those that do, and whose sizes can be alike, are compared, in blocks of
``BLOCK`` lines, so that a frequent shingle is many small keys. So no two lines
that share a bucket and meet the threshold stay apart. Of each component the line
that comes first, by doc_id and line, stays.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import BROADCAST_IDS, fresh, having, keep

SHINGLE = 12
#: A signature has so many halves, aggregated apart, with so many bands each.
HALVES = 2
BANDS = 4
ROWS = 4
BINS = BANDS * ROWS
#: Values of a bin that are looked at on average, if a line has so many shingles.
PER_BIN = 2.5
PERCENT = 75
#: Lines that share a shingle in one block of their join.
BLOCK = 256
#: Lines of a pivot, besides itself, that order the shingles of the others.
REFERENCES = 4
#: Bits that stand for a line's prefix where lines meet at a shingle of it.
MARKS = 1024


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), line_no from 0, line and its two hashes h1 and h2, for lines with a word."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _places(points) -> F.Column:
    """The bytes, from 1, at which a line's shingles begin in its UTF-16 bytes."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(points) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))


def _shingle(points, place) -> F.Column:
    return F.substring(points, place, F.lit(2 * SHINGLE))


def _bound(value, use) -> F.Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _set(line) -> F.Column:
    """The distinct shingles of a line, as hashes. Spark compiles array functions that stand outside of lambdas, so the distinct ones are taken there."""
    return F.array_distinct(_bound(F.encode(line, "UTF-16BE"), lambda points: F.transform(_places(points), lambda i: F.xxhash64(_shingle(points, i)))))


def _alike(n, m, both, percent: int) -> F.Column:
    """Whether sets of n and m shingles, both of them in common, reach the similarity of percent."""
    return both * 100 >= F.lit(percent) * (n + m - both)


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs, where n (the size of the line's set) and alike (whether the sets' similarity reaches percent) stand for line and other."""
    rest = [c for c in pairs.columns if c not in ("line", "other")]
    sets = pairs.select(*rest, _set(F.col("line")).alias("x"), _set(F.col("other")).alias("y"))
    n, m, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    return sets.select(*rest, n.alias("n"), _alike(n, m, both, percent).alias("alike"))


def _ordered(x, root, refs, percent: int) -> tuple[F.Column, F.Column]:
    """Of a line's set its prefix, those shingles that no reference has first, then by the first reference that has them; and the other roots of the references that the line is alike."""
    n, left, order, near = F.size(x), x, [], []
    room = n - F.ceil(n * percent / F.lit(100)).cast("int") + 1
    for j in range(REFERENCES + 1):
        ref = F.get(refs, F.lit(j))
        has = F.coalesce(ref["set"], F.array().cast("array<long>"))
        # what this reference has goes before what references before it have
        order.insert(0, F.sort_array(F.array_intersect(left, has)))
        near.append(F.when((ref["root"] != root) & _alike(n, F.size(has), F.size(F.array_intersect(x, has)), percent), ref["root"]))
        left = F.array_except(left, has)
    return F.slice(F.concat(F.sort_array(left), *order), F.lit(1), room), F.array_distinct(F.array_compact(F.array(*near)))


def _minima(lines: DataFrame, limited: bool) -> DataFrame:
    """h1, half, cut (whether values were limited), score (rows, so more for a line that stands often) and the bins' least values m0, m1, ...; null: an empty bin."""
    points = lines.select("h1", F.encode("line", "UTF-16BE").alias("points"))
    n = F.shiftright(F.octet_length("points"), 1) - (SHINGLE - 1)
    most = int(PER_BIN * HALVES * BINS)
    each = points.select("h1", (n > most).alias("cut"), n.alias("n"), "points", F.explode(_places(F.col("points"))).alias("i"))
    each = each.select("h1", "cut", "n", "i", F.hash(_shingle(F.col("points"), F.col("i"))).alias("x"))
    value = F.shiftrightunsigned("x", 16)  # the upper half of the hash; the lower one says the bin
    low = (value.cast("long") * F.col("n") < F.lit(most << 16)) | F.lit(not limited)  # holds for all values of a line that isn't cut
    each = each.where(low | (F.col("i") == 1))  # so that every line has a row
    each = each.select("h1", "cut", F.col("x").bitwiseAND(F.lit(HALVES - 1)).alias("half"), F.when(low, F.shiftright("x", 1).bitwiseAND(F.lit(BINS - 1))).alias("bin"), value.alias("v"))
    return each.groupBy("h1", "half", "cut").agg(F.count("*").alias("score"), *(F.min(F.when(F.col("bin") == b, F.col("v"))).alias(f"m{b}") for b in range(BINS)))


def _banded(minima: DataFrame) -> DataFrame:
    """h1, score, poor (limited, and many bins are empty) and bands, a hash of each band's rows."""
    rnd = random.Random(1)
    filled = sum((F.col(f"m{b}").isNotNull().cast("int") for b in range(BINS)), F.lit(0))
    some = minima.withColumn("some", F.coalesce(*(F.col(f"m{b}") for b in range(BINS))))
    value = [F.coalesce(F.col(f"m{b}"), *(F.col(f"m{i}") for i in rnd.sample([i for i in range(BINS) if i != b], 4)), F.col("some")) for b in range(BINS)]
    bands = F.array(*(F.xxhash64(F.lit(b), "half", *value[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))
    return some.select("h1", "score", (F.col("cut") & (filled < BINS / 2)).alias("poor"), bands.alias("bands"))


def _buckets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, h1, score) for every class; h2 isn't needed to find candidates."""
    first = keep(_banded(_minima(_lines(docs), True)))
    poor = first.where("poor").select("h1").distinct()
    bands = first.select("h1", "score", "bands")
    if not poor.isEmpty():
        wanted = keep(classes.join(poor, "h1").select("h1", "h2", "first.doc_id", "first.line_no"))
        bands = bands.join(wanted.select("h1"), "h1", "left_anti").unionByName(_banded(_minima(_texts(docs, wanted), False)).select("h1", "score", "bands"))
    return bands.select(F.explode("bands").alias("bucket"), "h1", "score")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2 and line of each wanted class (h1, h2 and its first place); one class for each h1."""
    return _lines(having(docs, wanted)).join(wanted, ["doc_id", "line_no", "h1", "h2"]).select("h1", "h2", "line").dropDuplicates(["h1"])


def _few(keys: DataFrame) -> DataFrame:
    """A kept table of keys, to be broadcast if there are BROADCAST_IDS of them at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def _joined(docs: DataFrame, classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """h1, h2, root (a class's h1): the components by links between classes that share a bucket, verified by their texts; those without links may be absent."""
    best = buckets.groupBy("bucket").agg(F.max(F.struct("score", "h1"))["h1"].alias("p"), F.count("*").alias("k")).where("k > 1").select("bucket", "p")
    ties = keep(buckets.join(_few(keep(best)), "bucket").groupBy("h1", "p").agg(F.max("score").alias("score")))  # a pivot is tied to itself
    wanted = keep(classes.join(ties.select("h1").distinct(), "h1").select("h1", "h2", "first.doc_id", "first.line_no"))
    texts = keep(_texts(docs, wanted))
    a, b = texts.select("h1", "line"), texts.select(F.col("h1").alias("p"), F.col("line").alias("other"))  # sets are several times longer

    def compared(pairs: DataFrame) -> DataFrame:
        return _compared(pairs.where("h1 != p").join(a, "h1").join(b, "p"), percent)

    found = keep(compared(ties).select("h1", "p", "score", "n", "alike"))
    roots = keep(_roots(found.where("alike").select(F.col("h1").alias("a"), F.col("p").alias("b"))))
    rooted = keep(found.join(roots, "h1", "left").select("h1", "p", "score", "n", F.coalesce("root", "h1").alias("root")))
    apart = _apart(rooted)
    if apart.isEmpty():
        return roots.join(texts.select("h1", "h2"), "h1")
    members = keep(_ordered_members(rooted.join(_few(apart), "p"), a, percent))
    near = members.select(F.col("root").alias("a"), F.explode("alike").alias("b"))
    level = keep(_roots(near))
    members = keep(_onto(members.drop("alike"), level))
    pairs = keep(_prefix_pairs(members.join(_few(_apart(members)), "p"), percent).distinct())
    more = keep(compared(pairs).where("alike").select(F.col("root").alias("a"), F.col("other_root").alias("b")))
    # the components of components: of roots that the references joined, and of these by the prefix join
    level = _onto(level.select("h1", "root"), more := keep(_roots(more))).union(more.select("h1", "root")).distinct()
    nodes = roots.union(level.select("h1", F.col("h1").alias("root"))).distinct()
    return _onto(nodes, level).join(texts.select("h1", "h2"), "h1")


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("h1"), "root")


def _onto(rows: DataFrame, level: DataFrame) -> DataFrame:
    """rows, where each root is replaced by its own root in level (h1, root), if it is there."""
    up = level.select(F.col("h1").alias("root"), F.col("root").alias("_up"))
    return rows.join(up, "root", "left").withColumn("root", F.coalesce("_up", "root")).select(*rows.columns)


def _apart(members: DataFrame) -> DataFrame:
    """The pivots p whose lines have more than one root."""
    return keep(members.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("p"))


def _ordered_members(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """p, h1, root, n of members with the prefix of their shingles' order, and alike, the roots of the references that they are alike."""
    lot = F.pmod(F.xxhash64("h1", F.lit(9)), F.lit(REFERENCES))
    chosen = members.groupBy("p").agg(*(F.max(F.when(lot == j, F.struct("score", "h1", "root"))).alias(f"r{j}") for j in range(REFERENCES)))
    # the pivot has been compared with all; as a reference it only orders shingles
    each = F.explode(F.array(F.struct(F.lit(None).cast("long").alias("score"), F.col("p").alias("h1"), F.lit(None).cast("long").alias("root")), *(F.col(f"r{j}") for j in range(REFERENCES))))
    chosen = chosen.select("p", each.alias("r")).where("r is not null").select("p", "r.*")
    sets = chosen.join(texts, "h1").select("p", F.struct("h1", "root", _set(F.col("line")).alias("set")).alias("r"))
    refs = keep(sets.groupBy("p").agg(F.sort_array(F.collect_list("r")).alias("refs")))  # at most REFERENCES + 1
    sets = members.join(texts, "h1").join(refs, "p").select("p", "h1", "root", "n", _set(F.col("line")).alias("x"), "refs")
    prefix, alike = _ordered(F.col("x"), F.col("root"), F.col("refs"), percent)
    return sets.select("p", "h1", "root", "n", prefix.alias("prefix"), alike.alias("alike"))


def _marks(each: DataFrame) -> DataFrame:
    """p, h1, size of the prefix and m0, m1, ..., the MARKS bits of its shingles."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 8) & 63 as int))")
    word = F.pmod("s", F.lit(MARKS // 64))
    return each.groupBy("p", "h1").agg(F.count("*").cast("int").alias("size"), *(F.coalesce(F.bit_or(F.when(word == j, bit)), F.lit(0).cast("long")).alias(f"m{j}") for j in range(MARKS // 64)))


def _prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(h1, p, root, other_root), h1 > p, of lines of one pivot and different roots that share a shingle of their prefixes and are alike in size."""
    # a shingle s of a pivot's lines is one key, by its hash; i is its place in the line's order
    each = members.select("p", "h1", "root", "n", F.posexplode("prefix").alias("i", "s")).withColumn("x", F.xxhash64("p", "s"))
    lines = F.bit_xor(F.xxhash64("h1", F.lit(3)))  # with their number and the least of them, which lines these are
    groups = each.groupBy("x").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.min("root").alias("least"), F.max("root").alias("last"), F.min("p").alias("p"), lines.alias("lines"), F.min(F.struct("h1", "i")).alias("at")).where("least != last")
    # shingles that stand in the same lines, as neighbours mostly do, have one order there: the first of them is a key for all
    groups = groups.groupBy("p", "k", "lines", F.col("at.h1").alias("h1"), "low").agg(F.min(F.struct("at.i", "x"))["x"].alias("x")).select("x", "k", "low")
    # of a pair's first common shingle: what may be common from there on must reach the overlap that the sizes ask for
    reached = lambda both, n, m: both * (100 + percent) >= (F.col(n) + F.col(m)) * percent
    enough = lambda n, i, m: reached(F.col(n) - F.col(i), n, m)
    met = each.join(_few(keep(groups)), "x").where(enough("n", "i", "low")).join(_marks(each), ["p", "h1"])
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    marks = [f"m{j}" for j in range(MARKS // 64)]
    dealt = keep(met.select("x", "p", "h1", "root", "n", "i", "size", *marks, blocks.alias("blocks"), F.pmod(F.xxhash64("h1", F.lit(5)), blocks).cast("int").alias("own")))
    one = dealt.select("x", "p", F.col("own").alias("a"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("b"), "h1", "root", "n", "i", "size", *marks)
    two = dealt.select("x", F.explode(F.expr("sequence(0, own)")).alias("a"), F.col("own").alias("b"), *(F.col(c).alias(f"{c}_2") for c in ("h1", "root", "n", "i", "size", *marks)))
    apart = (F.col("root") != F.col("root_2")) & ((F.col("a") < F.col("b")) | (F.col("h1") < F.col("h1_2")))
    near = F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * F.lit(percent)  # sets of other sizes can't be alike
    # what is common stands in both prefixes or behind the one that ends first
    behind = F.greatest(F.col("n") - F.col("size"), F.col("n_2") - F.col("size_2"))
    # each bit of one prefix that the other doesn't have is a shingle that they don't have in common
    alone = lambda m, other: sum((F.bit_count(F.col(f"m{j}{m}").bitwiseAND(F.bitwise_not(F.col(f"m{j}{other}")))) for j in range(MARKS // 64)), F.lit(0))
    common = F.least(F.col("size") - alone("", "_2"), F.col("size_2") - alone("_2", ""))
    met = one.join(two, ["x", "a", "b"]).where(apart & near & enough("n", "i", "n_2") & enough("n_2", "i_2", "n") & reached(common + behind, "n", "n_2"))
    first = F.col("h1") > F.col("h1_2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    pairs = met.select("p", pick("h1", "h1_2").alias("h1"), pick("h1_2", "h1").alias("h1_2"), pick("root", "root_2").alias("root"), pick("root_2", "root").alias("root_2")).distinct()
    # now that a pair is one row, the prefixes themselves are looked up
    own, other = members.select("p", "h1", "n", "prefix"), members.select("p", F.col("h1").alias("h1_2"), F.col("n").alias("n_2"), F.col("prefix").alias("prefix_2"))
    both = F.size(F.array_intersect("prefix", "prefix_2")) + F.greatest(F.col("n") - F.size("prefix"), F.col("n_2") - F.size("prefix_2"))
    pairs = keep(pairs).join(own, ["p", "h1"]).join(other, ["p", "h1_2"]).where(reached(both, "n", "n_2"))
    return pairs.select("h1", F.col("h1_2").alias("p"), "root", F.col("root_2").alias("other_root"))


def line_verdicts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per line with a word: doc_id, version, line_no, kept, and the first line of its component (root_doc, root_line).

    Rows of docs with a null text have no lines; rows with a null doc_id are
    left out. Lines without a word are neither compared nor reported.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = keep(_lines(docs).select("doc_id", "version", "line_no", "h1", "h2"))
    classes = keep(keys.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    near = keep(classes.join(_joined(docs, classes, _buckets(docs, classes), percent), ["h1", "h2"]))
    roots = near.groupBy("root").agg(F.min("first").alias("kept"))
    known = near.join(roots, "root").select("h1", "h2", "kept")
    known = classes.join(known, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("kept", "first").alias("root"))
    own = F.struct("doc_id", "line_no")
    return keys.join(known, ["h1", "h2"]).select("doc_id", "version", "line_no", (own == F.col("root")).alias("kept"), F.col("root.doc_id").alias("root_doc"), F.col("root.line_no").alias("root_line"))


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, version, n_lines (with a word), n_removed and removed, their numbers from 0 in order.

    Rows with the same doc_id and text are reported alike, whichever is first.
    Rows with a null doc_id take no part, and lose nothing.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"))
    own = line_verdicts(docs, percent).groupBy("doc_id", "version").agg(
        F.countDistinct("line_no").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias("removed"),
    )
    zero = F.lit(0).cast("long")
    return base.join(own, ["doc_id", "version"], "left").select("doc_id", "version", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce(F.size("removed").cast("long"), zero).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, with all their columns, without the lines that are not kept; documents that lose all their lines go.

    Rows that are repeated, or share doc_id and text, lose the same lines and
    stay as many as they are. Rows with a null doc_id or text stay as they are.
    ``n_chars``, if there is such a column, follows the text.
    """
    doc, version, gone, removed = (fresh(n, docs.columns) for n in ("doc", "version", "all_gone", "removed"))
    report = line_report(docs, percent).where("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("version").alias(version), (F.col("n_removed") == F.col("n_lines")).alias(gone), F.col("removed").alias(removed)).distinct()
    out = docs.join(report, (docs["doc_id"].cast("long") == report[doc]) & (F.xxhash64(docs["text"].cast("string")) == report[version]), "left").where(~F.coalesce(gone, F.lit(False)))
    left = _bound(F.split("text", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed)), lambda i: lines[i]), "\n"))
    changed = {"text": F.when(F.col(removed).isNull(), F.col("text")).otherwise(left)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changed).select(*docs.columns)
