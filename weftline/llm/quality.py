"""Quality rules: text statistics and robust multivariate outliers.

Each text gets a vector of transformed statistics. A minimum-covariance-
determinant (MCD) estimate of location and scatter is made for every pair of
language and source, and a text is rejected when the squared Mahalanobis
distance of its vector exceeds ``CUT``.

The estimate uses every row. Vectors are first summed into cells of a grid:
count, sum and sum of products, in integers, so that the sums do not depend on
the order of the rows. No cell is open: cells resolve each statistic over its
whole range, as far as rows reach, and the ranges are bounded (logarithms of
counts and shares), so the occupied cells of a group grow far slower than its
rows. The concentration steps
of the fast MCD algorithm then work on cells. Groups with fewer than
``MIN_ROWS`` rows use the estimate of their language, or else that of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep
from .words import Words, chunks, cover, mix, space_table, span_hashes

#: Statistics of the vector, in this order.
STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
#: Vectors are kept as integers, in steps of 1/SCALE.
SCALE = 1024
#: Width of a cell along each statistic.
CELL_WIDTH = (512, 256, 256, 256, 256)
#: The least variance along each statistic, so that a statistic that hardly ever varies doesn't reject on its own.
LEAST_SD = (0.35, 0.35, 0.35, 0.35, 0.35)
MIN_ROWS = 200
#: Share of rows the scatter of which is least.
HALF = 0.75
#: Squared distance beyond which a text goes: far in the tail of chi-square with 5 degrees of freedom (p about 1e-9).
CUT = 50.0
#: Groups up to which the estimates are broadcast; beyond, the join is salted. An estimate has under 400 bytes.
BROADCAST_GROUPS = 20_000
SALTS = 32

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(w: Words, h: np.ndarray, k: int) -> np.ndarray:
    """Words, by text, in k-word windows that stand twice or more in the text."""
    wins = w.windows(k)
    key = mix(span_hashes(h, wins, wins + k, 41) ^ (w.doc[wins].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    ranked = key[order]
    twice = np.zeros(len(key), bool)
    same = ranked[1:] == ranked[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    upto = np.append(0, np.cumsum(cover(len(w), wins[twice], k)))
    return upto[w.bound[1:]] - upto[w.bound[:-1]]


def _dup_lines(data: np.ndarray, off: np.ndarray, w: Words) -> np.ndarray:
    """Lines with a word, by text, that equal an earlier line of it."""
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], ends + 1]))
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))
    doc = np.searchsorted(off, starts, "right") - 1
    stops = stops - ((data[stops - 1] == 10) & (stops > starts)) if len(starts) else stops
    worded = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, starts)
    starts, stops, doc = starts[worded], stops[worded], doc[worded]
    letters = mix(np.arange(1, 257, dtype=np.uint64))
    key = mix(span_hashes(letters[data], starts, stops, 42) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=len(off) - 1)


def _statistics(batches):
    table = space_table()
    for batch in batches:
        cols = [[np.zeros(0, np.int64)] for _ in range(5)]
        for _, _, data, off in chunks(batch.column("text")):
            w = Words(data, off, table)
            points = np.append(0, np.cumsum(((data & 0xC0) != 0x80) & w.inside))
            symbols = np.append(0, np.cumsum(_SYMBOLS[data]))
            for c, v in zip(cols, (w.counts, np.diff(points[off]), np.diff(symbols[off]), _dup_lines(data, off, w), _repeats(w, w.hashes(), 8)), strict=True):
                c.append(v)
        own = [batch.column(c) for c in ("doc_id", "lang", "source", "text_hash")]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], ["doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, text_hash, the counts, base_failed and the vector v0 to v4 (integers).

    Null and empty texts have no words; a null lang or source is a group of
    its own. Repeated rows and ids are rows of their own. Other columns are
    dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    out = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_statistics, f"doc_id long, lang string, source string, text_hash long, {_COUNTS}")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratio = lambda top, bottom, least: F.log(F.col(top) / bottom + F.lit(least)) - F.log(F.lit(least))
    vector = (
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) * 4,
        ratio("n_symbols", F.greatest(F.col("word_chars"), F.lit(1)).cast("double"), 0.02),
        ratio("n_dup_lines", n, 0.02),
        ratio("n_repeat_words", n, 0.1),
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.select("*", failed.alias("base_failed"), *(F.round(v * SCALE).cast("long").alias(f"v{i}") for i, v in enumerate(vector)))


def _mcd(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Location and scatter of the HALF of the rows with the least determinant, from cells (n, s0.., p00..)."""
    d = len(STATISTICS)
    n = cells["n"].to_numpy(float)
    s = np.stack([cells[f"s{i}"].to_numpy(float) for i in range(d)], axis=1) / SCALE
    p = np.zeros((len(n), d, d))
    for i in range(d):
        for j in range(i, d):
            p[:, i, j] = p[:, j, i] = cells[f"p{i}{j}"].to_numpy(float) / SCALE**2
    mean = s / n[:, None]
    floor = np.diag(np.square(LEAST_SD))
    most = HALF * n.sum()

    def estimate(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = (weight * n).sum()
        at = (weight[:, None] * s).sum(0) / total
        return at, (weight[:, None, None] * p).sum(0) / total - np.outer(at, at) + floor

    def nearest(at: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        away = mean - at
        order = np.argsort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter), away), kind="stable")
        before = np.cumsum(n[order]) - n[order]
        weight = np.zeros(len(n))
        weight[order] = np.clip((most - before) / n[order], 0, 1)
        return weight

    def median(x: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        return x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]

    middle = np.array([median(mean[:, i]) for i in range(d)])
    spread = np.array([median(np.abs(mean[:, i] - middle[i])) for i in range(d)]) * 1.4826
    largest = np.argmax(n)
    starts = [(middle, np.diag(spread**2) + floor), estimate(np.ones(len(n))), (mean[largest], floor)]
    best = None
    for at, scatter in starts:
        for _ in range(30):
            new = estimate(nearest(at, scatter))
            done = np.allclose(new[0], at) and np.allclose(new[1], scatter)
            at, scatter = new
            if done:
                break
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[0] - 1e-9:
            best = (det, at, scatter)
    # one reweighting step: rows not beyond the 97.5 % quantile of chi-square(5), after the usual consistency factor
    _, at, scatter = best
    away = mean - at
    far = np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter * 1.5), away)
    weight = (far <= 12.83).astype(float)
    if (weight * n).sum() >= most:
        at, scatter = estimate(weight)
    return at, scatter, n.sum()


_FIT = "level int, lang string, source string, rows long, at array<double>, inverse array<double>"


def _fit(cells: pd.DataFrame) -> pd.DataFrame:
    at, scatter, n = _mcd(cells)
    one = cells.iloc[0]
    return pd.DataFrame({"level": [int(one["level"])], "lang": [one["lang"]], "source": [one["source"]], "rows": [int(n)], "at": [at.tolist()], "inverse": [np.linalg.inv(scatter).ravel().tolist()]})


def fit(stats: DataFrame) -> DataFrame:
    """MCD estimates from the rows of stats that pass the base rules: by language and source, by language, and of all.

    Keys: level 2, 1 or 0, lang and source; a null lang or source is coded as
    the character U+0000, and keys above a level are empty.
    """
    d = len(STATISTICS)
    good = stats.where(~F.col("base_failed"))
    cell = [F.floor(F.col(f"v{i}") / CELL_WIDTH[i]).cast("int").alias(f"c{i}") for i in range(d)]
    v = [F.col(f"v{i}") for i in range(d)]
    sums = [F.count("*").alias("n"), *(F.sum(v[i]).alias(f"s{i}") for i in range(d)), *(F.sum(v[i] * v[j]).alias(f"p{i}{j}") for i in range(d) for j in range(i, d))]
    cells = good.groupBy(F.coalesce("lang", F.lit("\0")).alias("lang"), F.coalesce("source", F.lit("\0")).alias("source"), *cell).agg(*sums)
    names = ["n", *(f"s{i}" for i in range(d)), *(f"p{i}{j}" for i in range(d) for j in range(i, d))]
    cells = keep(cells)
    blank = F.lit("").alias("source")
    by = [
        cells.withColumn("level", F.lit(2)),
        cells.groupBy("lang", blank, *(f"c{i}" for i in range(d))).agg(*(F.sum(x).alias(x) for x in names)).withColumn("level", F.lit(1)),
        cells.groupBy(F.lit("").alias("lang"), blank, *(f"c{i}" for i in range(d))).agg(*(F.sum(x).alias(x) for x in names)).withColumn("level", F.lit(0)),
    ]
    every = by[0].unionByName(by[1]).unionByName(by[2])
    fits = every.groupBy("level", "lang", "source").applyInPandas(_fit, _FIT)
    return keep(fits.where((F.col("rows") >= MIN_ROWS) | (F.col("level") == 0)))


def judge(docs: DataFrame) -> DataFrame:
    """text_statistics(docs) with ``distance`` (squared Mahalanobis, null if no estimate) and ``kept``.

    kept is false where base_failed, or where the distance exceeds CUT. With no
    row that passes the base rules there is no estimate, and nothing more goes.
    Every row is judged by itself, repeated rows alike.
    """
    stats = keep(text_statistics(docs))
    fits = fit(stats)
    d = len(STATISTICS)
    keyed = stats.withColumns({"_lang": F.coalesce("lang", F.lit("\0")), "_source": F.coalesce("source", F.lit("\0"))})
    groups = fits.count()
    salted = groups > BROADCAST_GROUPS
    for level, keys in ((2, ["_lang", "_source"]), (1, ["_lang"]), (0, [])):
        own = fits.where(F.col("level") == level).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct("at", "inverse").alias(f"fit{level}"))
        own = own.select(*keys, f"fit{level}")
        if not keys:
            keyed = keyed.join(F.broadcast(own), F.lit(True), "left")  # one row at most
        elif salted:
            own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")).join(own, [*keys, "_salt"], "left").drop("_salt")
        else:
            keyed = keyed.join(F.broadcast(own), keys, "left")
    keyed = keyed.withColumn("_fit", F.coalesce("fit2", "fit1", "fit0"))
    away = [F.col(f"v{i}") / F.lit(float(SCALE)) - F.col("_fit.at")[i] for i in range(d)]
    distance = sum((away[i] * away[j] * F.col("_fit.inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    keyed = keyed.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return keyed.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass; each by its own doc_id, lang, source and text, nulls included."""
    keys = ("doc_id", "lang", "source", "text_hash")
    good = judge(docs).where("kept").select(*(F.col(k).alias(f"_good_{k}") for k in keys)).distinct()
    mine = (docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["source"].cast("string"), F.xxhash64(docs["text"].cast("string")))
    same = [a.eqNullSafe(good[f"_good_{k}"]) for a, k in zip(mine, keys, strict=True)]
    return docs.join(good, same, "left_semi")
