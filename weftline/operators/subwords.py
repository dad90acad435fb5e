"""Words into pieces of a given vocabulary: longest match, and the best path by scores. Nothing is trained here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most pieces of a vocabulary; it is sent to every executor.
MOST_PIECES = 1_000_000


def _trie(pieces: dict[str, float]) -> dict:
    """Nested dictionaries by letter; a piece's score stands under ''."""
    root: dict = {}
    for piece, score in pieces.items():
        node = root
        for letter in piece:
            node = node.setdefault(letter, {})
        node[""] = score
    return root


def matches(word: str, at: int, trie: dict):
    """(end, score) of every piece that stands in a word from a place on, the shortest first."""
    node = trie
    for end in range(at, len(word)):
        node = node.get(word[end])
        if node is None:
            return
        if "" in node:
            yield end + 1, node[""]


def longest_match(word: str, first: dict, later: dict, mark: str, unknown: str) -> list[str]:
    """The longest piece from each place on; pieces after the first bear the mark. One ``unknown`` for a word that can't be cut so."""
    out, at = [], 0
    while at < len(word):
        end = max((e for e, _ in matches(word, at, later if at else first)), default=0)
        if not end:
            return [unknown]
        out.append((mark if at else "") + word[at:end])
        at = end
    return out


def best_path(word: str, trie: dict, missing: float) -> tuple[list[str], float]:
    """The cut whose scores add up to most, of ties the one whose last pieces begin first; a letter that no piece holds scores ``missing``."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(word)
    for at in range(len(word)):
        so_far = best[at][0]
        for end, score in [*matches(word, at, trie), *([] if word[at] in trie and "" in trie[word[at]] else [(at + 1, missing)])]:
            if best[end] is None or so_far + score > best[end][0] + 1e-12:
                best[end] = (so_far + score, at)
    pieces, end = [], len(word)
    while end:
        pieces.append(word[best[end][1] : end])
        end = best[end][1]
    return pieces[::-1], best[len(word)][0]


def _scores(vocabulary: DataFrame, score: str | None) -> dict[str, float]:
    rows = vocabulary.select("piece", *([score] if score else [])).where("piece != ''").limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    return {r[0]: float(r[1]) if score else 0.0 for r in rows}


def _cut(words: DataFrame, tries, cut) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches):
        for batch in batches:
            own = [cut(w, shared.value) if w is not None else (None, None) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([p for p, _ in own], pa.list_(pa.string())), pa.array([s for _, s in own], pa.float64())], ["word", "pieces", "score"])

    return words.select("word").mapInArrow(run, "word string, pieces array<string>, score double")


def wordpiece(words: DataFrame, vocabulary: DataFrame, mark: str = "##", unknown: str = "[UNK]") -> DataFrame:
    """word, pieces of a table of words, cut by longest match with a vocabulary (piece); pieces inside a word begin with the mark. A null word has null."""
    pieces = _scores(vocabulary, None)
    first = _trie({p: 0.0 for p in pieces if not p.startswith(mark)})
    later = _trie({p[len(mark) :]: 0.0 for p in pieces if p.startswith(mark) and len(p) > len(mark)})
    return _cut(words, (first, later), lambda w, t: (longest_match(w, t[0], t[1], mark, unknown), None)).select("word", "pieces")


def unigram(words: DataFrame, vocabulary: DataFrame, missing: float = -20.0) -> DataFrame:
    """word, pieces, score of a table of words: the cut into pieces of a vocabulary (piece, score) with the largest sum of scores. A null word has null."""
    return _cut(words, _trie(_scores(vocabulary, "score")), lambda w, t: best_path(w, t, missing))
