"""Pieces of words against every cut."""

import itertools
import random

import pytest
from weftline.operators import subwords


def cuts(word):
    for marks in itertools.product((0, 1), repeat=max(len(word) - 1, 0)):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_pieces_by_every_cut(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): -rnd.random() * 5 for _ in range(40)}
    frame = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    got = {r["word"]: r for r in subwords.unigram(frame, spark.createDataFrame(list(scores.items()), "piece string, score double")).collect()}
    assert got[None]["pieces"] is None and got[""]["pieces"] == []
    for w in words:
        value = lambda c: sum(scores.get(p, -20.0) for p in c)
        fits = [c for c in cuts(w) if all(p in scores or len(p) == 1 for p in c)]
        assert got[w]["score"] == pytest.approx(max(map(value, fits))) and value(got[w]["pieces"]) == pytest.approx(got[w]["score"])
    vocabulary = [x for p in scores for x in (p, f"##{p}")]
    pieces = {r["word"]: r["pieces"] for r in subwords.wordpiece(frame, spark.createDataFrame([(p,) for p in vocabulary], "piece string")).collect()}
    for w in words:
        out, rest = [], w
        while rest:
            head = max((rest[:n] for n in range(1, len(rest) + 1) if rest[:n] in scores), key=len, default=None)
            if head is None:
                out = ["[UNK]"]
                break
            out.append(("##" if out else "") + head)
            rest = rest[len(head) :]
        assert pieces[w] == out
    assert pieces[None] is None and pieces[""] == []


def test_a_long_word(spark):
    frame = spark.createDataFrame([("ab" * 20_000,)], "word string")
    vocabulary = spark.createDataFrame([("ab", -1.0), ("##ab", 0.0), ("a", -3.0)], "piece string, score double")
    assert len(subwords.wordpiece(frame, vocabulary).first()["pieces"]) == 20_000 and subwords.unigram(frame, vocabulary).first()["score"] == -20_000.0
