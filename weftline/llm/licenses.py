"""License scans: phrases, and an exact set-similarity join with license texts.

Template texts are sets of words, ordered by how often the words occur in the
corpus, rarest first. A block (a paragraph, which ends at an empty line)
matches a template when it holds at least ``PERCENT`` of its words. Such a
block holds one of the first |T| - ceil(percent |T|) + 1 words of the order
(prefix filter), has enough distinct template words (length filter), and the
place of the first word found leaves enough words after it (positional filter);
the blocks that pass are counted exactly. The templates are constants of this
module, so they travel with the code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, alnum_table, chunks, lower_ascii

PERCENT = 80

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening or central paragraphs of public licenses. Each paragraph, and all together, is a template.
TEMPLATES = {
    "apache-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _word_hashes(text: str) -> np.ndarray:
    return next(_words(pa.array([text])))[1]


def _words(column):
    table = alnum_table()
    for _, _, data, off in chunks(column):
        w = Words(lower_ascii(data), off, table)
        yield w, w.hashes()


class Scanner:
    """The templates as sets of places in a sorted vocabulary."""

    def __init__(self, templates: dict[str, str], percent: int):
        parts = [(k, part) for k, v in sorted(templates.items()) for part in dict.fromkeys([v, *v.split("\n\n")]) if part.split()]
        own = [np.unique(_word_hashes(part)) for _, part in parts]
        self.labels, self.percent = [k for k, _ in parts], percent
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        self.sets = [np.searchsorted(self.vocabulary, s) for s in own]
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        self.phrases = [(_word_hashes(k), v) for k, v in PHRASES.items()]
        bits = np.zeros(1 << 16, bool)
        bits[(self.vocabulary & np.uint64(0xFFFF)).astype(int)] = True
        self.bits = bits

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, their places in the vocabulary) of the words that are in it."""
        at = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(self.vocabulary):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[place] == h[at]
        return at[ok], place[ok]

    def order(self, counts: np.ndarray) -> None:
        """Fix the global order: rarest first, ties by place."""
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.rank = rank
        self.sorted = [s[np.argsort(rank[s])] for s in self.sets]

    def match(self, w: Words, h: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, block) of every block that meets the threshold."""
        at, place = self.places(h)
        block = blocks[at]
        pairs = np.unique(np.stack([block, place]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        n_own = np.bincount(pairs[0], minlength=1)
        out = []
        text_of = np.zeros(int(block.max()) + 1 if len(block) else 0, np.int64)
        text_of[block] = w.doc[at]
        for t, (order, need) in enumerate(zip(self.sorted, self.need, strict=True)):
            prefix = order[: len(order) - need + 1]
            where = np.full(len(self.vocabulary), -1)
            where[prefix] = np.arange(len(prefix))
            hit = where[pairs[1]] >= 0
            if not hit.any():
                continue
            cand, begin = np.unique(pairs[0][hit], return_index=True)
            lowest = np.minimum.reduceat(where[pairs[1][hit]], begin)
            ok = (n_own[cand] >= need) & (len(order) - lowest >= need)
            inside = np.zeros(len(self.vocabulary), bool)
            inside[order] = True
            n = np.bincount(pairs[0][inside[pairs[1]]], minlength=int(cand[-1]) + 1)[cand]
            for b, m in zip(cand[ok & (n >= need)].tolist(), n[ok & (n >= need)].tolist(), strict=True):
                out.append((int(text_of[b]), t, m / len(order), b))
        return out

    def base(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, labels by number) of all phrases in these texts."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, (p, _) in enumerate(self.phrases):
            at = np.flatnonzero(h[: len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.zeros(0, np.int64)
            for j in range(1, len(p)):
                at = at[h[at + j] == p[j]]
            at = at[w.doc[at] == w.doc[at + len(p) - 1]]
            found.append((at, np.full(len(at), i)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(w: Words) -> np.ndarray:
    """The paragraph's number of each word; paragraphs end at an empty line and at the end of a text."""
    line = np.flatnonzero(w.data == 10)
    blank = line[1:][np.diff(line) == 1] if len(line) else line
    cuts = np.unique(np.concatenate([w.off, blank]))
    return np.searchsorted(cuts, w.starts, "right")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks.

    base_labels are those of the phrases, labels also those of the templates
    that a block of the text matches, sorted and joined by commas. score is the
    highest containment among matches, at least 0.5 if there is a phrase, else
    0. blocks are the matches: label, first word and end of the block, and
    containment. Null and empty texts have no words. Rows with the same doc_id
    are scanned one by one. Other columns of docs are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanner = Scanner(TEMPLATES if templates is None else templates, percent)

    def count(batches):
        total = np.zeros(len(scanner.vocabulary), np.int64)
        for batch in batches:
            for _, h in _words(batch.column("text")):
                total += np.bincount(scanner.places(h)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "n"])

    counts = np.zeros(len(scanner.vocabulary), np.int64)
    for place, n in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        counts[place] = n  # a row for each word of the templates
    scanner.order(counts)

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for w, h in _words(batch.column("text")):
                found: dict[int, tuple[list, set, set, list]] = {}
                blocks = _blocks(w)
                at, which = scanner.base(w, h)
                for a, i in zip(at.tolist(), which.tolist(), strict=True):
                    d = int(w.doc[a])
                    own = found.setdefault(d, ([], set(), set(), []))
                    own[0].append(a - int(w.bound[d]))
                    own[1].add(scanner.phrases[i][1])
                for d, t, share, b in scanner.match(w, h, blocks):
                    own = found.setdefault(d, ([], set(), set(), []))
                    own[2].add(scanner.labels[t])
                    begin, end = (int(x) - int(w.bound[d]) for x in np.searchsorted(blocks, (b, b + 1)))
                    own[3].append({"label": scanner.labels[t], "first_word": begin, "end_word": end, "containment": share})
                for d, n in enumerate(w.counts.tolist()):
                    starts, base, more, shares = found.get(d, ([], set(), set(), []))
                    row = (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max([0.0, 0.5 * bool(starts), *(x["containment"] for x in shares)]), shares)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), pa.list_(match))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, first_word: long, end_word: long, containment: double>>")
