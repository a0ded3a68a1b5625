"""License scan: exact set-similarity join of license templates with text blocks.

A block is a run of words, starting every half block, so that every run of up
to half a block lies whole in some block; blocks have ``BLOCK`` words, or twice
the longest template's.  A template matches a block that holds at least the
threshold share of its distinct words; templates of fewer than ``SHORT`` distinct
words must be there with all of them, for their other words are common ones.  Candidates come from the prefix, length and
positional filters over globally frequency-ordered words (rarest first); each
is then verified on the full sets.  No pair above the threshold is missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import as_bytes, small_batches

BLOCK = 256  # words, at least
SHORT = 8
MAX_TEMPLATE_BYTES = 1 << 20  # the templates go with the tasks; more are joined in blocks of this size

# Words: A-Z lower-cased; every ASCII character but digits and letters separates words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Template:
    """``phrase``: its words must stand consecutively, and each place counts."""

    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False


# The phrases of the contract and openings of public license texts.
PHRASES = (
    Template("mit", "under the mit license", 1.0, True),
    Template("apache-2", "apache license version 2", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
)
LICENSES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    Template("mit", "Released under the MIT License"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", 0.9),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", 0.9),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", 0.95),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TemplateIndex:
    """Templates as sets of word ranks (rarest word first) with their prefix index."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[bytes, int]):
        seqs = [words_of(t.text.encode()) for t in templates]
        vocab = sorted({w for s in seqs for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(vocab)}
        self.templates = templates
        self.seqs = [np.array([self.rank[w] for w in s], np.int64) for s in seqs]
        self.sets = [np.unique(s) for s in self.seqs]
        self.block = max(BLOCK, 2 * max(map(len, seqs), default=0))
        self.stride = self.block // 2
        share = [1.0 if len(s) < SHORT else t.threshold for t, s in zip(templates, self.sets)]
        self.need = [max(1, math.ceil(x * len(s) - 1e-9)) for x, s in zip(share, self.sets)]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            for pos in range(len(s) - self.need[k] + 1 if len(s) else 0):
                self.prefix.setdefault(int(s[pos]), []).append((k, pos))
        self.is_prefix = np.zeros(len(vocab) + 1, bool)  # the last entry stands for words of no template
        self.is_prefix[list(self.prefix)] = True

    def candidates(self, block: np.ndarray) -> list[int]:
        """Templates that pass the filters; ``block``: its template words, sorted and distinct."""
        seen, out = set(), []
        for i, r in enumerate(block):
            for k, pos in self.prefix.get(int(r), ()):
                if k in seen or i > len(block) - self.need[k]:  # length filter, prefix of the block's side
                    continue
                # first common word of the two, so nothing before it can match
                seen.add(k)
                if 1 + min(len(block) - i, len(self.sets[k]) - pos) - 1 >= self.need[k]:
                    out.append(k)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of the phrases' places, their labels, all labels, and the best containment."""
        none, n = len(self.rank), len(words)
        get = self.rank.get
        ranks = np.fromiter((get(w, none) for w in words), np.int64, n)
        at = np.flatnonzero(self.is_prefix[ranks])
        if not len(at):
            return [], set(), set(), 0.0
        block, stride = self.block, self.stride
        last = max(0, -(-(n - block) // stride))  # number of the last block
        blocks = np.unique(np.concatenate([np.clip(at // stride - j, 0, last) for j in range(block // stride)]))
        places, base, labels, best = [], set(), set(), 0.0
        for b in blocks:
            begin = int(b) * stride
            part = ranks[begin : begin + block]
            present = np.unique(part[part < none])
            for k in self.candidates(present):
                t = self.templates[k]
                common = len(np.intersect1d(present, self.sets[k], assume_unique=True))
                if common < self.need[k]:
                    continue
                if t.phrase:
                    seq = self.seqs[k]
                    own = len(part) if b == last else stride  # each start belongs to one block
                    starts = min(own, len(part) - len(seq) + 1)
                    if starts <= 0:
                        continue
                    hit = np.ones(starts, bool)
                    for j, r in enumerate(seq):
                        hit &= part[j : j + starts] == r
                    found = np.flatnonzero(hit) + begin
                    if not len(found):
                        continue
                    places += found.tolist()
                    base.add(t.label)
                labels.add(t.label)
                best = max(best, common / len(self.sets[k]))
        return places, base, labels, best


def word_counts(docs: DataFrame, vocab: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each template word occurs in the whole corpus (as many rows as template words)."""
    small_batches(docs.sparkSession)
    order = sorted(vocab)
    rank = {w: r for r, w in enumerate(order)}

    def count(batches):
        total = np.zeros(len(order) + 1, np.int64)
        get, none = rank.get, len(order)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                words = words_of(text)
                total += np.bincount(np.fromiter((get(w, none) for w in words), np.int64, len(words)), minlength=none + 1)
        at = np.flatnonzero(total[:-1])
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word long, n long")
    return {order[r.word]: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def license_scan(
    docs: DataFrame, licenses: tuple[Template, ...] = LICENSES, phrases: tuple[Template, ...] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base (places of phrases), first_word, last_word
    (smallest and largest start of a place, else null), base_labels, labels, score.

    ``score`` is the largest containment of a matched template (0 without one).
    Null or empty text has no words and no labels (empty strings); a null id
    stays null; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.  A template of no words
    matches nothing.  Two scans (word counts, join), no shuffle of texts.
    """
    small_batches(docs.sparkSession)
    templates = tuple(phrases) + tuple(licenses)
    if sum(len(t.text.encode()) for t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("templates exceed MAX_TEMPLATE_BYTES; scan with several calls over parts of them")
    vocab = {w for t in templates for w in words_of(t.text.encode())}
    index = TemplateIndex(templates, word_counts(docs, vocab, text_col))

    def run(batches):
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                places, base, labels, best = index.scan(words)
                out.append((
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), best,
                ))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)
