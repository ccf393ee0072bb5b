"""Licence scans: exact set-similarity join of text blocks with templates.

A block is a run of words without a line end or sentence end inside. A template is one sentence of a licence notice. The
different words of templates and blocks are put in one global order, rarest in the corpus first. A block can only hold a
share ``THRESHOLD`` of a template's words if it holds one of the template's first ``size - need + 1`` words (prefix), has
``need`` words of templates (length), and, at each word shared in the prefix, what both have left suffices (position);
what passes is compared in full. So every block that meets the threshold is found, and all its labels are reported;
``closest`` has those whose words in the block don't lie inside another template's.

Wrapped notices: lines in a row without a sentence end or empty line between them are one more block, in which a template's
words must lie within ``SPREAD`` times its size; templates of up to ``SHORT`` words must stand without others between them.

Phrases are found besides: their words in a row anywhere in the text.

Nulls are empty texts: no words, no places, empty labels, score 0. Ties do not matter: sets of labels are sorted.
Repeated rows are scanned one by one; other columns are ignored. The broadcast word counts are as many as the
templates have words, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table
from .textvec import LETTERED, LOWER, Words, flat, hash_word

THRESHOLD = 0.8
SPREAD, SHORT = 2, 4
#: Phrase, label. Fixed values.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, sentence of a notice.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("proprietary", "All rights reserved, no part of this publication may be reproduced without prior written permission"),
    ("proprietary", "All rights reserved"),
]


def _words(text: str) -> list[str]:
    data, offsets = flat(pa.array([text]))
    data = LOWER[data]
    w = Words(data, offsets, LETTERED)
    return [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]


class Templates:
    """Templates with their words in the global order given by ``counts`` (ties by word)."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, counts: dict[str, int]):
        self.sets = [(label, sorted(set(_words(t)), key=lambda w: (counts.get(w, 0), w))) for label, t in templates]
        self.need = [max(1, ceil(threshold * len(s) - 1e-9)) for _, s in self.sets]
        self.hashes = [[hash_word(w) for w in s] for _, s in self.sets]
        every = sorted({w for _, s in self.sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {hash_word(w): r for r, w in enumerate(every)}
        self.by_prefix: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(self.hashes):
            for at, h in enumerate(s[: len(s) - self.need[i] + 1]):
                self.by_prefix.setdefault(self.rank[h], []).append((i, at))
        self.prefix = np.array(sorted(h for h, r in self.rank.items() if r in self.by_prefix), np.uint64)

    def candidates(self, block: set[int]) -> list[int]:
        """Templates that pass the prefix, length and positional filters."""
        known = sorted(self.rank[h] for h in block if h in self.rank)
        shared: dict[int, int] = {}
        for j, r in enumerate(known):
            for i, at in self.by_prefix.get(r, ()):
                if len(known) < self.need[i] or shared.get(i, 0) < 0:
                    continue
                # Words shared so far, this one, and as many as both have after it.
                most = shared.get(i, 0) + 1 + min(len(self.hashes[i]) - at - 1, len(known) - j - 1)
                shared[i] = shared.get(i, 0) + 1 if most >= self.need[i] else -1
        return sorted(i for i, n in shared.items() if n > 0)

    def matches(self, block: set[int]) -> list[int]:
        """All templates that the block holds to the threshold."""
        return [i for i in self.candidates(block) if sum(h in block for h in self.hashes[i]) >= self.need[i]]

    def places(self, i: int, words: list[int], wrapped: bool) -> tuple[float, list[int]] | None:
        """Containment and places of template ``i`` in the words of a block, or none where they are spread too far."""
        own = set(self.hashes[i])
        at = [j for j, h in enumerate(words) if h in own]
        width = len(own) if len(own) <= SHORT else SPREAD * len(own) if wrapped else len(words)
        best, lo, held = (0, 0, 0), 0, {}
        for hi, j in enumerate(at):
            held[words[j]] = held.get(words[j], 0) + 1
            while j - at[lo] >= width or held[words[at[lo]]] > 1 and width < len(words):
                held[words[at[lo]]] -= 1
                if not held[words[at[lo]]]:
                    del held[words[at[lo]]]
                lo += 1
            if len(held) > best[0] or len(held) == best[0] and width >= len(words):
                best = (len(held), lo, hi + 1)
        return (best[0] / len(own), at[best[1] : best[2]]) if best[0] >= self.need[i] else None


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool)


def template_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """How often each template word stands in all texts; one row for each word, whatever the corpus."""
    vocabulary = sorted({w for _, t in templates for w in _words(t)})
    keys = np.array([hash_word(w) for w in vocabulary], np.uint64)
    order = np.argsort(keys)
    keys = keys[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(0))
            h = Words(LOWER[data], offsets, LETTERED).hash
            h = h[member(keys, h)]
            total += np.bincount(np.searchsorted(keys, h), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["word"]]: r["n"] for r in rows}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, closest, score and ``blocks``: label, first word, number of words, containment of every block found."""
    known = Templates(templates, threshold, template_counts(docs, templates))
    phrase_keys = [([hash_word(w) for w in p.split()], label) for p, label in phrases]
    block_type = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64()), ("best", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(1))
            data = LOWER[data]
            w = Words(data, offsets, LETTERED)
            n = b.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            for keys, label in phrase_keys:
                if len(w) < len(keys):
                    continue
                at = np.flatnonzero(w.hash[: len(w) - len(keys) + 1] == np.uint64(keys[0]))
                for i, k in enumerate(keys[1:], 1):
                    at = at[w.hash[at + i] == np.uint64(k)]
                at = at[w.doc[at] == w.doc[at + len(keys) - 1]]
                for x in at.tolist():
                    places[d := int(w.doc[x])].append(x - int(w.first[d]))
                    base[d].add(label)
            found: list[list[dict]] = [[] for _ in range(n)]
            hit = np.flatnonzero(member(known.prefix, w.hash))
            if len(hit):
                after = np.append(data[1:], 10)
                ends = (data == 10) | (np.isin(data, (33, 46, 63)) & ~SPACED_AFTER[after])
                block = np.concatenate([[0], np.cumsum(ends)])[w.start] + w.doc
                lo, hi = np.searchsorted(block, block[hit], "left"), np.searchsorted(block, block[hit], "right")
                line = np.concatenate([[0], np.cumsum(data == 10)])[w.start]
                sentence = np.concatenate([[0], np.cumsum(ends & (data != 10))])[w.start]
                lines = np.concatenate([[0], np.cumsum((np.diff(w.doc) != 0) | (np.diff(sentence) != 0) | (np.diff(line) > 1))])
                first, last = np.searchsorted(lines, lines[hit], "left"), np.searchsorted(lines, lines[hit], "right")
                by_lines: dict[int, list[tuple[int, int, int, float, set[int]]]] = {}
                blocks = sorted(set(zip(lo.tolist(), hi.tolist(), strict=True)))
                wrapped = sorted(x for x in set(zip(first.tolist(), last.tolist(), strict=True)) if line[x[0]] != line[x[1] - 1])
                for a, z, over in [*((a, z, False) for a, z in blocks), *((a, z, True) for a, z in wrapped)]:
                    words = w.hash[a:z].tolist()
                    got = by_lines.setdefault(int(lines[a]), [])
                    known_here = {x[2] for x in got} if over else set()
                    for i in known.matches(set(words)):
                        if i not in known_here and (held := known.places(i, words, over)):
                            at = {a + x for x in held[1]}
                            got.append((min(at) if over else a, max(at) + 1 - min(at) if over else z - a, i, held[0], at))
                for got in by_lines.values():
                    for start, size, i, share, at in got:
                        d = int(w.doc[start])
                        best = not any(at < y[4] or at == y[4] and share < y[3] for y in got)
                        found[d].append({"label": known.sets[i][0], "first": start - int(w.first[d]), "words": size, "containment": share, "best": best})
            found = [sorted(x, key=lambda y: (y["first"], y["label"], -y["containment"])) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(w.count, pa.int64()), pa.array([len(x) for x in places], pa.int64()), pa.array([min(x, default=None) for x in places], pa.int64()), pa.array([max(x, default=None) for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base]), *[pa.array([",".join(sorted(x | {m["label"] for m in f if m["best"] or every})) for x, f in zip(base, found, strict=True)]) for every in (True, False)],
                    pa.array([1.0 if x else max((m["containment"] for m in f), default=0.0) for x, f in zip(base, found, strict=True)]), pa.array(found, pa.list_(block_type)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "closest", "score", "blocks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, closest string, score double, blocks array<struct<label: string, first: bigint, words: bigint, containment: double, best: boolean>>")


#: Bytes that are not white space.
SPACED_AFTER = np.ones(256, bool)
SPACED_AFTER[[9, 10, 11, 12, 13, 32]] = False


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")
