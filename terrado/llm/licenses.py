"""License scans: a generalised suffix automaton of licence templates.

Each text is streamed through the automaton, which gives at every word the
longest run of words that stands in some template (matching statistics). Runs of
MIN_RUN words or more are chained, in the order of a template, into covered
spans; a span that covers enough of its template gives the template's label.
Short base phrases are templates too, and every place of one is reported.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import WORD_BYTES, slices, texts_of, utf8

# Base phrases with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Well-known notices of licences, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved. No part of this work may be reproduced without permission"),
)

#: Words that a run needs to be chained.
MIN_RUN = 3
#: Words of a text that may part two runs of one span.
MAX_GAP = 12
#: Share of a template that a span must cover for its label.
MIN_COVER = 0.8


def word_list(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences."""

    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    #: Template and end of each place of a state's words.
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the shorter words of q that follow p's."""
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.step[last].get(word)
        if q is not None:  # an earlier template has these words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    @classmethod
    def of(cls, sequences: list[list[bytes]]) -> Automaton:
        self = cls()
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for k, sequence in enumerate(sequences):
            at = 0
            for end, word in enumerate(sequence, 1):
                at = self.step[at][word]
                state = at
                while state > 0:
                    self.ends[state].append((k, end))
                    state = self.link[state]
        return self

    def locus(self, sequence: list[bytes]) -> int:
        at = 0
        for word in sequence:
            at = self.step[at][word]
        return at


class Scanner:
    """Base phrases and templates in one automaton."""

    def __init__(self, phrases: tuple, templates: tuple, min_run: int, max_gap: int, min_cover: float):
        self.phrases = [(word_list(p.encode()), label) for p, label in phrases]
        self.templates = [(word_list(t.encode()), label) for label, t in templates]
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.auto = a = Automaton.of([w for w, _ in self.templates] + [w for w, _ in self.phrases])
        self.vocabulary = set(a.step[0])
        loci = [(a.locus(w), len(w), label) for w, label in self.phrases]
        #: Phrases that end where a state's words do: words needed, label.
        self.ending: list[tuple] = []
        for state in range(len(a.link)):
            up, at = set(), state
            while at >= 0:
                up.add(at)
                at = a.link[at]
            self.ending.append(tuple((n, label) for locus, n, label in loci if locus in up))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words; base places (start, label); covered spans (label, start, end, share of the template)."""
        words = word_list(text)
        vocabulary, auto = self.vocabulary, self.auto
        step, link, length = auto.step, auto.link, auto.length
        base: list[tuple[int, str]] = []
        runs: list[tuple[int, int, int]] = []  # end, words, state
        state = run = 0
        before = -2
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != before + 1:
                if run >= self.min_run:
                    runs.append((before + 1, run, state))
                state = run = 0
            word = words[i]
            if word not in step[state]:
                if run >= self.min_run:
                    runs.append((i, run, state))
                while state and word not in step[state]:
                    state = link[state]
                run = length[state]
            state = step[state][word]
            run += 1
            before = i
            for need, label in self.ending[state]:
                if run >= need:
                    base.append((i + 1 - need, label))
        if run >= self.min_run:
            runs.append((before + 1, run, state))
        return len(words), base, self._chained(runs)

    def _chained(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of the text that cover most of a template: the best chains of its runs, in the order of both, over gaps of max_gap words at most.

        A run may stand at several places of a template; each is an item, and an item
        looks back over the items that end within its reach, whose number is bounded
        by the template and the gap. Of one template's chains that overlap the fullest counts.
        """
        places: dict[int, list[tuple[int, int, int]]] = {}  # by template: end, end in the template, words
        for end, run, state in runs:
            for k, at in self.auto.ends[state]:
                if k < len(self.templates):
                    places.setdefault(k, []).append((end, at, run))
        spans: list[tuple[str, int, int, float]] = []
        for k, items in places.items():
            words, label = self.templates[k]
            items.sort()
            chains: list[tuple[int, int, int]] = []  # words covered, start, end
            for i, (end, at, run) in enumerate(items):
                covered, start = run, end - run
                for j in range(i - 1, -1, -1):
                    end_j, at_j, _ = items[j]
                    if end - run - end_j > self.max_gap:
                        break
                    if end_j < end and at_j < at and (more := chains[j][0] + min(run, end - end_j, at - at_j)) > covered:
                        covered, start = more, chains[j][1]
                chains.append((covered, start, end))
            starts: list[int] = []  # of the spans taken, which never overlap, in order; with their ends
            ends: list[int] = []
            for covered, start, end in sorted(chains, key=lambda c: (-c[0], c[1])):
                if covered < self.min_cover * len(words):
                    break
                at = bisect_right(starts, start)
                if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                    starts.insert(at, start)
                    ends.insert(at, end)
                    spans.append((label, start, end, min(1.0, covered / len(words))))
        return sorted(spans, key=lambda s: s[1:3])


SCAN = "doc_id long, n_words long, base array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,`end`:long,share:double>>"


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple = BASE_PHRASES,
    templates: tuple = TEMPLATES,
    min_run: int = MIN_RUN,
    max_gap: int = MAX_GAP,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (every place of a phrase), spans (covered template spans, in words).

    Null texts count as empty and have neither. The whole text is scanned, in one pass over its words.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, min_run, max_gap, min_cover)
        for batch in slices(batches):
            found = [scanner.scan(text) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": s, "label": b} for s, b in base] for _, base, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                    pa.array(
                        [[{"label": b, "start": s, "end": e, "share": x} for b, s, e, x in spans] for _, _, spans in found],
                        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])),
                    ),
                ],
                names=["doc_id", "n_words", "base", "spans"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(over, SCAN)


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template, 1 with a base place)."""
    scan = scan_licenses(docs, **options)
    base, spans = F.col("base"), F.col("spans")
    return scan.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base["label"], spans["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(spans["share"]), F.lit(0.0))).alias("score"),
    )
