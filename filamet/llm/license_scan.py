"""License scan: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are reduced to lower-case words.  Of every ``SPAN`` consecutive 3-word hashes the least is
kept (winnowing), so a passage and a template that share a run of ``SPAN + 2`` words share a
fingerprint.  In templates of up to ``SHORT`` words few edits break every such run; if a passage may
lack k words of them, k + 1 single words are indexed instead, of which it must hold one.  The inverted
index from fingerprint to (template, position) is as small as the templates and travels with the tasks.

Each diagonal with a hit (of a long template one of every ``BAND``) is aligned by a banded dynamic
program over words around it, which gives the matched share of the template (coverage) and the first
and last word of the match in the text.  The best passage is taken, and the others are aligned again
in the rest of the text, so that each of several copies in a row gets its row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, encode, hash_words
from filamet.llm.shared import windows as window_hashes

GRAM = 3
SPAN = 4
SHORT = 24
BAND = 8
LEAST_COVERAGE = 0.8

# Public licence notices.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; dots and hyphens hold a word together, other punctuation parts it."""
    return _WORD.findall(encode(text).lower())


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the least hash of every ``span`` consecutive ones (the rightmost of equals)."""
    n = len(grams)
    if n <= span:
        return np.arange(n)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    return np.unique(n - 1 - (np.arange(n - span + 1) + view.argmin(axis=1)))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND, within: tuple[int, int] | None = None) -> tuple[int, int, int]:
    """Longest common subsequence of words within ``band`` of a diagonal: (matched, first, end) in the text.

    ``shift`` is text position minus template position; only the words ``within`` (from, end) count.
    Of equal lengths the one nearest to the diagonal counts, then the earliest.
    """
    low, high = (0, len(text)) if within is None else within
    start = max(low, shift - band)
    words = text[start : max(start, min(high, shift + len(template) + band))].tolist()
    width = 2 * band + 1
    none = (0, 0, 0, 0)
    best = [none] * width  # (matched, -words off the diagonal, -first, -end): larger is better
    for i, w in enumerate(template.tolist()):
        row = []
        for d in range(width):
            here = max(best[d + 1] if d + 1 < width else none, row[d - 1] if d else none)
            j = i + shift + d - band
            if start <= j < start + len(words) and w == words[j - start]:
                m, off, first, _ = best[d]
                here = max(here, (m + 1, off - abs(d - band), first if m else -j, -(j + 1)))
            row.append(here)
        best = row
    m, _, first, end = max(best)
    return m, -first, -end


class Index:
    """Inverted index of winnowed template fingerprints."""

    def __init__(self, templates: Mapping[str, str], least: float = LEAST_COVERAGE):
        self.names = sorted(templates)
        self.words = [hash_words(tokens(templates[n])) for n in self.names]
        # fewest matched words of a passage
        self.need = [next((m for m in range(1, len(h) + 1) if m >= least * len(h)), len(h) + 1) for h in self.words]
        self.posting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.widths = set()
        common = Counter(w for h in self.words for w in set(h.tolist()))
        for t, h in enumerate(self.words):
            if len(h) > SHORT:
                width, at = GRAM, winnow(window_hashes(h, GRAM)).tolist()
            else:
                # words of few templates first, then long ones: they are the rarest in texts
                text = tokens(templates[self.names[t]])
                rare = sorted(range(len(h)), key=lambda p: (common[int(h[p])], -len(text[p]), p))
                width, at = 1, rare[: len(h) - self.need[t] + 1]
            self.widths.add(width)
            grams = window_hashes(h, width)
            for p in at:
                self.posting[int(grams[p])].append((t, p))
        self.keys = np.array(sorted(self.posting), dtype=np.uint64)

    def _shifts(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, shift) of the diagonals to align: all of a short template, one of every BAND of a long one."""
        hits: dict[int, set[int]] = defaultdict(set)
        for width in self.widths:
            grams = window_hashes(h, width)
            if not len(grams) or not len(self.keys):
                continue
            at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            for j in np.flatnonzero(self.keys[at] == grams).tolist():
                for t, p in self.posting[int(grams[j])]:
                    hits[t].add(j - p)
        for t, found in hits.items():
            size = len(self.words[t])
            shifts = np.array(sorted(found))
            # words of the template in the band around a diagonal: no more than these can match
            held = np.concatenate([[0], np.cumsum(np.isin(h, self.words[t]))])
            shifts = shifts[held[np.minimum(shifts + size + BAND, len(h))] - held[np.maximum(shifts - BAND, 0)] >= self.need[t]]
            while len(shifts):
                near = 1 if size <= SHORT else int(np.searchsorted(shifts, shifts[0] + BAND, "right"))
                yield t, int(shifts[near // 2])
                shifts = shifts[near:]

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end word) of every passage, best first; passages do not overlap.

        The best alignment is taken and its words are covered; what overlaps it is aligned again in
        the uncovered rest, until nothing is left.
        """
        h = hash_words(tokens(text))
        shifts = defaultdict(list)
        heap: list[tuple[int, int, int, int, int, int, bool]] = []
        covered: list[tuple[int, int]] = []  # in the order of the text

        def put(t: int, shift: int, band: int, low: int, high: int) -> None:
            m, first, end = align(self.words[t], h, shift, band, (low, high))
            if m >= self.need[t]:
                heappush(heap, (-m, end - first, first, end, t, shift, band < BAND))

        for t, shift in self._shifts(h):
            shifts[t].append(shift)
            put(t, shift, BAND, 0, len(h))
        out: list[tuple[str, float, int, int]] = []
        while heap:
            m, span, first, end, t, shift, tight = heappop(heap)
            at = bisect_left(covered, (first, first))
            if at and covered[at - 1][1] > first or at < len(covered) and covered[at][0] < end:
                # the gaps that the band reaches
                low, high = shift - BAND, shift + len(self.words[t]) + BAND
                at = max(0, bisect_left(covered, (low, low)) - 1)
                begin = covered[at - 1][1] if at else 0
                while begin < min(high, len(h)):
                    stop = covered[at][0] if at < len(covered) else len(h)
                    if stop - begin >= self.need[t] and stop > low:
                        put(t, shift, BAND, begin, stop)
                    begin, at = covered[at][1] if at < len(covered) else len(h), at + 1
                continue
            if span >= 2 * self.need[t] and not tight:
                parts = self._parts(t, h, shifts[t], first, end)
                if len(parts) > 1:
                    for k, a, b, s in parts:
                        heappush(heap, (-k, b - a, a, b, t, s, True))
                    continue
            insort(covered, (first, end))
            out.append((self.names[t], -m / len(self.words[t]), first, end))
        return out

    def _parts(self, t: int, h: np.ndarray, shifts: list[int], first: int, end: int) -> list[tuple[int, int, int, int]]:
        """Disjoint passages of a template within a wide one, each near its own diagonal: (matched, first, end, shift)."""
        band = min(BAND - 1, len(self.words[t]) // 2)
        near = [(*align(self.words[t], h, s, band, (first, end)), s) for s in shifts if first - len(self.words[t]) < s < end]
        out: list[tuple[int, int, int, int]] = []
        for k, a, b, s in sorted(near, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if k >= self.need[t] and all(b <= x[1] or x[2] <= a for x in out):
                out.append((k, a, b, s))
        return out


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None, *, id_col: str = ID, text_col: str = TEXT, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Licence passages of every text: doc_id, license, coverage, first_word, end_word, matched_words.

    One row per passage; passages of a text do not overlap, the one with more matched words goes
    first.  Word positions count the scan's own words.  Null and empty texts have no passage; null
    ids keep theirs; repeated rows repeat theirs; a template without words never matches.  Templates
    are few and given in code.  Other columns are ignored.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, least_coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            out = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in own.matches(t)]
            if out:
                ids, names, coverage, first, end = zip(*out, strict=True)
                matched = [round(c * len(own.words[own.names.index(n)])) for c, n in zip(coverage, names, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(coverage), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(matched, pa.int64())], ["doc_id", "license", "coverage", "first_word", "end_word", "matched_words"])

    schema = "doc_id long, license string, coverage double, first_word long, end_word long, matched_words long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
