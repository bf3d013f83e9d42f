"""Periodic runs of words, by branching squares on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Every run of
at least two periods ends in exactly one branching square of its period: two equal halves of q words,
followed by different words.  Such a square at i means that the suffixes i and i + q agree on exactly q
words, so they part at an LCP boundary of depth q: they stand on its two sides in the suffix array.

Boundaries are taken one by one.  Boundary k of depth d spans the suffixes up to the next smaller
LCP on either side; the suffixes of the smaller side look up ISA[i + d] and ISA[i - d] and check
whether they stand on the other side.  A suffix is on a smaller side O(log n) times, so all squares
are found in O(n log n) look-ups, with arrays only: no tree is built.  Squares are rotated to the
left as long as the words agree; those with one end merge into the run of the smallest period.

A run that counts has at least 24 words and three periods, so its first 16 words return one period
later.  Texts without a repeated sequence of 16 words hold no run and leave before the array is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, hash_words, mix, rows, split_words, windows

LEAST = 24  # words of a run
PERIODS = 3  # periods of a run
STEPS = 16  # rotations of all squares together before those left are rotated one by one
LOOKUPS = 1 << 20  # suffixes looked up at once
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and LCP (with the suffix before) of several documents.

    A document's suffixes end with it and stand together; documents follow each other.  Prefix
    doubling; the ranks of each round serve the LCP, longest first.
    """
    n = len(words)
    end = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)[np.cumsum(np.append(0, doc[1:] != doc[:-1]))]
    order = np.lexsort((words, doc))
    fresh = np.append(True, (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.cumsum(fresh)  # 0 is the end of a document
    levels, step = [rank], 1
    while not fresh.all():
        after = _after(rank, end, step)
        key = rank.astype(np.int64) << 32 | after
        order = np.argsort(key)
        fresh = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(fresh)
        levels.append(rank)
        step *= 2
    inverse = rank - 1
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        # ranks of level k agree where 2**k words agree; a rank past the end agrees with nothing
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = (levels[k][a[inside]] == levels[k][b[inside]]) & (np.maximum(a, b)[inside] + (1 << k) <= end[order[:-1][inside]])
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, inverse, lcp


def _after(rank: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """Rank of the suffix ``step`` words later, 0 past the end of the document."""
    at = np.arange(len(rank)) + step
    return np.where(at < end, rank[np.minimum(at, len(rank) - 1)], 0)


def boundaries(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary k: the nearest one before with a smaller or equal LCP, the nearest after with a smaller one."""
    values = lcp.tolist()
    n = len(values)
    before, after, stack = [0] * n, [n] * n, []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = k
        before[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)


def branching_squares(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every branching square."""
    sa, isa, lcp = suffix_array(words, doc)
    before, after = boundaries(lcp)
    k = np.flatnonzero(lcp > 0)
    depth, lo, hi = lcp[k], before[k], after[k]
    left = k - lo <= hi - k  # the smaller side
    small_lo, small_hi = np.where(left, lo, k), np.where(left, k, hi)
    other_lo, other_hi = np.where(left, k, lo), np.where(left, hi, k)
    size = small_hi - small_lo
    total = np.cumsum(size)
    starts, halves = [], []
    at = 0
    while at < len(k):
        # boundaries of about LOOKUPS suffixes together
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOOKUPS)))
        part, n = slice(at, to), size[at:to]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        suffix = sa[np.repeat(small_lo[part], n) + inner]
        d, a, b = np.repeat(depth[part], n), np.repeat(other_lo[part], n), np.repeat(other_hi[part], n)
        for sign in (1, -1):
            partner = suffix + sign * d
            ok = (partner >= 0) & (partner < len(words))
            place = isa[np.where(ok, partner, 0)]
            hit = ok & (place >= a) & (place < b)
            starts.append(np.minimum(suffix, partner)[hit])
            halves.append(d[hit])
        at = to
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(halves)


def _rotate(words: np.ndarray, first: int, at: int, half: int) -> int:
    """Leftmost rotation of the square at ``at`` within a document that starts at ``first``."""
    step = 64
    while at > first:
        n = min(step, at - first)
        same = words[at - n : at] == words[at - n + half : at + half]
        if not same.all():
            return at - int(np.argmin(same[::-1]))
        at, step = at - n, step * 2
    return at


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of at least ``least`` words and ``periods`` (two or more) periods; positions in the whole array."""
    if len(words) < 2:
        return []
    at, half = branching_squares(words, doc)
    head = np.append(0, np.flatnonzero(doc[1:] != doc[:-1]) + 1)
    first = head[np.searchsorted(head, at, side="right") - 1]
    end = at + 2 * half
    # what is too short after a few rotations of all squares goes
    now = at.copy()
    alive = np.arange(len(at))
    for _ in range(STEPS):
        move = alive[(now[alive] > first[alive])]
        move = move[words[now[move] - 1] == words[now[move] - 1 + half[move]]]
        now[move] -= 1
        stopped = np.setdiff1d(alive, move, assume_unique=True)
        alive = np.concatenate((move, stopped[end[stopped] - now[stopped] >= np.maximum(least, periods * half[stopped])]))
    by = alive[np.lexsort((half[alive], end[alive]))]
    out: list[tuple[int, int, int]] = []
    last, found = -1, []
    for e, q, s, f in zip(end[by].tolist(), half[by].tolist(), now[by].tolist(), first[by].tolist(), strict=True):
        if e != last:
            last, found = e, []
        if any(q % p == 0 and e - 2 * q >= b for b, p in found):
            continue  # a multiple of a period found already
        b = _rotate(words, f, s, q)
        found.append((b, q))
        if e - b >= max(least, periods * q):
            out.append((b, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repeating(h: np.ndarray, doc: np.ndarray, width: int, number: int) -> np.ndarray:
    """Which documents hold a sequence of ``width`` words twice."""
    out = np.zeros(number, dtype=bool)
    w = windows(h, width)
    if not len(w):
        return out
    inside = doc[: len(w)] == doc[width - 1 :]
    key, own = mix(w[inside] + doc[: len(w)][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc[: len(w)][inside]
    order = np.argsort(key)
    twice = key[order][1:] == key[order][:-1]
    out[own[order][1:][twice]] = True
    return out


def _find(least: int, periods: int):
    # the first (periods - 1) / periods of a run return, of the shortest run so many words at least
    width = max(1, least - least // periods)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, "id", "text"):
            lists = [split_words(t) for t in texts]
            lens = np.array([len(ws) for ws in lists], dtype=np.int64)
            flat = [w for ws in lists for w in ws]
            doc = np.repeat(np.arange(len(lists)), lens)
            keep = _repeating(hash_words(flat), doc, width, len(lists))
            mine = keep[doc]
            codes = pa.array([w for ws, k in zip(lists, keep, strict=True) if k for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            own, start_of = doc[mine], np.cumsum(lens) - lens
            place = np.flatnonzero(mine)
            found: list[list[tuple[int, int, int]]] = [[] for _ in lists]
            for b, e, q in runs_of(codes, own, least, periods):
                i = int(own[b])
                found[i].append((int(place[b] - start_of[i]), e - b, q))
            collapsed = []
            for ws, runs in zip(lists, found, strict=True):
                if runs:
                    step = np.zeros(len(ws) + 1, dtype=np.int64)
                    for s, n, q in runs:
                        step[s + q] += 1
                        step[s + n] -= 1
                    ws = [w for w, c in zip(ws, np.cumsum(step[:-1]).tolist(), strict=True) if not c]
                collapsed.append(b" ".join(ws))
            cells = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lens), pa.array(cells, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = ID, text_col: str = TEXT, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Runs of every whole text: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of non-white-space (ASCII white space), numbered from 0.  ``collapsed`` holds the
    words that no run covers after its first period, joined by one space.  Runs have at least
    ``least`` words and ``periods`` (three or more) periods.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Null ids keep their row;
    repeated rows give a row each; an empty table gives none.  Other columns are ignored.  Texts are
    worked on in parts of about 2 MB; a longer text is worked on alone and takes some 200 bytes per
    word if it repeats itself.
    """
    if periods < 3 or least < periods:
        raise ValueError("a run needs three periods, and a word for each")
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_find(least, periods), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
