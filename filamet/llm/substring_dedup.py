"""Removal of long repeated passages by recompression.

A document's word sequence is compressed in rounds.  A round names runs of equal symbols and then
pairs of adjacent symbols (left symbol from one half of the alphabet, right symbol from the other;
the half is a hash bit of the symbol, so every document splits it alike).  A name is the hash of
what it stands for, so equal contents get equal names in every document without a lookup.

Each symbol carries its context: the words that settle that it is a symbol of its round.  Two equal
passages agree on every symbol whose context lies inside them.  A window can only repeat elsewhere
if every such symbol of it is shared with another text; this clears nearly all windows of the
corpus with a few percent of its volume.  What is left, including windows without such a symbol
(long runs), is compared exactly, by 96-bit window hashes, and the document with the least id keeps
the passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, hash_words, id_filter, mix, passing, rows, signed, split_words, stored
from filamet.llm.shared import windows as window_hashes

ROUNDS = 7
RUN_ROUNDS = (0, 4)
FAR = 1 << 40
_PAIR, _SECOND, _RUN, _SIDE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds: name, document, first and end word of the context.

    ``h`` holds word hashes of several documents one after another, ``doc`` the number of each
    word's document.  A context that reaches over an end of its document is put out of reach.
    """
    sym, own = h, doc
    lo = np.arange(len(h), dtype=np.int64)
    hi = lo + 1
    for r in range(rounds):
        if len(sym) == 0:
            break
        if r in RUN_ROUNDS:
            same = np.zeros(len(sym), dtype=bool)
            same[1:] = (sym[1:] == sym[:-1]) & (own[1:] == own[:-1])
            head = np.flatnonzero(~same)
            last = np.append(head[1:], len(sym)) - 1
            count = (last - head + 1).astype(np.uint64)
            # a run is settled by its neighbours: they must differ
            before, after = np.maximum(head - 1, 0), np.minimum(last + 1, len(sym) - 1)
            left = np.where((head > 0) & (own[before] == own[head]), lo[before], -FAR)
            right = np.where((last < len(sym) - 1) & (own[after] == own[head]), hi[after], FAR)
            lo, hi = np.minimum(left, np.minimum.reduceat(lo, head)), np.maximum(right, np.maximum.reduceat(hi, head))
            sym = np.where(count > 1, mix(sym[head] * _RUN + count), sym[head])
            own = own[head]
        right_half = (mix(sym + _SIDE * np.full(1, r + 1, dtype=np.uint64)) >> np.uint64(63)).astype(bool)
        joined = own[1:] == own[:-1]
        first = np.zeros(len(sym), dtype=bool)
        first[:-1] = ~right_half[:-1] & right_half[1:] & joined
        # a symbol of the left half is settled by its right neighbour, and the other way round
        new_lo, new_hi = lo.copy(), hi.copy()
        left, right = np.full(len(sym), -FAR), np.full(len(sym), FAR)
        left[1:] = np.where(joined, lo[:-1], -FAR)
        right[:-1] = np.where(joined, hi[1:], FAR)
        new_lo[right_half] = np.minimum(lo, left)[right_half]
        new_hi[~right_half] = np.maximum(hi, right)[~right_half]
        at = np.flatnonzero(first)
        new_lo[at], new_hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        sym = sym.copy()
        sym[at] = mix(sym[at] * _PAIR + sym[at + 1] * _SECOND + np.uint64(r))
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        sym, own, lo, hi = sym[keep], own[keep], new_lo[keep], new_hi[keep]
    return sym, own, lo, hi


def _covered(lo: np.ndarray, hi: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each word: does the window that starts there contain one of the intervals?"""
    best = np.full(n + 1, FAR, dtype=np.int64)
    ok = (lo >= 0) & (hi <= n)
    np.minimum.at(best, lo[ok], hi[ok])
    best = np.minimum.accumulate(best[::-1])[::-1][:n]
    return best <= np.arange(n) + width


def _batch(texts: list) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    lists = [split_words(t) for t in texts]
    h = hash_words([w for ws in lists for w in ws])
    lens = np.array([len(ws) for ws in lists], dtype=np.int64)
    return lists, h, np.repeat(np.arange(len(lists)), lens), lens


def _starts(lens: np.ndarray, width: int) -> np.ndarray:
    """Which words start a window."""
    out = np.zeros(int(lens.sum()), dtype=bool)
    end = 0
    for n in lens:
        out[end : end + max(0, int(n) - width + 1)] = True
        end += int(n)
    return out


def _split128(value: int) -> tuple[int, int]:
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _describe(width: int):
    """Per document: word count, 128-bit name of the word sequence, digest, whether some window has no
    settled symbol, and the names of the settled symbols if it is long enough for a window."""

    def run(batches):
        for ids, texts in rows(batches, "id", "text"):
            lists, h, doc, lens = _batch(texts)
            sym, own, lo, hi = recompress(h, doc)
            bare = _starts(lens, width) & ~_covered(lo, hi, len(h), width)
            open_ = np.bincount(doc[bare], minlength=len(lists)) > 0
            joined = [b" ".join(ws) for ws in lists]
            names = [_split128(xxhash.xxh3_128_intdigest(j)) for j in joined]
            keep = (lens[own] >= width) & (lo >= 0) & (hi <= len(h)) & (hi - lo <= width)
            sym, own = sym[keep], own[keep]
            # once per document
            by = np.lexsort((sym, own))
            sym, own = sym[by], own[by]
            once = np.ones(len(sym), dtype=bool)
            once[1:] = (sym[1:] != sym[:-1]) | (own[1:] != own[:-1])
            sym, own = sym[once], own[once]
            symbols = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(lists) + 1)).astype(np.int32)), pa.array(signed(sym)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lens), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                 pa.array([hashlib.sha256(j).hexdigest() for j in joined]), pa.array(open_), symbols],
                ["id", "n", "s1", "s2", "sha", "open", "symbols"])

    return run


def _second(h: np.ndarray, width: int) -> np.ndarray:
    return (window_hashes(mix(h + np.uint64(7)), width) >> np.uint64(33)).astype(np.int64).astype(np.int32)


def _candidates(width: int):
    """Windows without an unshared settled symbol, each window of a document once."""

    def run(batches):
        for ids, shared, texts in rows(batches, "id", "shared", "text"):
            lists, h, doc, lens = _batch(texts)
            sym, own, lo, hi = recompress(h, doc)
            starts = np.searchsorted(own, np.arange(len(lists) + 1))
            unshared = np.ones(len(sym), dtype=bool)
            for i, names in enumerate(shared):
                if names:
                    part = slice(starts[i], starts[i + 1])
                    unshared[part] = ~np.isin(sym[part], np.array(names, dtype=np.int64).view(np.uint64))
            hot = _starts(lens, width) & ~_covered(lo[unshared], hi[unshared], len(h), width)
            end = np.cumsum(lens)
            for i in np.flatnonzero(np.bincount(doc[hot], minlength=len(lists))):
                a, b = int(end[i] - lens[i]), int(end[i])
                at = np.flatnonzero(hot[a : b - width + 1])
                w1, w2 = window_hashes(h[a:b], width)[at], _second(h[a:b], width)[at]
                _, first = np.unique(w1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(w1[first])), pa.array(w2[first]), pa.array(np.full(len(first), ids[i], dtype=np.int64))], ["w1", "w2", "id"])

    return run


def _cut(width: int):
    """Words covered by a listed window go."""

    def run(batches):
        for ids, s1, s2, gone, texts in rows(batches, "id", "s1", "s2", "gone", "text"):
            lists, h, _, lens = _batch(texts)
            end = np.cumsum(lens)
            out = []
            for i, ws in enumerate(lists):
                if _split128(xxhash.xxh3_128_intdigest(b" ".join(ws))) != (s1[i], s2[i]):
                    continue  # another text under the same id
                a, b = int(end[i] - lens[i]), int(end[i])
                hit = np.isin(window_hashes(h[a:b], width), np.array(gone[i], dtype=np.int64).view(np.uint64))
                step = np.zeros(b - a + 1, dtype=np.int64)
                at = np.flatnonzero(hit)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                covered = np.cumsum(step[:-1]) > 0
                kept = b" ".join(w for w, c in zip(ws, covered.tolist(), strict=True) if not c)
                out.append((ids[i], s1[i], s2[i], int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["id", "s1", "s2", "removed", "cut_sha", "kept"])

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = ID, text_col: str = TEXT, width: int = 50, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts in a document with a smaller id.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 (hex, of the kept words
    joined by one space) and, with ``keep_text``, kept_text.  Windows are judged on the input.

    Null and empty texts have no words and nothing to remove.  Rows with a null id come back whole
    and are nobody's source.  Rows that share an id do not remove from each other; each loses what a
    smaller id has.  Copies of a whole text (equal word sequences) are settled by the least id of
    the group without comparing them.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the corpus is recompressed once for all of this
    about = stored(docs.mapInArrow(_describe(width), "id long, n long, s1 long, s2 long, sha string, open boolean, symbols array<long>"), "texts")
    lead = stored(about.where(f"id is not null and n >= {width}").groupBy("s1", "s2").agg(F.min("id").alias("lead"), F.max("open").alias("open")), "leads")

    symbols = about.select(F.explode("symbols").alias("name"), "s1")
    names = symbols.groupBy("name").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("name")
    shared = symbols.join(names, "name").groupBy("s1").agg(F.collect_set("name").alias("shared"))
    look = stored(lead.join(shared, "s1", "left").where("open or shared is not null").select(F.col("lead").alias("id"), "s1", "s2", "shared"), "shared-symbols")

    some = passing(docs, "id", id_filter(look.select("id")))
    windows = stored(some.join(look, "id").select("id", "shared", "text").mapInArrow(_candidates(width), "w1 long, w2 int, id long"), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").drop("last")
    gone = windows.join(least, ["w1", "w2"]).where("source < id").groupBy("id").agg(F.collect_set("w1").alias("gone"))
    gone = stored(gone.join(look.select("id", "s1", "s2"), "id"), "gone")
    cut = passing(docs, "id", id_filter(gone.select("id"))).join(gone, "id").select("id", "s1", "s2", "gone", "text")
    cut = cut.mapInArrow(_cut(width), "id long, s1 long, s2 long, removed long, cut_sha string, kept string")
    cut = (cut if keep_text else cut.drop("kept")).dropDuplicates(["id", "s1", "s2"])

    out = about.drop("symbols").join(lead.drop("open"), ["s1", "s2"], "left").join(cut, ["id", "s1", "s2"], "left")
    copy = F.coalesce(F.col("lead") < F.col("id"), F.lit(False))
    result = out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text")] if keep_text else []))
    if keep_text:  # untouched texts keep their words
        plain = docs.select(F.col("id").alias("doc_id"), F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("words"))
        plain = plain.withColumn("kept_sha256", F.sha2("words", 256)).dropDuplicates()
        result = result.join(plain, ["doc_id", "kept_sha256"], "left").select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("kept_text", "words").alias("kept_text"))
    return result
