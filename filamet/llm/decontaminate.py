"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item is a tiny part of a long document, so their Jaccard similarity says little.  Items
are therefore partitioned by size: partition m holds items of m/2 < n <= m shingles, and for it each
document is read as overlapping segments of 2m shingles.  An item that lies in the document fills a
fixed share of some segment, whatever the document's length.  A segment is a candidate if one of the
MinHash values of its partition equals the item's (with SLOTS values an item with containment 0.8 in
one segment is missed with a probability below 1e-4 in the worst case).  Segment minima of partition
2m follow from those of m, so all partitions cost one pass.  Items of up to TINY shingles are looked
up by each of their shingles.

Candidates are verified by exact containment: the share of the item's distinct shingles that the
whole document holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, _bit, hash_words, id_filter, mix, rows, signed, split_words, stored, without
from filamet.llm.shared import windows as window_hashes

SLOTS = 48
TINY = 8
SMALLEST = 16

_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def partition_of(n: int) -> int:
    """Size partition of an item: 0 for tiny ones, else the least power of two that holds n."""
    return 0 if n <= TINY else max(SMALLEST, 1 << (n - 1).bit_length())


def _key(values: np.ndarray, slot: int, part: int) -> np.ndarray:
    return mix(values + np.uint64(part) * np.uint64(SLOTS) + np.uint64(slot))


def _run(words: list[bytes], h: np.ndarray, width: int) -> np.ndarray:
    """Shingle hashes in text order; a shorter text is one shingle."""
    return window_hashes(h, len(h)) if 0 < len(words) < width else window_hashes(h, width)


def item_keys(run: np.ndarray) -> np.ndarray:
    """Search keys of an item."""
    part = partition_of(len(np.unique(run)))
    if part == 0:
        return _key(np.unique(run), 0, 0)
    return np.concatenate([_key((run * _SEEDS[i]).min(keepdims=True), i, part) for i in range(SLOTS)])


def _items(width: int):
    def run(batches):
        for ids, texts in rows(batches, "id", "text"):
            out = []
            for i, t in zip(ids, texts, strict=True):
                words = split_words(t, True)
                if words:
                    r = _run(words, hash_words(words), width)
                    n = len(np.unique(r))
                    out.append((i, n, partition_of(n), signed(np.unique(r)).tolist(), signed(item_keys(r)).tolist()))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item", "n", "part", "shingles", "keys"])

    return run


def _segments(runs: list[np.ndarray], parts: list[int], passing) -> list[set[int]]:
    """Per document: keys of its segments that pass the bitmap."""
    found: list[set[int]] = [set() for _ in runs]
    lens = np.array([len(r) for r in runs])
    joined = np.concatenate(runs)
    if not len(joined):
        return found
    top = max(parts, default=0)
    # block starts per level: level 0 cuts each document into SMALLEST shingles, level k+1 pairs up level k
    levels, owner = [], None
    starts, who, at = [], [], 0
    for d, n in enumerate(lens.tolist()):
        cut = np.arange(at, at + n, SMALLEST)
        starts.append(cut)
        who.append(np.full(len(cut), d))
        at += n
    first, owner = np.concatenate(starts), np.concatenate(who)
    levels.append((first, owner))
    size = SMALLEST
    while size < top:
        counts = np.bincount(owner, minlength=len(runs))
        base = np.concatenate(([0], np.cumsum(counts)[:-1]))
        rank = np.arange(len(owner)) - base[owner]
        first = np.flatnonzero(rank % 2 == 0)
        owner = owner[first]
        levels.append((first, owner))
        size *= 2
    for slot in range(SLOTS):
        values = joined * _SEEDS[slot]
        size = SMALLEST
        for first, own in levels:
            values = np.minimum.reduceat(values, first)
            if size in parts:
                both = values.copy()
                same = own[1:] == own[:-1]
                both[:-1] = np.where(same, np.minimum(values[:-1], values[1:]), values[:-1])
                keys = _key(both, slot, size)
                for i in np.flatnonzero(passing(keys)):
                    found[own[i]].add(int(keys[i].view(np.int64)))
            size *= 2
    return found


def _search(width: int, parts: list[int], key_bits, shingle_bits):
    """Texts with a candidate key: their keys and those of their shingles that some item has."""

    def run(batches):
        keys_in, shingles_in = key_bits.value, shingle_bits.value

        def passes(bits, x):
            at = _bit(signed(x))
            return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

        for k1, k2, texts in rows(batches, "k1", "k2", "text"):
            lists = [split_words(t, True) for t in texts]
            h = hash_words([w for ws in lists for w in ws])
            runs, at = [], 0
            for ws in lists:
                runs.append(_run(ws, h[at : at + len(ws)], width))
                at += len(ws)
            found = _segments(runs, [p for p in parts if p], lambda x: passes(keys_in, x))
            out = []
            for i, r in enumerate(runs):
                if 0 in parts and len(r):
                    tiny = _key(r, 0, 0)
                    found[i].update(signed(np.unique(tiny[passes(keys_in, tiny)])).tolist())
                if found[i]:
                    out.append((k1[i], k2[i], sorted(found[i]), signed(np.unique(r[passes(shingles_in, r)])).tolist()))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k1", "k2", "keys", "near"])

    return run


def _text_key(text):
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def _contained(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, width: int, percent: int) -> DataFrame:
    """(k1, k2, item, n_shared, n_item) for every text and item with enough containment."""
    items = stored(
        benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct().mapInArrow(_items(width), "item long, n long, part long, shingles array<long>, keys array<long>"),
        "benchmark-items").withColumn("row", F.xxhash64("item", "shingles"))
    parts = [r["part"] for r in items.select("part").distinct().collect()]  # powers of two: some dozens
    key_bits, shingle_bits = (id_filter(items.select(F.explode(c))) for c in ("keys", "shingles"))
    texts = docs.select(*_text_key(F.col(text_col)), F.col(text_col).alias("text")).where("text is not null")
    hits = texts.mapInArrow(_search(width, parts, key_bits, shingle_bits), "k1 long, k2 long, keys array<long>, near array<long>")
    hits = stored(hits, "benchmark-hits")
    pairs = hits.select("k1", "k2", F.explode("keys").alias("key")).join(items.select("row", F.explode("keys").alias("key")), "key").select("k1", "k2", "row").distinct()
    near = hits.select("k1", "k2", "near").dropDuplicates(["k1", "k2"])
    checked = pairs.join(items.select("row", "item", "n", "shingles"), "row").join(near, ["k1", "k2"])
    checked = checked.withColumn("n_shared", F.size(F.array_intersect("near", "shingles")).cast("long"))
    return checked.where(F.col("n_shared") * 100 >= F.col("n") * percent).groupBy("k1", "k2", "item", F.col("n").alias("n_item"), "n_shared").agg(F.lit(1).alias("x")).drop("x")


def contained_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = ID, text_col: str = TEXT, item_col: str = "item_id", item_text: str = TEXT, width: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct shingles it holds ``percent`` or more.

    Returns doc_id, item_id, n_item (distinct shingles of the item), n_shared (those of them in the
    document).  Words are runs of non-white-space with A-Z lower-cased; a text with fewer words than
    ``width`` is one shingle.

    Null and empty texts are in no pair, on either side.  Null ids appear in pairs as null.  A
    repeated document row repeats its pairs; a repeated item counts once, and two items under one id
    give a row each.  Other columns are ignored.
    """
    found = _contained(docs, benchmark, text_col, item_col, item_text, width, percent)
    keys = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *_text_key(F.col(text_col)))
    return keys.join(found, ["k1", "k2"]).select("doc_id", F.col("item").alias("item_id"), "n_item", "n_shared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = TEXT, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item (rows with a null text stay)."""
    found = _contained(docs, benchmark, text_col, "item_id", TEXT, width, percent)
    return without(docs, _text_key(F.col(text_col)), stored(found.select("k1", "k2").distinct(), "contaminated"))
