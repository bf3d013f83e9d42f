"""Hierarchical bootstrap: images, then fibers, then sections, all with replacement."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.operators.ordered import order_bucket, ordered, with_value_bucket
from filamet.operators.quantiles import exact_quantiles
from filamet.session import find_package, stored

BLOCK = 100_000
#: images with at most so many sections are drawn from as one row
WHOLE = 20_000
#: draws made at once
DRAWS = 100_000
#: draws of one task, in a few seconds
TASK_DRAWS = 16_000_000


def draw(seed: int, n: Column, *path: Column) -> Column:
    """Deterministic draw in 1..n from the seed and the position in the resampling tree."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in path]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n + 1).cast("long")


def _slots(df: DataFrame, size: str, name: str, spread: list[str]) -> DataFrame:
    """One row per slot 1..size; a large group is dealt out over tasks block by block."""
    blocks = df.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / BLOCK).cast("long"))))
    dealt = blocks.repartition(*spread, "_blk")
    first = F.col("_blk") * BLOCK + 1
    return dealt.withColumn(name, F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col(size))))).drop("_blk")


def _append(text: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> None:
    """Add "|" and the number in decimal to each row of bytes, in place; ``size`` has the lengths."""
    flat, at = text.reshape(-1), np.arange(len(text)) * text.shape[1] + size
    flat[at] = ord("|")
    digits, rest = np.ones(len(text), dtype=np.int64), numbers
    while (rest := rest // 10).any():
        digits += rest > 0
    last, rest = at + digits, numbers
    for k in range(digits.max(initial=0)):
        some = slice(None) if k == 0 else digits > k
        flat[last[some] - k] = 48 + rest[some] % 10
        rest = rest // 10
    size += digits + 1


#: MD5 (RFC 1321): additive constants and shifts of its 64 steps
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: rows digested at once, so that the state stays in the cache
LANES = 16_384


def _md5_heads(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """First word of the MD5 state of messages of one block: ``words`` by rows, zero beyond the message; ``bits`` are their lengths."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _START)
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(61):  # the last three steps leave this word alone
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        if word < len(words):
            np.add(f, words[word], out=f)
        elif word == 14:
            np.add(f, bits, out=f)
        shift = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(shift), out=t)
        np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


def _drawn(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First 32 bits of each path's digest, the number that ``draw`` takes modulo the group's size.

    The rows of ``text`` have room for a byte beyond the path; what is there is overwritten.
    """
    if text.shape[1] > 56:  # two blocks; only for seeds of more than 64 bits
        return np.array([int.from_bytes(md5(row[:n].tobytes()).digest()[:4], "big") for row, n in zip(text, size, strict=True)], dtype="i8")
    text.reshape(-1)[np.arange(len(text)) * text.shape[1] + size] = 0x80
    out = np.empty(len(text), dtype="<u4")
    for at in range(0, len(text), LANES):
        words = np.ascontiguousarray(text[at : at + LANES].view("<u4").T)
        out[at : at + LANES] = _md5_heads(words.astype(np.uint32, copy=False), (8 * size[at : at + LANES]).astype(np.uint32))
    return out.view(">u4").astype("i8")


def _image_medians(seed: int):
    """For every image slot: the median of each fiber slot's resampled sections.

    Sections are numbered by value, so the median of the drawn ones stands at the middle of their
    sorted numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_text = np.frombuffer(str(seed).encode(), dtype=np.uint8)
        for batch in batches:
            for fibers, slots in zip(batch.column("fibers"), batch.column("slots"), strict=True):
                values = fibers.values.flatten().to_numpy(zero_copy_only=False)
                n_sec = np.array([len(f) for f in fibers])
                first = np.cumsum(n_sec) - n_sec
                reps, places = (slots.values.field(k).to_numpy(zero_copy_only=False).astype("i8") for k in ("r", "si"))
                room = len(start_text) + sum(1 + len(str(x)) for x in (reps.max(), places.max(), len(n_sec), n_sec.max()))
                some = max(1, DRAWS // len(values))
                for at in range(0, len(reps), some):
                    r = reps[at : at + some]
                    text = np.zeros((len(r), room // 4 * 4 + 4), dtype=np.uint8)
                    text[:, : len(start_text)] = start_text
                    size = np.full(len(r), len(start_text))
                    _append(text, size, r)
                    _append(text, size, places[at : at + some])
                    text, size = np.repeat(text, len(n_sec), axis=0), np.repeat(size, len(n_sec))
                    _append(text, size, np.tile(np.arange(1, len(n_sec) + 1), len(r)))
                    f = _drawn(text, size) % len(n_sec)
                    sizes = n_sec[f]
                    start = np.cumsum(sizes) - sizes
                    text, size = np.repeat(text, sizes, axis=0), np.repeat(size, sizes)
                    _append(text, size, np.arange(1, len(text) + 1) - np.repeat(start, sizes))
                    drawn = _drawn(text, size)
                    # sorted within each fiber slot
                    keys = np.repeat(np.arange(len(sizes)) * WHOLE, sizes) + drawn % np.repeat(sizes, sizes)
                    keys.sort()
                    low, high = (values[first[f] + keys[start + k] % WHOLE] for k in ((sizes - 1) // 2, sizes // 2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r.astype("i4"), len(n_sec))), pa.array(low + (high - low) * 0.5)], ["r", "m"])

    return run


def hierarchical_bootstrap(df: DataFrame, image: str, fiber: str, x: str, ident: str, *, replicates: int, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of the median of fiber medians over the replicates.

    Members are numbered once; each resampled image slot draws a number and joins to it.  An image of at
    most ``WHOLE`` sections is one row, from which its slots draw without another shuffle; sections of
    a larger one join slot by slot, so no such group is ever collected.  ``image`` must be numeric;
    ``ident`` orders sections within a fiber.
    """
    find_package(df.sparkSession)
    rows = df.select(F.col(image).alias("img"), F.col(fiber).alias("fib"), F.col(x).alias("v"), F.col(ident).alias("id")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = rows.groupBy("img", "fib").agg(F.count(F.lit(1)).alias("n_sec"))
    fib = stored(ordered(order_bucket(sizes, ["img"], ["fib"]), ["img"], ["fib"], number="f"), "fibers")
    per_image = fib.groupBy("img").agg(F.count(F.lit(1)).alias("n_fib"), F.sum("n_sec").alias("n_rows"))
    img = stored(ordered(order_bucket(per_image, [], ["img"]), [], ["img"], number="i", count="n_img"), "images")

    # the drawing takes time by its draws, not by the few bytes that it reads
    tasks = max(1, math.ceil(replicates * (img.agg(F.sum("n_rows")).first()[0] or 0) / TASK_DRAWS))
    # every image slot of every replicate draws an image; the images alone are one small file
    plan = img.repartition(tasks, "i").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select("r", F.col("i").alias("si"), draw(seed, F.col("n_img"), F.col("r"), F.col("i")).alias("i"))
    small = F.col("n_rows") <= WHOLE
    per_fiber = rows.join(img.where(small).select("img"), "img").groupBy("img", "fib").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    whole = per_fiber.repartition(tasks, "img").groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("fib", "vs"))), lambda s: s["vs"]).alias("fibers"))
    chosen = plan.join(img.where(small).select("i", "img"), "i").repartition(tasks, "img").groupBy("img").agg(F.collect_list(F.struct("r", "si")).alias("slots"))
    medians = chosen.join(whole, "img").select("fibers", "slots").mapInArrow(_image_medians(seed), "r int, m double")
    if img.where(~small).limit(1).count():
        medians = medians.unionByName(_joined_medians(rows, fib, img.where(~small), plan, seed))
    # wide buckets: a task's counts of all replicates stay few, and still only a row in some hundred is kept
    per_rep = exact_quantiles(stored(medians, "medians"), ["r"], "m", [0.5], names=["m"], per_octave=64, few=True)
    # one row per replicate from here on
    return per_rep.agg(
        F.avg("m").alias("bootstrap_mean"), F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"),
        F.count("m").alias("replicates"),
    )


def _joined_medians(rows: DataFrame, fib: DataFrame, img: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Medians of the fiber slots of the images given, of any size: every resampled slot joins to its section."""
    sec = ordered(with_value_bucket(rows.join(img.select("img"), "img"), ["img", "fib"], "v", ["id"]), ["img", "fib"], ["v", "id"], number="s")
    plan = plan.join(img.select("i", "img", "n_fib"), "i")
    plan = _slots(plan, "n_fib", "sf", ["r", "si"])
    plan = plan.withColumn("f", draw(seed, F.col("n_fib"), F.col("r"), F.col("si"), F.col("sf"))).join(fib, ["img", "f"])
    plan = _slots(plan.select("r", "si", "sf", "img", "fib", "n_sec"), "n_sec", "ss", ["r", "si", "sf"])
    plan = plan.withColumn("s", draw(seed, F.col("n_sec"), F.col("r"), F.col("si"), F.col("sf"), F.col("ss")))
    drawn = plan.join(sec.select("img", "fib", "s", "v"), ["img", "fib", "s"])
    return exact_quantiles(drawn, ["r", "si", "sf"], "v", [0.5], names=["m"]).select("r", "m")
