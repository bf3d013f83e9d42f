"""Helpers shared by the corpus operators: stored tables, words, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet.session import checkpoint_root, find_package

ARROW_ROWS = 1000
ARROW_BYTES = 8_000_000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators count on: workers find the package, and texts, which may be long,
    go to them in small batches, so that what a worker holds stays a few megabytes."""
    find_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ID = "doc_id"
TEXT = "text"


_NOTED: list[list[str]] = []


@contextmanager
def noted():
    """Collect the paths of the tables stored in this block, for ``delete_tables``."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def delete_tables(spark: SparkSession, paths: Iterable[str], keep: DataFrame) -> None:
    """Delete stored tables, but for those that ``keep`` reads."""
    used = keep.inputFiles()
    for path in paths:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in u for u in used):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back; survives lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _NOTED:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a lambda would otherwise repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def total(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


# -- inside Python tasks ------------------------------------------------------------------------

PART_BYTES = 2_000_000


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (bytes.split knows exactly \\x20 and \\x09-\\x0d)."""
    raw = encode(text)
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries (none if there are fewer)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n] + np.uint64(width)
    for k in range(1, width):
        out = out * MULTIPLIER + h[k : n + k]
    return mix(out)


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a shorter text is one shingle, no words none."""
    if 0 < len(h) < width:
        return windows(h, len(h))
    return np.unique(windows(h, width))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of each batch as lists, in parts of about PART_BYTES of the last column's text."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * PART_BYTES / max(1, cols[-1].nbytes)))
        for at in range(0, batch.num_rows, step):
            yield tuple(c.slice(at, step).to_pylist() for c in cols)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# -- counters of fixed size ----------------------------------------------------------------------


def _add_chunks(batches):
    """Sums per chunk; what is held is bounded by the number of chunks, not by the rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            value = np.frombuffer(raw, dtype="<u4").astype(np.int64)
            sums[chunk] = sums[chunk] + value if chunk in sums else value
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])


def summed_chunks(chunks: DataFrame, number: int, size: int) -> np.ndarray:
    """Add up (chunk, counts) rows of little-endian 32-bit counters; ``number * size`` of them reach the driver."""
    out = np.zeros((number, size), dtype=np.int64)
    for row in chunks.repartition(min(16, number), "chunk").mapInArrow(_add_chunks, "chunk int, counts binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype="<i8")
    return out


# -- fixed-size filter of ids -------------------------------------------------------------------

FILTER_BITS = 1 << 23


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(41)).astype(np.int64)


def _filter_words(batches):
    for batch in batches:
        bit = np.unique(_bit(batch.column(0).drop_null().to_numpy()))
        word, at = np.unique(bit >> 6, return_index=True)
        if len(word):
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(signed(bits))], ["word", "bits"])


def id_filter(ids: DataFrame):
    """Broadcast bitmap of FILTER_BITS bits (1 MB) with the hashes of a column of ids.

    It only thins out rows before an exact join, so hash clashes and a full bitmap are harmless.
    """
    words = ids.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    for row in words.toLocalIterator():  # FILTER_BITS / 64 rows at most
        bitmap[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def passing(docs: DataFrame, column: str, bitmap, inverse: bool = False) -> DataFrame:
    """Rows whose id may be in the bitmap (null ids never are), or all others."""
    at = docs.columns.index(column)

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            ids = batch.column(at)
            bit = _bit(ids.fill_null(0).to_numpy())
            hit = (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            hit &= ~ids.is_null().to_numpy(zero_copy_only=False)
            hit ^= inverse
            if hit.any():
                yield batch.filter(pa.array(hit))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, keys: Sequence[Column], gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose keys are not a row of ``gone``; the first key has 64 bits.

    Only rows whose first key may be listed (by a bitmap of fixed size) are shuffled for the exact join.
    """
    names = [free_name(docs, f"_key{i}") for i in range(len(keys))]
    bitmap = id_filter(gone.select(gone.columns[0]))
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    listed = passing(keyed, names[0], bitmap).join(gone.toDF(*names), names, "left_anti")
    return passing(keyed, names[0], bitmap, inverse=True).drop(*names).unionByName(listed.drop(*names))
