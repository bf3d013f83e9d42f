"""Token ids in a bit-packed block format.

Texts are put in ascending order of their id, tokenised and packed: every id takes the number of
bits that the vocabulary needs.  A file is a Parquet dataset of blocks:

    shard      int            position of the block's shard in the order
    block      int            position within the shard
    first      long           ids of the shard before this block
    n_ids      int            ids in the block
    least      long           least and greatest id of the block's documents
    greatest   long
    doc_ids    array<long>    documents of the block (whole documents only)
    offsets    array<long>    first id of each document within the block, and the end
    bits       binary         ids, little-endian, ``width`` bits each

Blocks decode alone and at once in numpy; a document is found by its block's row and offset, an id
at bit ``width * offset``.  Documents before a shard follow from the sums of ``n_ids``.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, rows, split_words

BLOCK_IDS = 1 << 16
REMEMBERED = 500_000  # words per generation; some 100 MB each
JOINED = 500  # words of letters that go through the tokenizer as one text
WORD_END = "</w>"  # ends the pieces that end a word
MARKS = re.compile("[\u0300-\u036f]")
CLOSING = re.compile(r"[.,;:!?](?<=[^\W_][.,;:!?])[.,;:!?]*(?!\S)")
SCHEMA = "shard int, block int, first long, n_ids int, least long, greatest long, doc_ids array<long>, offsets array<long>, bits binary"


def bit_width(vocabulary: int) -> int:
    """Bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian bit stream of ids."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from position ``start`` on, without decoding what comes before."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=n, offset=start * width // 8).astype(np.uint32)
    lo, hi = start * width // 8, -(-(start + n) * width // 8)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=hi - lo, offset=lo), bitorder="little")
    skip = start * width - lo * 8
    table = bits[skip : skip + n * width].reshape(n, width).astype(np.uint32)
    return (table << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of a text, word by word.

    The tokenizer drops white space and never joins what it separates, so the ids of a text are
    those of its words.  Words are remembered in two generations: what is used again stays.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.special = [a.content.lower().encode() for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _recall(self, words: set[bytes]) -> list[bytes]:
        """Words that are not remembered; those of the old generation become young again."""
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        return new

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words.

        A word of letters is one stretch for the tokenizer, so its last id is the first one that ends
        a word.  Many such words go through it as one text, cut at these ids; where their number does
        not fit (letters that normalise to something else) each word goes on its own.
        """
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        alone = [k for k, t in enumerate(texts) if not t.isalpha()]
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        parts = [letters[at : at + JOINED] for at in range(0, len(letters), JOINED)]
        for at in range(0, len(parts), 16):
            some = parts[at : at + 16]
            for part, e in zip(some, self._batch([" ".join([texts[k] for k in part]) for part in some]), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                end = np.flatnonzero(self.ends[ids]) + 1
                if len(end) != len(part) or len(ids) != end[-1]:
                    alone += part
                    continue
                raw, cut = ids.tobytes(), [0, *(4 * end).tolist()]
                self.young.update((words[k], raw[i:j]) for k, i, j in zip(part, cut, cut[1:], strict=False))
        for at in range(0, len(alone), 10_000):
            part = alone[at : at + 10_000]
            for k, e in zip(part, self._batch([texts[k] for k in part]), strict=True):
                self.young[words[k]] = np.array(e.ids, dtype="<u4").tobytes()

    def _batch(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _words(self, text: str | None) -> list[bytes]:
        """Words of a text such that their ids are its ids, and few differ.

        Sentence marks at the end of a word stand alone if a letter or number is before them, and ASCII
        letters are lower-cased unless the text has combining marks, which join some lower-case letters
        only.  A text that spells a special token, in whatever case, stays as it is.
        """
        text = text or ""
        raw = CLOSING.sub(r" \g<0>", text).encode("utf-8", "surrogatepass")
        low = raw.lower()
        if any(s in low for s in self.special):
            return split_words(text)
        return (raw if MARKS.search(text) else low).split()

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian 32-bit ids per text."""
        lists = [self._words(t) for t in texts]
        words = {w for ws in lists for w in ws}
        if len(self.young) + len(words) > REMEMBERED:
            self.old, self.young = self.young, {}
        self._learn(self._recall(words))
        young = self.young
        return [b"".join(map(young.__getitem__, ws)) for ws in lists]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(path: str, width: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc, shard = encoder(path), TaskContext.get().partitionId()
        block = first = 0
        docs: list = []
        parts: list[bytes] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
            known = [d for d in docs if d is not None] or [None]
            values = [[shard], [block], [first], [len(ids)], [known[0]], [known[-1]], [docs], [offsets.tolist()], [pack(ids, width)]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "block", "first", "n_ids", "least", "greatest", "doc_ids", "offsets", "bits"])

        for names, texts in rows(batches, "id", "text"):
            for name, raw in zip(names, enc.encode(texts), strict=True):
                docs.append(name)
                parts.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= BLOCK_IDS:
                    yield close()
                    first, block, docs, parts, size = first + size, block + 1, [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, *, end_id: int = 2, id_col: str = ID, text_col: str = TEXT) -> int:
    """Write the token file of all texts in ascending id order; returns the bit width.

    Each text is followed by ``end_id``.  A null text counts as empty; null ids come first; rows with
    equal ids are ordered by a hash of their text.  An empty table gives a file without blocks.
    Other columns are ignored.
    """
    width = bit_width(max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1))
    order = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    ordered = order.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(_blocks(tokenizer, width, end_id), SCHEMA).write.option("compression", "zstd").parquet(out)
    return width


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, width: int, *, with_ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["bits"], width, b["n_ids"]).astype("<u4")
                cut = b["offsets"]
                pieces = [ids[i:j] for i, j in zip(cut, cut[1:], strict=False)]
                cols = [pa.array([b["shard"]] * len(pieces), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array([b["first"] + i for i in cut[:-1]], pa.int64()), pa.array([len(p) for p in pieces], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([p.tolist() for p in pieces], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    blocks = read_blocks(spark, path)
    docs = blocks.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # one row per shard: as many as the writing job had tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_at(spark: SparkSession, path: str, width: int, doc_ids: list[int]) -> list[tuple[int, list[int]]]:
    """Random access: ids of a few documents, decoding only their own bits.

    Ids ascend through the file, so the statistics of ``least`` and ``greatest`` leave few row groups to read.
    """
    wanted = set(doc_ids)
    blocks = read_blocks(spark, path).where(reduce(or_, [(F.col("least") <= d) & (F.col("greatest") >= d) for d in wanted], F.lit(False)))
    return [(d, unpack(b["bits"], width, j - i, i).tolist()) for b in blocks.toLocalIterator() for d, i, j in zip(b["doc_ids"], b["offsets"], b["offsets"][1:], strict=False) if d in wanted]
