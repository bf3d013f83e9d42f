"""SentencePiece (BPE) encoding that keeps every piece's place in the source text, and decoding.

Normalisation walks a text by the longest prefix in the model's compiled character map (a double
array trie followed by the replacements); what no key starts is taken over character by character.
Each normalised byte remembers the source byte its prefix began at, so a piece, which is a stretch of
normalised bytes, leads straight back to its bytes in the source.  An empty map is the identity.

Pieces arise by merging neighbours, best score first, which the sentencepiece library does with its
own normalisation switched off.  Characters that stand side by side in no piece never end up in one,
so a text is cut there first; units between the cuts merge on their own, and each worker remembers
units it has seen.  A character without a piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, encode, rows

REMEMBERED = 250_000  # units per generation; some 60 MB each
BLANK = "▁"
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6  # piece types of the model format
BPE = 2
REPLACEMENT = "�"


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: size of the trie, its units, replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.replacements = blob[4 + size :]
        self.firsts = {c for c in range(1, 256) if self._child(0, c) is not None} if self.units else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, c: int) -> int | None:
        at = node ^ self._offset(self.units[node]) ^ c
        return at if at < len(self.units) and self.units[at] & 0x800000FF == c else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a position, and what replaces it."""
        node, found = 0, None
        for k in range(at, len(text)):
            node = self._child(node, text[k])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                found = k + 1 - at, self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]


class Normalizer:
    """Normalised text and, for every normalised byte and the end, the source byte it comes from."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharacterMap(charsmap)
        self.dummy, self.squeeze = dummy_prefix, squeeze
        self.blank = BLANK.encode() if escape else b" "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.squeeze:
            return self._identity(text, raw)
        return self._walk(raw)

    def _identity(self, text: str, raw: bytes) -> tuple[str, np.ndarray]:
        blank = self.blank.decode()
        space = np.frombuffer(raw, dtype=np.uint8) == 0x20
        align = np.repeat(np.arange(len(raw)), np.where(space, len(self.blank), 1))
        start = np.zeros(len(self.blank) if self.dummy else 0, dtype=np.int64)
        return (blank if self.dummy else "") + text.replace(" ", blank), np.concatenate((start, align, [len(raw)]))

    def _walk(self, raw: bytes) -> tuple[str, np.ndarray]:
        out, align = bytearray(), []
        at, n = 0, len(raw)
        if self.squeeze:
            while at < n and self._prefix(raw, at)[1] == b" ":
                at += self._prefix(raw, at)[0]
            if at == n:
                return "", np.zeros(1, dtype=np.int64)
        if self.dummy:
            out += self.blank
            align += [at] * len(self.blank)
        after_space = self.squeeze
        while at < n:
            length, new = self._prefix(raw, at)
            if after_space:
                new = new.lstrip(b" ")
            new_blank = new.replace(b" ", self.blank)
            out += new_blank
            align += [at] * len(new_blank)
            at += length
            if new and self.squeeze:
                after_space = new.endswith(b" ")
        if self.squeeze:
            while out.endswith(self.blank):
                del out[-len(self.blank) :]
                at = align[len(out)]
                del align[len(out) :]
        return out.decode("utf-8"), np.array([*align, at], dtype=np.int64)

    def _prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        first = raw[at]
        hit = self.map.longest(raw, at) if first in self.map.firsts else None
        if hit:
            return hit
        length = _char_bytes(first)
        char = raw[at : at + length]
        try:
            char.decode("utf-8")
        except UnicodeDecodeError:  # half of a surrogate pair
            return 1, REPLACEMENT.encode()
        return length, char


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE or model.trainer_spec.treat_whitespace_as_suffix or kinds & {USER, UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces and suffix blanks are supported")
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # units come normalised: merging must leave them as they are
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.merging = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.unk, self.bos, self.eos, self.size = self.whole.unk_id(), self.whole.bos_id(), self.whole.eos_id(), len(model.pieces)
        written = [p.piece for p in model.pieces if p.type not in (UNKNOWN, CONTROL, BYTE)]
        self.units = unit_pattern(written)
        # normalised bytes of a piece; those of unknown characters are set apart
        self.width = np.array([1 if p.type in (UNKNOWN, CONTROL, BYTE) else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> None:
        """Remember the ids of units; those of the old generation become young again."""
        young, old = self.young, self.old
        fresh = []
        for u in units:
            if u not in young:
                if u in old:
                    young[u] = old[u]
                else:
                    fresh.append(u)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            found = self.merging.encode(part, num_threads=1)
            cut = [0, *accumulate(4 * len(f) for f in found)]
            raw = np.fromiter(chain.from_iterable(found), dtype="<i4", count=cut[-1] // 4).tobytes()
            young.update(zip(part, (raw[a:b] for a, b in pairwise(cut)), strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids with begin and end id, and for each the source bytes [start, end) it stands for."""
        normal = [self.normalize(t or "") for t in texts]
        units = [self.units.findall(n) for n, _ in normal]
        every = {u for us in units for u in us}
        if len(self.young) + len(every) > REMEMBERED:
            self.old, self.young = self.young, {}
        self._learn(every)
        recall, out = self.young.__getitem__, []
        for t, us, (n, align) in zip(texts, units, normal, strict=True):
            ids = np.frombuffer(b"".join(map(recall, us)), dtype="<i4")
            starts, ends = self._spans(ids, n, align)
            end = len(encode(t))
            out.append((np.concatenate(([self.bos], ids, [self.eos])), np.concatenate(([0], starts, [end])), np.concatenate(([0], ends, [end]))))
        return out

    def _spans(self, ids: np.ndarray, normal: str, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.width[ids]
        unknown = np.flatnonzero(ids == self.unk)
        byte = np.flatnonzero(self.is_byte[ids])
        raw = normal.encode("utf-8", "surrogatepass") if len(unknown) or len(byte) else b""
        if len(unknown):  # as long as the first byte of the character says
            before, longer = np.cumsum(width) - width, 0
            for k in unknown.tolist():
                width[k] = _char_bytes(raw[int(before[k]) + longer])
                longer += int(width[k]) - 1
        stop = np.cumsum(width)
        start = stop - width
        starts, ends = align[start], align[stop]
        if len(byte):
            # all bytes of a character begin where it does; only the last one stands for it
            value = np.frombuffer(raw, dtype=np.uint8)[start[byte]]
            lead = np.maximum.accumulate(np.where(value & 0xC0 != 0x80, np.arange(len(byte)), 0))
            last = np.append(lead[1:] != lead[:-1], True)
            starts[byte] = starts[byte][lead]
            ends[byte] = np.where(last, ends[byte], starts[byte])
        return starts, ends

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


def unit_pattern(written: list[str]) -> re.Pattern:
    """Pattern of the units of a normalised text.

    Two characters that stand side by side in no piece never meet in one.  If nothing but a blank
    stands before a blank, texts are cut where words end; besides between letters and the signs that
    follow no letter in a piece, and around control characters that are in no piece.
    """
    joints = {p[k : k + 2] for p in written for k in range(len(p) - 1)}
    if any(b == BLANK and a != BLANK for a, b in joints):
        return re.compile(r"(?s).+")
    after_letter = {b for a, b in joints if re.fullmatch(r"[^\W\d_]", a)}
    signs = "".join(re.escape(c) for c in map(chr, range(128)) if not c.isalnum() and c not in after_letter)
    alone = "".join(re.escape(c) for c in map(chr, range(32)) if not any(c in p for p in written))
    if not signs or not alone:
        return re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
    return re.compile(rf"{BLANK}*[^\W\d_]++(?=[{signs}])|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|[{alone}]")


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, once per Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Piece ids of every whole text, with begin and end id: doc_id, ids, starts, ends.

    Piece k stands for the bytes [starts[k], ends[k]) of the text in UTF-8.  The blank put before a
    text belongs to no byte; of the bytes of a character without a piece the last one stands for it.

    A null or empty text has the begin and end id only.  Null ids keep their row; repeated rows give
    a row each; an empty table gives none.  Other columns are ignored.  Texts are worked on in parts
    of about 2 MB; a longer one alone, with some 40 bytes per byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(model)
        for names, texts in rows(batches, "id", "text"):
            found = machine.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(_lists([f[k] for f in found]) for k in range(3))], ["doc_id", "ids", "starts", "ends"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model: str, *, id_col: str = ID, ids_col: str = "ids") -> DataFrame:
    """Texts of piece ids: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded.

    Null ids count as none.  An id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(model)
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.column(1).slice(at, 1)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype("<u4")
                if len(ids) and int(ids.max()) >= machine.size:
                    raise ValueError(f"no piece has the id {int(ids.max())}")
                text = encode(machine.decode(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([len(ids)], pa.int64()), pa.array([hashlib.sha256(ids.tobytes()).hexdigest()]), pa.array([text], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded string")
