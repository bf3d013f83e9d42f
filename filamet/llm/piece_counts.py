"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match tokenisation of a word takes, again and again, the longest vocabulary entry
that starts where the last one ended.  The automaton is a trie of the vocabulary with a failure link
per node: when the next byte has no edge, a number of whole pieces is popped, known in advance for
the node, and matching goes on in the node for what is left.  Each byte is thus read once, and only
counts are added: no piece is ever built.

Construction is breadth first.  For a node v reached from u by byte c: if v is an entry, popping v
yields 1 piece and leaves the root of continuations; else the failure chain of u is walked, adding
its pops, until a node has an edge c.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, split_words

REMEMBERED = 500_000
NONE = -1


class Automaton:
    """``starts`` are the entries that may begin a word, ``inner`` those that may continue one (the same set if not given)."""

    def __init__(self, starts: list[bytes], inner: list[bytes] | None = None):
        self.edges: list[dict[int, int]] = [{}]
        self.final = [False]
        self.root = 0
        self._add(0, starts)
        if inner is None:
            self.inner = 0
        else:
            self.inner = self._node()
            self._add(self.inner, inner)
        self._link()

    def _node(self) -> int:
        self.edges.append({})
        self.final.append(False)
        return len(self.edges) - 1

    def _add(self, top: int, entries: list[bytes]) -> None:
        for entry in entries:
            at = top
            for c in entry:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = self._node()
                at = nxt
            if entry:
                self.final[at] = True

    def _link(self) -> None:
        n = len(self.edges)
        self.fail, self.pops = [NONE] * n, [0] * n
        queue = [self.root] if self.root == self.inner else [self.root, self.inner]
        for u in queue:  # grows while it is read
            for c, v in self.edges[u].items():
                queue.append(v)
                if self.final[v]:
                    self.fail[v], self.pops[v] = self.inner, 1
                    continue
                at, popped = self.fail[u], self.pops[u]
                while at != NONE and c not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != NONE:
                    self.fail[v], self.pops[v] = self.edges[at][c], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 (one unknown piece) if greedy matching gets stuck, 0 for no bytes."""
        at, pieces = self.root, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for c in word:
            while c not in edges[at]:
                pieces += pops[at]
                at = fail[at]
                if at == NONE:
                    return -1
            at = edges[at][c]
        while at != self.inner and at != self.root:
            pieces += pops[at]
            at = fail[at]
            if at == NONE:
                return -1
        return pieces


def vocabulary(path: str) -> list[bytes]:
    """Entries of a .tiktoken file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Counts(dict):
    """Word -> pieces; a bounded memory, so it never changes a result."""

    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.machine.count(word)
        return value


_COUNTS: dict[str, Counts] = {}


def counts_of(path: str) -> Counts:
    """Counts by the automaton of a vocabulary, once per Python worker.

    Byte vocabularies write a leading space into entries that start a word.  A word may start with
    such an entry (without the space) or any other; it goes on with entries without a space.
    """
    if path not in _COUNTS:
        entries = vocabulary(path)
        plain = [e for e in entries if e[:1] != b" "]
        _COUNTS[path] = Counts(Automaton([e[1:] for e in entries if e[:1] == b" " and len(e) > 1] + plain, plain))
    return _COUNTS[path]


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Number of greedy word pieces per text: doc_id, n_words, n_tokens, n_unknown (words that no pieces cover).

    Words are runs of non-white-space (ASCII white space).  A word that cannot be covered counts as
    one token.  Null and empty texts have none.  Null ids keep their row; repeated rows give a row
    each.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counts_of(vocabulary_path).__getitem__
        for batch in batches:
            words_, tokens_, unknown_ = [], [], []
            for text in batch.column(1).to_pylist():
                words = split_words(text)
                counts = np.fromiter(map(pieces, words), dtype=np.int64, count=len(words))
                words_.append(len(words))
                tokens_.append(int(np.abs(counts).sum()))
                unknown_.append(int((counts < 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_, pa.int64()), pa.array(tokens_, pa.int64()), pa.array(unknown_, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")

