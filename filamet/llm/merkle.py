"""Merkle manifest of a dataset as postorder append logs.

Leaves of a group (a source) stand in ascending order of their id; every 16 consecutive nodes become
their parent until one is left, the subroot.  Subroots in order of their group form the top tree.

A tree is written by aligned builders: a builder takes 4096 = 16**3 consecutive leaves from a
multiple of 4096 on and appends each node the moment its last child is there, which is postorder.
Its segment of the log ends with the node that stands for the whole block, and these nodes are the
leaves of the next tier, until a tier fits one segment.  In a segment of m leaves the node i of level
l comes after all leaves up to its last one, the nodes of lower levels over them, and the earlier
nodes of its own and higher levels, so its position has a closed form (``position``); a proof reads
its siblings from there and is continued by the proof of the block's node in the next tier.

No group is in one task: ranks come from a sorted table and the counts of its parts, segments are
dealt out by (group, block).  A tier has 1/4096 of the rows of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamet.llm.shared import ID, stored

FAN = 16
HEIGHT = 3  # levels above the leaves in a full segment
HASH = 32
SEGMENT = "grp string, block long, height int, labels array<string>, claims binary, log binary"
PROOF = "grp string, label string, leaf string, proof_sha256 string, folded string"
SIBLINGS = ", lefts array<string>, rights array<string>"


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).digest()


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FAN), h + 1
    return h


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Position in postorder of node ``index`` of ``level`` in a segment of ``leaves`` leaves.

    Where the node's subtree ends, at leaf r, ceil(r / 16**k) nodes of each lower level k are written
    (the last ones of the segment may lack children); of its own level and each level above, those
    whose leaves all came before.
    """
    r = min((index + 1) * FAN**level, leaves)
    below = sum(-(-r // FAN**k) for k in range(level))
    return below + sum(index // FAN ** (k - level) for k in range(level, height + 1))


def build(leaves: list[bytes], height: int) -> bytes:
    """Append log of a segment: every node right after its last child."""
    log = bytearray()
    open_: list[list[bytes]] = [[] for _ in range(height + 1)]

    def append(level: int, node: bytes) -> None:
        log.extend(node)
        if level < height:
            open_[level].append(node)
            if len(open_[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run = "".join(x.hex() for x in open_[level]).encode()
        open_[level] = []
        append(level + 1, digest(run))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):  # runs that the end of the segment cuts short
        if open_[level]:
            close(level)
    return bytes(log)


class Segment:
    """Proofs out of one segment: digests of a run are read once, by their positions."""

    def __init__(self, log: bytes, leaves: int, height: int):
        self.log, self.height = log, height
        self.counts = [-(-leaves // FAN**k) for k in range(height + 1)]
        self.runs: dict[tuple[int, int], list[str]] = {}

    def node(self, level: int, index: int) -> bytes:
        p = position(level, index, self.counts[0], self.height)
        return self.log[HASH * p : HASH * (p + 1)]

    def run(self, level: int, number: int) -> list[str]:
        if (level, number) not in self.runs:
            self.runs[level, number] = [self.node(level, k).hex() for k in range(FAN * number, min(FAN * number + FAN, self.counts[level]))]
        return self.runs[level, number]

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """Per level: the other nodes of the run, those left and those right of the path."""
        out = []
        for level in range(self.height):
            number, place = divmod(leaf, FAN)
            run = self.run(level, number)
            out.append(("".join(run[:place]), "".join(run[place + 1 :])))
            leaf = number
        return out


def _ranked(leaves: DataFrame, grp: str, *order: str) -> DataFrame:
    """Rows of each group numbered from 0 in their order (column rank), with the group's size (count).

    The table is sorted over all tasks and stored; what precedes a row in other parts of its group
    follows from the counts per part, a small table.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups = batch.column(at).to_pylist()
            place = []
            for g in groups:
                last, seen = g, (seen + 1 if g == last and seen else 1)
                place.append(seen - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(groups), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])

    at = leaves.columns.index(grp)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    ordered = leaves.repartitionByRange(grp, *order).sortWithinPartitions(grp, *order)
    numbered = stored(ordered.mapInArrow(number, f"{kinds}, part int, place long"), "leaves")
    counts = numbered.groupBy(F.col(grp).alias("g"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
    # parts of one group: at most as many as the sort had tasks
    w = Window.partitionBy("g").orderBy("p")
    counts = counts.select("g", "p", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("count"))
    joined = numbered.join(counts, F.col(grp).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*leaves.columns, (F.col("before") + F.col("place")).alias("rank"), "count")


def _builder(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            (grp, block), count = key, held[0][3]
            height = levels if count > FAN**levels else height_of(count)
            values = [[grp], [block], [height], [[r[0] for r in held]], [b"".join(r[2] or r[1] for r in held)], [build([r[1] for r in held], height)]]
            types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["grp", "block", "height", "labels", "claims", "log"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("grp", "block", "label", "leaf", "claim", "count")]
            for grp, block, *row in zip(*cols, strict=True):
                if held and (grp, block) != key:
                    yield close()
                    held = []
                key = grp, block
                held.append(row)
        if held:
            yield close()

    return run


def _last(log: str) -> Column:
    """The segment's last node: that of the whole block."""
    return F.substring(log, -HASH, HASH)


def append_log(leaves: DataFrame, *order: str, levels: int = HEIGHT) -> list[DataFrame]:
    """Write the trees of all groups, a table of segments per tier.

    ``leaves``: grp and label (strings), leaf and claim (binary; a claim is what the leaf's proof is
    tested with, null means the leaf) and the columns they are ordered by.  A segment holds grp, block,
    height, labels, claims and the log.  Above the first tier labels are block numbers of the tier below.
    """
    tiers = []
    while True:
        ranked = _ranked(leaves, "grp", *order).withColumn("block", F.floor(F.col("rank") / FAN**levels).cast("long"))
        dealt = ranked.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").select("grp", "block", "label", "leaf", "claim", "count")
        tier = stored(dealt.mapInArrow(_builder(levels), SEGMENT), "segments")
        tiers.append(tier)
        many = tier.where("block > 0").select(F.col("grp").alias("g")).distinct()
        if many.isEmpty():
            return tiers
        nodes = tier.select("grp", F.col("block").cast("string").alias("label"), _last("log").alias("leaf"), F.lit(None).cast("binary").alias("claim"), "block")
        leaves, order = nodes.join(many, F.col("grp").eqNullSafe(F.col("g")), "left_semi"), ("block",)


def roots(tiers: list[DataFrame]) -> DataFrame:
    """Root of each tree (grp, root): it ends in the tier that holds it in one segment."""
    ends = [t.groupBy("grp").agg(F.max("block").alias("last"), F.min(_last("log")).alias("root")).where("last = 0").drop("last") for t in tiers]
    return reduce(DataFrame.unionByName, ends)


def _prove(with_siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            labels, claims = row["labels"], row["claims"]
            segment = Segment(row["log"], len(labels), row["height"])
            rest = list(zip(row["lefts"] or [], row["rights"] or [], strict=True))
            leaves, proofs, folded, lefts, rights = [], [], [], [], []
            for k in range(len(labels)):
                path = [*segment.path(k), *rest]
                leaves.append(segment.run(0, k // FAN)[k % FAN])
                node = claims[HASH * k : HASH * (k + 1)].hex()
                for left, right in path:
                    node = digest((left + node + right).encode()).hex()
                folded.append(node)
                proofs.append(digest("".join(a + b for a, b in path).encode()).hex())
                if with_siblings:
                    lefts.append([a for a, _ in path])
                    rights.append([b for _, b in path])
            n = len(labels)
            cols = [pa.array([row["grp"]] * n, pa.string()), pa.array(labels, pa.string()), *(pa.array(c, pa.string()) for c in (leaves, proofs, folded))]
            if with_siblings:
                cols += [pa.array(c, pa.list_(pa.string())) for c in (lefts, rights)]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["grp", "label", "leaf", "proof_sha256", "folded", "lefts", "rights"]
    return run


def proofs(tiers: list[DataFrame], above: DataFrame | None = None, *, with_siblings: bool = False) -> DataFrame:
    """Proof of every leaf: grp, label, leaf, proof_sha256, folded, and with siblings lefts and rights (per level, hex).

    ``above`` continues the proofs of a whole tree (label names it): label, lefts, rights.
    """
    below = None
    for k in range(len(tiers) - 1, -1, -1):
        segments = tiers[k]
        for table, on, l, r in ((below, "block", "l1", "r1"), (above, None, "l2", "r2")):
            if table is None:
                segments = segments.withColumn(l, F.lit(None).cast("array<string>")).withColumn(r, F.lit(None).cast("array<string>"))
                continue
            up = table.select(F.col("grp").alias("_g"), F.col("label").alias("_b"), F.col("lefts").alias(l), F.col("rights").alias(r))
            same = F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block").cast("string") == F.col("_b")) if on else F.col("grp").eqNullSafe(F.col("_b"))
            segments = segments.join(up, same, "left").drop("_g", "_b")
        # the proof of a block's node in the next tier reaches up to the end already
        segments = segments.select("grp", "height", "labels", "claims", "log", F.coalesce("l1", "l2").alias("lefts"), F.coalesce("r1", "r2").alias("rights"))
        full = with_siblings or k > 0
        below = segments.mapInArrow(_prove(full), PROOF + SIBLINGS * full)
        if k > 0:
            below = stored(below, "proofs")
    return below


def row_digest(*cols: Column) -> Column:
    """Digest of a row's values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    def cell(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(cell, cols)), 256))


def merkle_manifest(docs: DataFrame, leaf: Column, claim: Column | None = None, *, id_col: str = ID, group: str = "source", with_siblings: bool = False, levels: int = HEIGHT) -> DataFrame:
    """Manifest of a table: doc_id, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` and ``claim`` are 32-byte digests of a row; its proof is tested with the claim (null: the
    leaf).  ``folded_root`` is the root recomputed from it and the siblings of the original, and
    ``verified`` whether it is the root.  With ``with_siblings`` also lefts and rights: per level from
    the leaf up, the hex digests left and right of the path.  ``levels``: height of a full segment.

    A null group is a group of its own and comes first; groups are ordered bytewise.  Within a group
    null ids come first and rows with equal ids are ordered by leaf and claim, so repeated rows each
    have a place.  Null and empty texts only differ in their leaf; long texts never leave the first
    step.  An empty table gives no rows.  Other columns are ignored.
    """
    nothing = F.lit(None).cast("binary")
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("string").alias("label"), leaf.alias("leaf"), (nothing if claim is None else claim).alias("claim"), F.col(id_col).cast("long").alias("number"))
    tiers = append_log(leaves, "number", "leaf", "claim", levels=levels)
    subroots = stored(roots(tiers), "subroots")
    top = append_log(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("label"), F.col("root").alias("leaf"), nothing.alias("claim")), "label", levels=levels)
    root = roots(top).select(F.lower(F.hex("root")).alias("root")).first()  # one row, of one digest
    out = proofs(tiers, proofs(top, with_siblings=True), with_siblings=with_siblings)
    out = out.join(subroots.select(F.col("grp").alias("_g"), F.lower(F.hex("root")).alias("subroot")), F.col("grp").eqNullSafe(F.col("_g")))
    return out.select(
        F.col("label").cast("long").alias("doc_id"), F.col("grp").alias("group"), "leaf", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), "proof_sha256",
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root["root"] if root else None)).alias("verified"), *(["lefts", "rights"] if with_siblings else []))

