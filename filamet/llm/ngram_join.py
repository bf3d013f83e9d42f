"""N-gram Jaccard join with several global token orders.

Two documents can only reach a Jaccard similarity t if they share a token among the first
``n - ceil(t n) + 1`` tokens of each, under *any* global token order.  Several orders are used; a
pair is verified only if it passes the prefix filter of every one.

Orders put rare tokens first.  The first one knows how many of the documents that may have a partner
hold a token.  For the others this is read from a sketch of fixed size: one row of counters per
order, each with its own hash, so the orders err on different tokens.  The counters of a large corpus
are full and tell only very frequent tokens apart; a first order by them lets tokens of a few
hundred documents into the prefixes, which grow clusters with the square of the corpus.

Steps, all in Spark:

1. Count the sketch.  Of tokens in the emptier cells, the same ones for all documents, see which have
   one document only.  A document with as many of its own as its prefix is long has no partner.
   The others' sets are stored; their tokens are counted and the rarest form the prefixes.
2. Tokens shared by up to SMALL documents give pairs with their number of shared prefix tokens.  As
   at most ``n - prefix`` tokens can be shared beyond the prefix, a pair needs a minimum of them;
   shared tokens that are too frequent to be paired count as shared until proven otherwise.
3. Frequent tokens tie their documents to the least one of the token: linear, never pairs.
4. What 2 and 3 leave forms candidate clusters.  Their shingle sets meet in units of bounded size,
   where the filters of all orders are intersected and the survivors verified.  A cluster above the
   unit size is first compared with its central document; then only documents without that link
   meet the blocks of the cluster.  Units return spanning forests of links, and these the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from filamet.llm.graph import components
from filamet.llm.shared import ID, TEXT, free_name, hash_words, id_filter, mix, passing, rows, shingles, signed, split_words, stored, summed_chunks, without

ORDERS = 3
COUNTERS = 1 << 18
CHUNK = 1 << 13
SALT_ROWS = 100_000
SMALL = 32
UNIT_DOCS = 512
UNIT_TOKENS = 2_000_000
#: share of all tokens that are looked up at least, for documents to have enough of their own
LOOKED_UP = 0.35


def _node(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit name of a shingle set."""
    value = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _cells(tokens: np.ndarray, order: int) -> np.ndarray:
    return (mix(tokens + np.uint64(order + 1)) >> np.uint64(46)).astype(np.int64)


def _sets(texts: list, width: int, lower: bool) -> Iterator[np.ndarray]:
    lists = [split_words(t, lower) for t in texts]
    hashed = hash_words([w for ws in lists for w in ws])
    at = 0
    for ws in lists:
        yield shingles(hashed[at : at + len(ws)], width)
        at += len(ws)


def _count(width: int, lower: bool):
    def run(batches):
        counts = np.zeros((ORDERS, COUNTERS), dtype=np.int64)
        for ids, texts in rows(batches, "id", "text"):
            sets = list(_sets(texts, width, lower))
            names = [_node(s) for s in sets]
            joined = np.concatenate(sets)
            for o in range(ORDERS):
                counts[o] += np.bincount(_cells(joined, o), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                 pa.array([b for _, b in names], pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())],
                ["id", "n", "k1", "k2", "chunk", "counts"])
        flat = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(flat.any(axis=1))
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(used, pa.int32()), pa.array([flat[i].astype("<u4").tobytes() for i in used], pa.binary())],
                ["id", "n", "k1", "k2", "chunk", "counts"])

    return run


def _ordered(tokens: np.ndarray, sketch: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by the order's counter, ties by a hash of the token; and the counters."""
    count = sketch[order][_cells(tokens, order)]
    by = np.lexsort((mix(tokens ^ np.uint64(order + 101)), count))
    return tokens[by], count[by]


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _looked_up(sketch, limit: int, width: int, lower: bool):
    """Tokens whose cell of the first order counts up to ``limit``, with the text's name."""

    def run(batches):
        counts = sketch.value[0]
        for (texts,) in rows(batches, "text"):
            token, k1 = [], []
            for s in _sets(texts, width, lower):
                some = s[counts[_cells(s, 0)] <= limit]
                token.append(some)
                k1.append(np.full(len(some), _node(s)[0], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(token))), pa.array(np.concatenate(k1))], ["token", "k1"])

    return run


def _tokens(sketch):
    """Tokens of each set with its name and size; salt is -1 for tokens that need none, the others have their counter."""

    def run(batches):
        counts = sketch.value[0]
        for k1, raw in rows(batches, "k1", "tokens"):
            sizes = np.array([len(b) // 8 for b in raw])
            s, name = np.frombuffer(b"".join(raw), dtype=np.uint64), np.repeat(np.array(k1, dtype=np.int64), sizes)
            often = counts[_cells(s, 0)]
            parts = 1 + often // SALT_ROWS
            salt = np.where(parts > 1, (name & 0xFFFFFFFF) % parts, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(s)), pa.array(salt), pa.array(np.where(parts > 1, often, 0)), pa.array(name), pa.array(np.repeat(sizes, sizes).astype(np.int32))],
                ["token", "salt", "often", "k1", "n"])

    return run


def _texts(width: int, lower: bool):
    """Shingle sets of the documents, kept if the text is the one the node was named after."""

    def run(batches):
        for k1, k2, texts in rows(batches, "k1", "k2", "text"):
            sets = list(_sets(texts, width, lower))
            keep = [i for i, s in enumerate(sets) if _node(s) == (k1[i], k2[i])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k1[i] for i in keep], pa.int64()), pa.array([k2[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                ["k1", "k2", "tokens"])

    return run


def _links(sketch, percent: int):
    """Links inside a unit that join what is not joined yet: a spanning forest of its similar pairs.

    With both sides 0 and 1 present, only pairs across the sides are looked at.  Pairs go through
    the prefix filter of every order; survivors are verified.
    """

    def run(key: tuple, data: pa.Table) -> pa.Table:
        counts = sketch.value
        sets = [np.frombuffer(b, dtype=np.uint64) for b in data.column("tokens").to_pylist()]
        side = np.array(data.column("side").to_pylist())
        m = len(sets)
        sizes = np.array([len(s) for s in sets])
        ends = [_prefix_length(n, percent) for n in sizes]
        postings = []
        for o in range(ORDERS):
            parts = [_ordered(s, counts, o)[0][:e] for s, e in zip(sets, ends, strict=True)]
            owner = np.repeat(np.arange(m), ends)
            tokens = np.concatenate(parts)
            by = np.argsort(tokens, kind="stable")
            postings.append((parts, tokens[by], owner[by]))
        root = np.arange(m)  # label of each document's tree
        found: list[tuple[int, int]] = []
        two = side.max() != side.min()
        for i in range(m):
            mask = root != root[i]
            mask[: i + 1] = False
            if two:
                mask &= side != side[i]
            mask &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            for parts, tokens, owner in postings:
                if not mask.any():
                    break
                lo, hi = np.searchsorted(tokens, parts[i], "left"), np.searchsorted(tokens, parts[i], "right")
                hit = np.zeros(m, dtype=bool)
                for a, b in zip(lo, hi, strict=True):
                    if b - a > 1:
                        hit[owner[a:b]] = True
                mask &= hit
            for j in np.flatnonzero(mask):
                if root[j] == root[i]:
                    continue
                short, long = (i, j) if sizes[i] < sizes[j] else (j, i)
                at = np.searchsorted(sets[long], sets[short])
                both = int(np.count_nonzero(sets[long][np.minimum(at, sizes[long] - 1)] == sets[short]))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        k1, k2 = data.column("k1").to_pylist(), data.column("k2").to_pylist()
        return pa.table({"a": pa.array([f"{k1[i]}:{k2[i]}" for i, _ in found], pa.string()), "b": pa.array([f"{k1[j]}:{k2[j]}" for _, j in found], pa.string())})

    return run


def _name():
    return F.concat_ws(":", F.col("k1").cast("string"), F.col("k2").cast("string"))


def _length(n, percent: int):
    """``_prefix_length`` of a column."""
    return n - F.ceil(n * percent / 100) + 1


def _open_names(docs: DataFrame, nodes: DataFrame, sketch, counters: np.ndarray, width: int, percent: int, lower: bool) -> DataFrame:
    """First halves of the names of the documents that may have a partner.

    Two documents with a link differ by less than a prefix of either, so one that has a prefix of tokens
    of its own is done.  Documents that share the first half of their name are never done.
    """
    sizes = np.sort(counters[0])
    limit = min(SALT_ROWS, int(sizes[np.searchsorted(np.cumsum(sizes), LOOKED_UP * sizes.sum())])) if sizes.any() else 0
    looked_up = docs.select("text").mapInArrow(_looked_up(sketch, limit, width, lower), "token long, k1 long")
    # copies of a text have one name
    single = looked_up.repartition("token").groupBy("token").agg(F.min("k1").alias("k1"), F.max("k1").alias("last")).where("k1 = last")
    own = single.groupBy("k1").agg(F.count(F.lit(1)).alias("own"))
    named = nodes.where("n > 0").groupBy("k1").agg(F.max("n").alias("n"), F.min("k2").alias("k2"), F.max("k2").alias("last"))
    return named.join(own, "k1", "left").where((F.coalesce("own", F.lit(0)) < _length(F.col("n"), percent)) | (F.col("k2") != F.col("last"))).select("k1")


def _rarest(tokens: DataFrame, percent: int) -> DataFrame:
    """Prefix tokens of the first order: by the number of sets that hold them, in which those of one set come first and are left out."""
    run = Window.partitionBy("token", "salt")
    met = tokens.repartition("token", "salt").withColumn("m", F.count(F.lit(1)).over(run)).where("m > 1 or salt >= 0")
    own = Window.partitionBy("k1")
    # should two sets share the first half of their name, both prefixes only get longer
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy(F.when(F.col("salt") < 0, F.col("m")).otherwise(F.col("often")), "token"))
    return met.withColumn("rank", rank).where(F.col("rank") <= _length(F.col("n"), percent)).select("token", "salt", "k1", "n")


def _candidates(prefix: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that hold every similar pair in one component, and (node, heavy) tokens per document.

    Documents go by the first half of their name here: should two share it, their clusters merge,
    which costs comparisons but no link.
    """
    run = Window.partitionBy("token", "salt")
    # copies of a text give equal rows: one stays, in the task that has the token anyway
    once = prefix.repartition("token", "salt").distinct()
    met = once.withColumn("m", F.count(F.lit(1)).over(run)).where("m > 1 or salt >= 0")
    met = stored(met.select("token", "salt", F.col("m").cast("int").alias("m"), F.col("k1").alias("node"), "n"), "ngram-tokens")
    rare = met.where(f"salt < 0 and m <= {SMALL}")
    heavy = met.where(f"salt >= 0 or m > {SMALL}")
    load = stored(heavy.groupBy("node").agg(F.count(F.lit(1)).alias("heavy")), "ngram-heavy")

    # at most SMALL documents per token here
    lists = rare.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("d")).where("size(d) > 1")
    fits = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    pairs = F.flatten(F.transform("d", lambda x, i: F.transform(F.filter(F.slice("d", i + 2, SMALL), lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))))
    counted = lists.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    ends = [load.select(F.col("node").alias(c), F.col("heavy").alias(f"h{c}")) for c in "ab"]
    known = counted.join(ends[0], "a", "left").join(ends[1], "b", "left")
    beyond = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent)) - F.greatest(beyond("na"), beyond("nb"))
    close = known.where(F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= needed).select("a", "b")

    # salted parts first, then their least documents: both steps are partial minima
    least = heavy.groupBy("token", "salt").agg(F.min("node").alias("b"))
    tied = heavy.select("token", "salt", F.col("node").alias("a")).join(least, ["token", "salt"]).where("a <> b").select("a", "b").distinct()
    heads = least.groupBy("token").agg(F.min("b").alias("first")).join(least, "token").where("b <> first").select(F.col("b").alias("a"), F.col("first").alias("b"))
    return close.unionByName(tied).unionByName(heads), load


def ngram_jaccard(docs: DataFrame, *, id_col: str = ID, text_col: str = TEXT, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity >= percent / 100.

    Returns one row per input row: doc_id, n_shingles, component_id (the least id reachable by
    links, the document's own included).  Words are runs of non-white-space (ASCII white space),
    A-Z lower-cased if ``lower``; a document with fewer words than ``width`` is one shingle.

    Null or empty texts have no shingles and no links: the component is their own id.  Rows with a
    null id keep it; they link like all others, and the component is the least id that is not null
    (null if there is none).  Repeated rows and ids give a row each; equal texts are one node, so a
    group of copies costs one row per copy, never pairs.  Other columns are ignored.
    """
    return _classes(docs, id_col, text_col, width, percent, lower).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, lower: bool = True) -> DataFrame:
    """The rows of ``ngram_jaccard`` with the name of the row's shingle set (k1, k2) and of its component (label)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = stored(docs.mapInArrow(_count(width, lower), "id long, n long, k1 long, k2 long, chunk int, counts binary"), "ngram-sketch")
    counters = summed_chunks(first.where("chunk is not null").select("chunk", "counts"), ORDERS * COUNTERS // CHUNK, CHUNK).reshape(ORDERS, COUNTERS)
    sketch = spark.sparkContext.broadcast(counters)

    nodes = first.where("chunk is null").select("id", "n", "k1", "k2")
    # one text per node
    member = nodes.where("n > 0").join(_open_names(docs, nodes, sketch, counters, width, percent, lower), "k1").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    member = stored(member.withColumn("node", _name()), "ngram-members")
    some = passing(docs, "id", id_filter(member.select("id")))
    known = member.where("id is not null").join(some, "id").select("k1", "k2", "text")
    unnamed = member.where("id is null").join(docs.where("id is null").mapInArrow(_name_texts(width, lower), "k1 long, k2 long, text string"), ["k1", "k2"]).select("k1", "k2", "text")
    sets = known.unionByName(unnamed).mapInArrow(_texts(width, lower), "k1 long, k2 long, tokens binary").dropDuplicates(["k1", "k2"])
    sets = stored(sets.withColumn("node", _name()), "ngram-sets")
    prefix = _rarest(sets.select("k1", "tokens").mapInArrow(_tokens(sketch), "token long, salt int, often long, k1 long, n int"), percent)
    edges, load = _candidates(prefix, percent)
    clusters = components(edges)

    member = stored(member.join(clusters.withColumnRenamed("node", "k1"), "k1"), "ngram-clusters")
    size = member.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))
    size = stored(size.select("label", F.greatest(F.ceil(F.col("docs") / UNIT_DOCS), F.ceil(F.col("tokens") / UNIT_TOKENS)).cast("int").alias("blocks")), "ngram-sizes")
    placed = sets.join(member.join(size, "label").select("node", "label", "blocks"), "node").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    small = placed.where("blocks = 1").select(F.col("label").cast("string").alias("unit"), F.lit(0).alias("side"), "k1", "k2", "tokens")
    big = placed.where("blocks > 1")
    # the document with the most frequent tokens is central: it has the fewest of its own
    lead = member.join(size.where("blocks > 1"), "label").join(load.withColumnRenamed("node", "k1"), "k1", "left").groupBy("label", "blocks").agg(F.max(F.struct(F.coalesce("heavy", F.lit(0)).alias("heavy"), "node")).alias("l")).select("label", "blocks", F.col("l.node").alias("node"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    centre = lead.join(sets, "node").withColumn("j", every).select(F.concat_ws("/", "label", "j").alias("unit"), F.lit(0).alias("side"), "k1", "k2", "tokens")
    around = big.select(F.concat_ws("/", "label", "block").alias("unit"), F.lit(1).alias("side"), "k1", "k2", "tokens")
    find = lambda units: units.groupBy("unit").applyInArrow(_links(sketch, percent), "a string, b string")
    first_links = stored(find(small.unionByName(centre).unionByName(around)), "ngram-links")
    tied = first_links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    loose = big.join(tied, "node", "left_anti")
    groups = loose.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / UNIT_DOCS).cast("int").alias("rest"))
    loose = loose.join(groups, "label").withColumn("part", F.expr("cast(pmod(xxhash64(node, 1), rest) as int)"))
    one = loose.withColumn("j", every).select(F.concat_ws("/", "label", "part", "j").alias("unit"), F.lit(0).alias("side"), "k1", "k2", "tokens")
    two = big.join(groups, "label").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).select(F.concat_ws("/", "label", "j", "block").alias("unit"), F.lit(1).alias("side"), "k1", "k2", "tokens")
    links = first_links.unionByName(find(one.unionByName(two)))
    linked = components(links)

    named = nodes.withColumn("node", _name())
    label = named.join(linked, "node").groupBy("label").agg(F.min("id").alias("component_id"))
    per_node = linked.join(label, "label", "left").select("node", "label", "component_id")
    own = named.where("n > 0").groupBy("node").agg(F.min("id").alias("_own"))
    out = named.join(own, "node", "left").join(per_node, "node", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") > 0, F.col("_own")), "id").alias("component_id"),
        "k1", "k2", F.coalesce("label", "node").alias("label"))


def _name_texts(width: int, lower: bool):
    def run(batches):
        for (texts,) in rows(batches, "text"):
            names = [_node(s) for s in _sets(texts, width, lower)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(texts, pa.string())], ["k1", "k2", "text"])

    return run


def prefix_bound(n: int, percent: int = 80) -> int:
    """Prefix length used for a set of n tokens (for tests)."""
    return _prefix_length(n, percent)


def required_overlap(n: int, m: int, percent: int = 80) -> int:
    """Least overlap of sets of n and m tokens that reaches the similarity."""
    return math.ceil(percent * (n + m) / (100 + percent))


def _with_names(at: int, width: int, lower: bool):
    """Adds the name (k1, k2) of each row's shingle set; column ``at`` is the text."""

    def run(batches):
        for batch in batches:
            names = [_node(s) for s in _sets(batch.column(at).to_pylist(), width, lower)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64())], [*batch.schema.names, "k1", "k2"])

    return run


def drop_similar(docs: DataFrame, *, id_col: str = ID, text_col: str = TEXT, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, with one document left of each component: the one with the least id.

    A document is an id with a set of shingles, so rows that repeat both count as one, while another
    text under the same id is judged by itself.  Of a component without any id one row stays.  Rows
    with an empty or null text are similar to nothing and stay, repeated ones with one id as one row.
    """
    found = stored(_classes(docs, id_col, text_col, width, percent), "ngram-components")
    found = found.withColumn("doc_id", F.col("doc_id").cast("long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    keeper = found.where("n_shingles > 0").groupBy("label").agg(F.min(order).alias("_k")).select(F.col("_k.doc_id").alias("i"), F.col("_k.k1").alias("a"), F.col("_k.k2").alias("b"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    judged = found.join(keeper.withColumn("first", F.lit(True)), same, "left").withColumn("stays", F.coalesce("first", F.lit(False)) | (F.col("n_shingles") == 0))
    each = stored(judged.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays"), F.max("n_shingles").alias("n")), "ngram-judged")

    # an id with one row is judged by the id alone
    ids = each.where("doc_id is not null").groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.max("stays").alias("stays"))
    left = without(docs, [F.col(id_col).cast("long")], ids.where("rows = 1 and not stays").select("doc_id"))
    unclear = stored(ids.where("rows > 1").select("doc_id"), "repeated-ids")
    if unclear.isEmpty() and each.where("doc_id is null").isEmpty():
        return left
    key = free_name(left, "_key")
    keyed = left.withColumn(key, F.col(id_col).cast("long"))
    listed = passing(keyed.where(F.col(key).isNotNull()), key, id_filter(unclear))
    clear = passing(keyed.where(F.col(key).isNotNull()), key, id_filter(unclear), inverse=True)
    some = listed.join(unclear.withColumnRenamed("doc_id", key), key, "left_semi").select(keyed.columns).unionByName(keyed.where(F.col(key).isNull()))
    rest = clear.unionByName(listed.join(unclear.withColumnRenamed("doc_id", key), key, "left_anti").select(keyed.columns))
    # the others get the name of their set, and are judged by both
    columns = [f"c{i}" for i in range(len(some.columns))]
    plain = some.toDF(*columns)
    schema = StructType([*plain.schema.fields, StructField("k1", LongType()), StructField("k2", LongType())])
    named = plain.mapInArrow(_with_names(some.columns.index(text_col), width, True), schema)
    mine = columns[some.columns.index(key)]
    verdicts = each.select(F.col("doc_id").alias("_i"), F.col("k1").alias("_a"), F.col("k2").alias("_b"), "stays", "n").where("stays")
    kept = named.join(verdicts, F.col(mine).eqNullSafe(F.col("_i")) & (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")))
    whole = F.col(mine).isNull() & (F.col("n") == 0)
    once = kept.where(~whole).dropDuplicates([mine, "k1", "k2"]).select(columns).unionByName(kept.where(whole).select(columns))
    return rest.unionByName(once.toDF(*some.columns)).drop(key)
