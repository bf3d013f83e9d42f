"""Mixing sources to target weights by hierarchical budgets.  DataFrame functions only.

Sources form a tree, by default domain - language - source.  The token budget is handed down: a node
gives each child a share by weight, but no more than the child's subtree can supply (its tokens times
the allowed epochs).  What a child cannot take goes to its siblings by weight; only what a whole
subtree cannot take is left to the siblings of its ancestors.  A leaf takes a prefix of its token
stream: whole epochs first, then the documents of the last epoch in an order seeded by epoch.

Prefixes are cut without sorting a leaf: the order key is a digest, its leading digits make buckets,
and only the bucket in which the budget ends is looked into, twice; what is left to sort is a
16-millionth of the leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamet.llm.quality import words
from filamet.llm.shared import ID, TEXT, stored

NONE = "(none)"
DIGITS = 3  # hex digits per bucket level: 4096 buckets


def domain_of(source: Column) -> Column:
    """The documents name no domain; sources are dealt to four of them by their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("decimal(38,0)"), F.lit(4)).cast("int").cast("string")))


def _weight(path: Sequence[Column], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of a node among its siblings: the entry for its whole path, else for its own name, else 1."""
    out = F.lit(1)
    for names, w in sorted(weights.items(), key=lambda kv: (len(kv[0]), kv[0])):
        if len(names) == len(path):
            fit = F.lit(True)
            for c, n in zip(path, names, strict=True):
                if n != "*":
                    fit = fit & (c == n)
            out = F.when(fit, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Split ``budget`` of each parent over its children: (…, weight, capacity, budget) -> child's ``budget``.

    Children are filled in order of capacity per weight; whole tokens, rounded down.
    """
    # capacity / weight in ascending order; names break ties
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("capacity") * F.col("_rest") <= F.col("_left") * F.col("weight")
    out = nodes.withColumn("_left", left).withColumn("_rest", rest).withColumn("_full", full)
    # the first child that is not full fixes the level for itself and all after it
    after = F.struct("_left", "_rest")
    level = F.min(F.when(~F.col("_full"), F.struct((F.col("capacity") / F.col("weight")).alias("r"), F.col("name").alias("n"), after.alias("at")))).over(Window.partitionBy(*parent))
    out = out.withColumn("_level", level)
    part = F.expr("(_level.at._left * weight) div _level.at._rest")
    return out.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", F.greatest(part, F.lit(0)))).cast("long")).drop("_left", "_rest", "_full", "_level")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: int, max_epochs: int) -> DataFrame:
    """(levels…, tokens, budget) of every leaf."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    got = None
    for k in range(1, len(levels) + 1):
        own, parent = list(levels[:k]), list(levels[: k - 1])
        at = nodes.groupBy(*own).agg(F.sum("capacity").alias("capacity")).where("capacity > 0")
        at = at.withColumn("weight", _weight([F.col(c) for c in own], weights)).where("weight > 0").withColumn("name", F.col(own[-1]))
        at = at.withColumn("budget", F.lit(budget).cast("long")) if got is None else at.join(got, parent)
        got = stored(share_out(at, parent).select(*own, "budget"), "budgets")
    return leaves.join(got, list(levels))


def order_key(seed: int, epoch: Column, ident: Column, text_digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("")), text_digest).cast("binary"))


def _prefix_cut(rows: DataFrame, leaf: Sequence[str]) -> DataFrame:
    """(leaf…, cut): the largest order key taken; rows have key, tokens and the leaf's ``rest`` (> 0).

    A row is taken if the tokens before it are fewer than ``rest``.
    """
    leaf = list(leaf)
    part = rows.withColumn("before", F.lit(0).cast("long"))
    for level in range(2):
        digits = F.substring("key", level * DIGITS + 1, DIGITS)
        sums = part.withColumn("b", digits).groupBy(*leaf, "b").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = Window.partitionBy(*leaf).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("at", F.col("before") + F.coalesce(F.sum("t").over(run), F.lit(0)))
        # the last bucket that starts before the budget ends
        edge = sums.where("at < rest").groupBy(*leaf).agg(F.max(F.struct("b", "at")).alias("e")).select(*leaf, F.col("e.b").alias("b"), F.col("e.at").alias("before"))
        part = part.withColumn("b", digits).drop("before").join(edge, [*leaf, "b"]).drop("b")
    run = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = part.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    return inside.where("at < rest").groupBy(*leaf).agg(F.max("key").alias("cut"))


def mix_sources(
    docs: DataFrame, *, weights: Mapping[tuple[str, ...], int] | None = None, share: float = 0.5, budget: int | None = None, max_epochs: int = 2, seed: int = 17,
    id_col: str = ID, text_col: str = TEXT, levels: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows of ``docs`` picked to the target weights, as ``row`` (all columns), the levels, epoch and n_tokens.

    ``weights`` maps paths of the tree, such as ``("domain1", "en")`` or ``("*", "en")``, to whole
    numbers (1 where nothing is said, 0 leaves a node out).  The budget counts words; without
    ``budget`` it is ``share`` of all words.  A document is taken whole; the last one of a leaf may
    exceed the leaf's budget by less than its own length.

    Null level values form the node ``(none)``.  Null and empty texts have no tokens; they are taken
    with the epochs that are taken whole and where their place lies before the budget's end.  Null
    ids are ordered by text alone.  Equal rows share their order key and are taken together.  An
    empty table gives no rows.  Columns may have any name: they stay inside ``row``.
    """
    levels = levels or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    names = list(levels)
    text = F.col(text_col)
    shown = docs.select(F.struct("*").alias("row"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], F.col(id_col).alias("_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_md5"), F.size(words(text)).cast("long").alias("tokens"))
    slim = stored(shown.drop("row"), "mix-rows")
    leaves = stored(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    plan = leaf_budgets(leaves, names, weights or {}, budget, max_epochs)
    plan = stored(plan.select(*names, F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest")), "mix-plan")
    key = order_key(seed, F.col("whole"), F.col("_id"), F.col("_md5"))
    cuts = _prefix_cut(slim.join(plan.where("rest > 0"), names).select(*names, "rest", key.alias("key"), "tokens"), names)
    # a row per leaf: Spark broadcasts it where its size allows, else splits the hot leaves of the join
    final = stored(plan.join(cuts, names, "left"), "mix-cuts")
    picked = shown.join(final, names)
    last = F.when(F.col("cut").isNotNull() & (key <= F.col("cut")), F.col("whole") + 1).otherwise(F.col("whole"))
    return picked.withColumn("_times", last).where("_times > 0").select("row", *names, F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), F.col("tokens").alias("n_tokens"))
