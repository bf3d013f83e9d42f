"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.  DataFrame functions only.

Unigrams and bigrams of words are hashed into BUCKETS buckets.  Two multinomials over the buckets are
counted: the trusted target (labelled rows of good quality) and the raw corpus (all rows).  A text's
verdict is the mean, over its n-grams, of the log ratio of the smoothed bucket probabilities; it is
kept if that mean is at least ``threshold``.

The counts are partial sums of at most BUCKETS rows per task; the table of ratios has at most BUCKETS
rows whatever the input, so it is broadcast.  Ratios are whole millionths: sums do not depend on the
order of addition, and the verdict is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, SPACE, TEXT, let, stored

BUCKETS = 1 << 16
SMOOTHING = 1.0
MILLION = 1_000_000
THRESHOLD = -0.18
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WIDTH = 8


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def ngram_buckets(text: Column) -> Column:
    """Buckets of all unigrams and bigrams of a text."""
    return let(_hashes(words(text)), _buckets)


def _buckets(hashes: Column) -> Column:
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def repeated_words(hashes: Column, width: int = REPEAT_WIDTH) -> Column:
    """Words that lie in a ``width``-word window found twice or more in the text."""

    def count(starts: Column) -> Column:
        # starts: (window hash, position) in order of the hash; equal neighbours are repeats
        hit = F.filter(starts, lambda x, i: (F.get(starts, i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(starts, i + 1)["h"].eqNullSafe(x["h"]))
        place = F.array_sort(F.transform(hit, lambda x: x["p"]))
        return let(place, lambda p: F.aggregate(F.transform(p, lambda v, i: F.coalesce(F.least(F.get(p, i + 1) - v, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b))

    def look(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, count))

    n = F.size(hashes)
    made = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    return F.when(n > width, let(made, look)).otherwise(F.lit(0)).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """Counts that need the text alone (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.char_length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT, label: str = "quality") -> DataFrame:
    """(bucket, ratio): log(target / raw) of every bucket in millionths; 0 if nothing is labelled good."""
    good = labels.where((F.col(label) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().withColumn("_good", F.lit(1))
    # a merge join at every size: what is shuffled then grows as the input does
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(good.hint("merge"), "_id", "left")
    grams = rows.select("_good", F.explode(ngram_buckets(F.col("_text"))).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.count("_good").alias("t"), F.count(F.lit(1)).alias("r")), "ngram-counts")
    n = counts.agg(F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    p = lambda k, m: (k + SMOOTHING) / F.lit(float((m or 0) + SMOOTHING * BUCKETS))
    ratio = F.log(p(F.col("t"), n["t"]) / p(F.col("r"), n["r"])) if n["t"] else F.lit(0.0)
    return stored(counts.select("bucket", F.round(ratio * MILLION).cast("long").alias("ratio")), "ngram-ratios")


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = ID, text_col: str = TEXT, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts and verdict of every text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr,
    kept.  ``base_failed``: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT of the words
    repeat.  ``kept`` is false if the base rules fail, else whether the length-normalised ratio
    ``llr`` reaches the threshold (fixed, so the verdict of a text depends on the counts only).

    Null and empty texts have no words and fail.  Null ids keep their row and are never labelled.
    Repeated rows give a row each and count each time; labels given twice count once.  Without a
    good label all ratios are 0.  Other columns are ignored.
    """
    # BUCKETS rows at most, whatever the input
    table = F.broadcast(ratios(docs, labels, id_col, text_col))
    text = F.col(text_col)
    # adding 0 * partition id makes the keys count as non-deterministic, so they are worked out once
    # per text; otherwise they would be hashed anew for every n-gram of the text
    once = F.spark_partition_id() * 0
    key = ((F.xxhash64(text) + once).alias("k1"), (F.xxhash64(F.lit(1), text) + once).alias("k2"))
    # the mean of equal texts is that of one, so the text itself names the group
    grams = docs.select(*key, text.alias("t")).select("k1", "k2", F.explode(ngram_buckets(F.col("t"))).alias("bucket"))
    mean = grams.join(table, "bucket").groupBy("k1", "k2").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("grams"))
    base = docs.select(F.col(id_col).alias("doc_id"), *key, _hashes(words(text)).alias("h"), *[c.alias(n) for n, c in base_counts(text).items()])
    base = base.select("doc_id", "k1", "k2", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("h")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = base.join(mean, ["k1", "k2"], "left").withColumn("llr", F.coalesce(F.col("sum") / F.col("grams") / MILLION, F.lit(0.0))).withColumn("base_failed", failed)
    kept = ~failed & (F.coalesce("sum", F.lit(0)) >= F.ceil(F.coalesce("grams", F.lit(0)) * (threshold * MILLION)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", kept.alias("kept"))
