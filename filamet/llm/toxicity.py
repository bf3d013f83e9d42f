"""Toxic passages by maximum-scoring segment search.

Every token has a log-odds score between toxic and clean training text, smoothed by an informative
Dirichlet prior (the token's share of all training text); inflected forms that training has not seen
fall back on the score of their first five bytes.  A linear scan finds all maximal scoring segments
of a text.  Their scores are calibrated as extreme values: lambda from the score distribution of
clean text, K from the maxima of clean training texts; the evidence of a text is the sum of
``lambda * score - ln(K * length)`` over its significant passages.  A logistic curve, fitted on the
training texts, turns evidence into a score between 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ID, TEXT, free_name, id_filter, passing, stored

SAMPLE_ROWS = 60_000  # labelled rows that the model is fitted on, about
LEXICON = 20_000  # tokens with a score of their own
PRIOR = 0.01  # weight of the prior, as a share of the training tokens
LEAST_G2 = 30.0  # log-likelihood ratio that a token needs; millions of tokens are tested
DRIFT = -0.25  # the most a token without a score of its own may have
STEM = 5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case runs of letters (ASCII letters and everything beyond ASCII)."""
    return [] if not text else text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Model:
    """Scores of tokens and stems, and the calibration.  Its size is bounded by ``LEXICON``."""

    words: dict[bytes, float]
    stems: dict[bytes, float]
    other: float
    lam: float
    log_k: float
    intercept: float
    slope: float

    def scores(self, words: list[bytes]) -> np.ndarray:
        own = np.fromiter(map(self.words.get, words, repeat(math.nan)), dtype=np.float64, count=len(words))
        stem = np.fromiter(map(self.stems.get, [w[:STEM] for w in words], repeat(self.other)), dtype=np.float64, count=len(words))
        return np.where(np.isnan(own), stem, own)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Token count and all maximal scoring segments (first token, end token, score)."""
        words = tokens(text)
        return len(words), maximal_segments(self.scores(words))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Summed excess over what chance gives a text of n tokens, and the number of such passages."""
        floor = self.log_k + math.log(n) if n else 0.0
        over = [self.lam * s - floor for _, _, s in segments if self.lam * s > floor]
        return sum(over), len(over)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, self.intercept + self.slope * min(evidence, 60.0)))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, left to right, in linear time.

    Work is done per positive token; the tokens in between only enter through running sums.  The
    stack keeps (left sum, right sum, first, end) of segments that may still be joined.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []
    for i in positive.tolist():
        part = [sums[i], sums[i + 1], i, i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= part[0]:
                j -= 1
            if j < 0 or stack[j][1] >= part[1]:
                stack.append(part)
                break
            part = [stack[j][0], part[1], stack[j][2], part[3]]
            del stack[j:]
    return [(a, b, float(right - left)) for left, right, a, b in stack]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, y) of labelled rows with crc32(id) mod 5 <> 0; above ``sample_rows`` a hash sample of about so many."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = stored(known.where(~held_out(F.col("id"))), "labels")
    n = known.count()
    if n > sample_rows:
        known = known.where(F.expr(f"pmod(xxhash64(id), {1 << 30})") < int((1 << 30) * sample_rows / n))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return passing(texts, "id", id_filter(known.select("id"))).join(known, "id").select("id", "text", "y")


def held_out(ident: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(batches):
    """Token and stem counts by label, once per token and document."""
    import pyarrow as pa

    for batch in batches:
        seen: dict[bytes, list[int]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(tokens(text))
            for w in words:
                seen.setdefault(b"w" + w, [0, 0])[y] += 1
            for s in {w[:STEM] for w in words}:
                seen.setdefault(b"s" + s, [0, 0])[y] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["token", "clean", "toxic"])


def _log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> tuple[Column, Column]:
    """Smoothed log-odds of a token, and the log-likelihood ratio (G2) against equal shares."""
    n = n_toxic + n_clean
    prior = F.lit(PRIOR) * (toxic + clean)
    a, b = toxic + prior, clean + prior
    odds = F.log(a / (F.lit(n_toxic + PRIOR * n) - a)) - F.log(b / (F.lit(n_clean + PRIOR * n) - b))
    part = lambda k, m: F.when(k > 0, k * F.log(k * n / ((toxic + clean) * m))).otherwise(0.0)
    return odds, 2 * (part(toxic, n_toxic) + part(clean, n_clean))


def fit(train: DataFrame) -> Model:
    """Lexicon in Spark; calibration from one row per training document (a bounded sample)."""
    train = stored(train, "toxic-train")
    counts = stored(train.where("text is not null").select("text", "y").mapInArrow(_counts, "token binary, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-counts")
    kind = F.substring("token", 1, 1) == F.lit(b"s")
    mass = {r["k"]: (float(r["t"] or 0), float(r["c"] or 0)) for r in counts.groupBy(kind.alias("k")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    words, stems = {}, {}
    n_toxic, n_clean = mass.get(False, (0.0, 0.0))
    listed = [0.0, 0.0]
    if n_toxic and n_clean:
        for stem, into in ((False, words), (True, stems)):
            odds, g2 = _log_odds(F.col("toxic"), F.col("clean"), *mass[stem])
            table = counts.where(kind == F.lit(stem)).select("token", "toxic", "clean", odds.alias("d"), g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
            for r in table.orderBy(F.col("g2").desc(), "token").limit(LEXICON // 2).collect():
                into[bytes(r["token"])[1:]] = r["d"]
                if not stem:
                    listed[0] += r["toxic"]
                    listed[1] += r["clean"]
    rest = (math.log((n_toxic - listed[0] + 1) / (n_toxic + 2)) - math.log((n_clean - listed[1] + 1) / (n_clean + 2))) if n_toxic and n_clean else DRIFT
    other = min(DRIFT, rest)
    start = Model(words, stems, other, 1.0, 0.0, -4.0, 1.0)
    if not words and not stems:
        return start
    shipped = train.sparkSession.sparkContext.broadcast(start)

    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [shipped.value.passages(t) for t in texts]
            yield pd.DataFrame({"n": [n for n, _ in found], "segments": [[s for _, _, s in seg] for _, seg in found], "positive": [int(np.count_nonzero(shipped.value.scores(tokens(t)) > 0)) for t in texts]})

    seen = train.select("y", F.pandas_udf(measure, "n long, segments array<double>, positive long")("text").alias("m")).select("y", "m.*").collect()  # about SAMPLE_ROWS rows
    y = np.array([r["y"] for r in seen], dtype=float)
    n = np.array([max(1, r["n"]) for r in seen], dtype=float)
    # lambda: E exp(lambda * score) = 1 over tokens of clean text
    share = sum(r["positive"] for r, t in zip(seen, y, strict=True) if not t) / max(1.0, n[y == 0].sum())
    gain = float(np.median([v for v in [*words.values(), *stems.values()] if v > 0] or [1.0]))
    lam = _solve_lambda(max(share, 1e-7), gain, other)
    top = np.array([max(r["segments"], default=0.0) for r in seen])
    clean = (y == 0) & (top > 0)
    # K: the mean of a Gumbel maximum is ln(K n) + Euler's constant
    log_k = float(np.mean(lam * top[clean] - np.log(n[clean]))) - 0.5772 if clean.sum() >= 20 else -float(np.log(n).mean()) + lam * gain / 4
    log_k = min(log_k, lam * gain / 2 - float(np.log(n).mean()))  # a single strong token must stand out
    half = Model(words, stems, other, lam, log_k, 0.0, 1.0)
    x = np.array([min(60.0, half.evidence(int(m), [(0, 0, s) for s in r["segments"]])[0]) for m, r in zip(n, seen, strict=True)])
    intercept, slope = _logistic(x, y)
    return Model(words, stems, other, lam, log_k, intercept, slope)


def _solve_lambda(p: float, gain: float, other: float) -> float:
    lo, hi = 1e-6, 200.0 / max(gain, 1e-6)
    for _ in range(200):
        mid = (lo + hi) / 2
        if p * math.exp(min(700.0, mid * gain)) + (1 - p) * math.exp(mid * other) < 1:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton steps on a ridge-penalised logistic curve."""
    design = np.column_stack((np.ones_like(x), x))
    w = np.array([math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def judge(text: Column, model) -> Column:
    """Struct (score, evidence, n_passages, passages) of a text column; ``model`` is a broadcast Model."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        for texts in parts:
            out = []
            for t in texts:
                n, segments = m.passages(t)
                evidence, count = m.evidence(n, segments)
                floor = m.log_k + math.log(n) if n else 0.0
                out.append((m.probability(evidence), evidence, count, [{"first": a, "end": b, "score": s} for a, b, s in segments if m.lam * s > floor]))
            yield pd.DataFrame(out, columns=["score", "evidence", "n_passages", "passages"])

    return F.pandas_udf(run, "score double, evidence double, n_passages int, passages array<struct<first:int,end:int,score:double>>")(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = ID, text_col: str = TEXT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every text: doc_id, held_out, score, predicted, n_passages, passages (token spans).

    Only labelled rows whose crc32(id) mod 5 is not 0 are learnt from.  Null and empty texts have no
    passage and get the score of no evidence.  Null ids are scored like all others and are not held
    out.  Repeated rows give a row each; a label given twice counts as toxic if one of them does.
    Without labels of both kinds every score is that of no evidence.  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, id_col, text_col, sample_rows=sample_rows)))
    out = docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col), model).alias("j"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("j.score").alias("score"), (F.col("j.score") >= 0.5).cast("int").alias("predicted"), "j.n_passages", "j.passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """Rows of ``docs``, all columns, whose text is not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, id_col, text_col)))
    flag = free_name(docs, "_toxicity")
    return docs.withColumn(flag, judge(F.col(text_col), model)["score"]).where(F.col(flag) < 0.5).drop(flag)
