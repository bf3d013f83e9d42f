"""Corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents
go, sources are mixed to target weights, and what is left is written as a token file.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder as Parquet and reads it again as the next stage's ``docs``.  All stages but the last return
the columns of ``docs``.

Rows with null texts pass the first three stages (they hold nothing that could be rejected) and are
left out by the mixing stage if their leaf has no words at all; the last stage writes them as empty
documents.  Repeated rows are near copies of each other: one stays.  Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from filamet.llm.decontaminate import drop_contaminated
from filamet.llm.mixing import mix_sources
from filamet.llm.ngram_join import drop_similar
from filamet.llm.queries import token_digest
from filamet.llm.shared import delete_tables, noted, prepare, stored, table
from filamet.llm.toxicity import drop_toxic

MIX_SHARE = 0.95
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_tables: list[str] = []  # stored by the stages before, whose output is written by now


def stage(fn: Stage) -> Stage:
    """A stage reads the written output of the one before, so what that one stored on the way can go."""

    @wraps(fn)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        delete_tables(spark, _tables, docs)
        with noted() as paths:
            out = fn(spark, docs, sf_dir)
        _tables[:] = paths
        return out

    return call


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal targets for domains, languages and sources; what scarce ones lack, the others give."""
    return mix_sources(docs, share=MIX_SHARE, max_epochs=1).select("row.*")


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digest(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_binary", token_stage),
]

# scoring, sketches and tokenizers are not SQL: tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stored(apply(spark, docs, sf_dir), name)
    return docs
