"""Registered queries of the corpus operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamet.llm import sql
from filamet.llm.decontaminate import contained_items
from filamet.llm.license_scan import license_scan
from filamet.llm.merkle import merkle_manifest, row_digest
from filamet.llm.mixing import mix_sources
from filamet.llm.ngram_join import ngram_jaccard
from filamet.llm.periodic_runs import periodic_runs
from filamet.llm.piece_counts import token_counts
from filamet.llm.piece_encoding import decode_pieces, encode_pieces
from filamet.llm.quality import quality
from filamet.llm.shared import SPACE, ascii_lower, let, prepare, table
from filamet.llm.substring_dedup import substring_dedup
from filamet.llm.token_file import read_documents, write_tokens
from filamet.llm.toxicity import toxicity
from filamet.llm.url_filter import url_filter
from filamet.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = wraps(fn)(lambda spark, sf_dir: (prepare(spark), fn(spark, sf_dir))[1])
        if text:
            SQL[name] = text
        return fn

    return add


@query("op3_ngram_jaccard", sql.NGRAM_JACCARD)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup", sql.SUBSTRING_DEDUP)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_passages")


@query("op4_decontaminate", sql.DECONTAMINATE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_token_binary")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"))


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token file of the documents and describe them from it."""
    out = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    width = write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, out, width)


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op6_url_filter", sql.URL_FILTER)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the number of the document they show in their path; that document's quality labels them."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("good"))
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, labels, RULES, label_key=F.when(number != "", number)).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


MIX_WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1}


@query("op10_mixing", sql.MIXING)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS, share=0.5, max_epochs=2)
    return out.select("row.doc_id", "domain", "lang", "source", "epoch", "n_tokens")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", sql.MERKLE_MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a checksum divisible by 5 are tested with a tampered text."""
    docs = table(spark, sf_dir, "documents")
    leaf = [row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text) for text in (F.col("text"), ascii_lower(F.col("text")))]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf[1])
    return merkle_manifest(docs, leaf[0], claim).drop("group")


@query("op12_piece_encoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document (by the checksum of its id) repeats its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)), " ")

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    text = let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


@query("op13_periodic_runs", sql.PERIODIC_RUNS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # length / period compared as whole fractions: a greater one first, then the smaller start and period
    def before(a, b):
        return (F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1))
                .when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(F.when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0)))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
