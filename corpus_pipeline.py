"""Corpus pipeline: from documents to token ids, one written table per stage.

Every stage works on all rows its predecessor kept.  Rows with null or empty
texts pass all stages (empty texts have no near copies and no ids).  Rows
without a doc_id are scored, compared, searched, redacted and encoded like
others; the near-copy stage takes them after rows with one.  Extra columns pass through the filtering stages.  An empty table stays
empty.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.fixtures import table
from gridweave.llm import bpe, decontaminate, jaccard_join, secret_scan, toxicity
from gridweave.llm.queries import TOXIC, toxicity_model
from gridweave.session import cut, ship

#: Near copies: five words and a similarity of eight tenths.
NEAR = jaccard_join.Rule(5, 8, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    name = _fresh(docs, "_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).select(*docs.columns)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one of the least id, rows without an id last; of equal ids any one.

    Rows are told apart by a written row number, so repeated and missing ids
    decide like others.
    """
    row, text, doc_id = _fresh(docs, "_row"), "text", "doc_id"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_join.link_components(numbered, NEAR, row, text).select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    named = found.join(numbered.select(F.col(row).alias("r"), F.col(doc_id).alias("i")), "r")
    first = named.groupBy("c").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "r")).alias("m"))
    gone = cut(named.join(first, "c").where(F.col("r") != F.col("m.r")).select("r"))
    some = F.broadcast(gone) if gone.count() <= jaccard_join.BROADCAST_NEED else gone
    return numbered.join(some, F.col(row) == F.col("r"), "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    key, name = F.xxhash64("doc_id", "text"), _fresh(docs, "_key")  # rows that share an id are told apart by their text
    held = decontaminate.passages(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(cut(held), key == F.col(name), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by their kind, ``n_chars`` to match."""
    whole = F.coalesce("text", F.lit(""))
    found = secret_scan.scan(docs)
    clean = found.withColumn("text", F.when(F.size("found") > 0, secret_scan.redacted(whole, F.col("found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; the round trip is kept as a flag."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _shipped(stage):
    """The stage, with this package on the executors before it runs."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scan", redact_secrets), ("bpe", encode))]
#: The classifier and the tokenizer have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
