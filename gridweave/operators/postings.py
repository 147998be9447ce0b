"""Pruned inverted index: postings written once, and a top-k that skips most of them.

The index is a Parquet table partitioned by ``bucket`` (a digest of the term)
and ordered by term.  A row is a *block*: up to some thousand postings of a term
with like impact, and the largest impact among them.  A term of few documents is
one block.  A long term has a layer per impact step, each cut by document digest
into blocks of bounded size, so no task ever gathers a whole hot term.

A search reads the buckets of its terms only.  It first scores what the best
blocks hold, which gives every query a floor: the score of its k-th best
document so far.  Terms whose bounds together stay below the floor are
*optional*: a document that has nothing else can't reach the top.  Only the
other terms make candidates, and only their blocks that can still reach the
floor are opened.  The rest of the survivors' scores comes from the documents'
own terms, a second table, or from the optional blocks, whichever is less to
read.  The result is exact.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.operators.lookup import lookup
from gridweave.operators.ranking import top_k
from gridweave.session import cut, scratch_path

K1, B, AVG_LEN = 1.2, 0.75, 200.0  # fixed values: scoring constants
#: Postings of a block of a long term, impact steps of such a term, postings per bucket.
BLOCK, STEPS, BUCKET = 1024, 8, 4_000_000
#: Parts that a bucket is dealt over, at least, and postings of a task that writes.
DEALS, TASK = 8, 1_000_000
#: Blocks of a query that are scored for its floor, and documents among them whose whole score is taken, per result.
SEEDS, CANDIDATES = 24, 2
#: Terms of a query up to which bounds are tried, and postings of a batch of queries that are simply summed up.
MOST_TERMS, PLAIN = 64, 50_000_000
#: Two orders of summation differ by less.
SLACK = 1e-5


class Index(NamedTuple):
    """A written index: folders of the blocks and of the documents' terms, bucket count and number of passages."""

    path: str
    forward: str
    buckets: int
    n_docs: int
    n_posts: int

    def blocks(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        table = spark.read.parquet(self.path)
        return table if buckets is None else table.where(F.col("bucket").isin(buckets))


def impact(tf: Column, dl: Column) -> Column:
    """Share of a term's weight that a posting earns; below ``K1 + 1``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / AVG_LEN))


def weight(df: Column, n_docs: int) -> Column:
    return F.log(1.0 + (F.lit(n_docs) - df + 0.5) / (df + 0.5))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(toks: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)`` of ``toks(doc_id, terms)``; rows with equal ids and lengths count together.

    A passage's terms are counted where they lie, so no token is shuffled.
    """
    toks = toks.where(F.size("terms") > 0)
    if not toks.groupBy("doc_id").count().where("count > 1").isEmpty():
        apart = toks.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        return apart.groupBy("doc_id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))

    def run(parts):
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            terms = batch.column(1)
            sizes = np.diff(terms.offsets.to_numpy())
            coded = terms.flatten().dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy()
            both, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(names) + codes, return_counts=True)
            row, code = np.divmod(both, len(names))
            for k in range(0, len(both), 50_000):
                here = row[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(here)), pa.array(sizes[here].astype(np.int32)),
                    names.take(pa.array(code[k:k + 50_000])), pa.array(tf[k:k + 50_000].astype(np.int32))], names=["doc_id", "dl", "term", "tf"])

    return toks.select("doc_id", "terms").mapInArrow(run, f"doc_id {toks.schema['doc_id'].dataType.simpleString()}, dl int, term string, tf int")


def write(passages: DataFrame, terms: Column, block: int = BLOCK) -> Index:
    """Index of ``passages(doc_id, ...)`` whose terms are the array ``terms``.

    Rows: ``bucket, term, df, top, n, postings ARRAY<STRUCT<doc_id, tf, dl>>``.
    """
    spark = passages.sparkSession
    forward = scratch_path(spark, "terms")
    passages.select("doc_id", terms.alias("terms")).write.parquet(forward)
    toks = spark.read.parquet(forward)
    tf = _counted(toks)
    counted = cut(toks.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("_df")))
    whole = counted.agg(F.sum("_df").alias("n"), F.max("_df").alias("most")).first()
    n_docs, n_posts = toks.count(), whole.n or 0
    buckets = max(16, math.ceil(n_posts / BUCKET))
    deals = max(DEALS, math.ceil((whole.most or 0) / BUCKET * DEALS))
    long = cut(counted.where(F.col("_df") > block))
    step = F.floor(impact(F.col("tf"), F.col("dl")) / (K1 + 1) * STEPS).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_df") / block)).cast("int")
    keyed = lookup(tf, long, ["term"]).select(
        "term", "doc_id", "tf", "dl", "_df", F.when(F.col("_df").isNotNull(), step).alias("_step"), F.when(F.col("_df").isNotNull(), part).alias("_part"))
    # Dealt once, by bucket, term and part: a bucket's hot terms are several tasks' work, and what a task groups it also writes.
    place = ["bucket", "_deal"]
    dealt = keyed.withColumns({"bucket": bucket_of(F.col("term"), buckets), "_deal": F.pmod(F.hash("term") + F.coalesce("_part", F.lit(0)), F.lit(deals)).cast("int")})
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n_posts / TASK))
    rows = dealt.repartition(tasks, *place).groupBy(*place, "term", "_step", "_part").agg(
        F.first("_df").alias("_df"), F.max(impact(F.col("tf"), F.col("dl"))).alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("postings"))
    rows = rows.select("bucket", "term", F.coalesce("_df", "n").alias("df"), "top", "n", "postings")
    path = scratch_path(spark, "postings")
    rows.sortWithinPartitions("bucket", "term", "top").write.partitionBy("bucket").parquet(path)
    return Index(path, forward, buckets, n_docs, n_posts)


def counts(index: Index, spark: SparkSession) -> DataFrame:
    """``(term, df, occurrences, dl_sum)`` of every term."""
    def total(c: str) -> Column:
        return F.aggregate("postings", F.lit(0).cast("bigint"), lambda a, p: a + p[c]).alias(c)

    per = index.blocks(spark).select("term", "df", total("tf"), total("dl"))
    return per.groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("occurrences"), F.sum("dl").alias("dl_sum"))


def _opened(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row per posting of ``rows(*by, w, postings)`` with what it adds to its document."""
    return rows.select(*by, "w", F.inline("postings")).select(*by, "doc_id", (F.col("w") * impact(F.col("tf"), F.col("dl"))).alias("s"))


def scored(pairs: DataFrame, weights: DataFrame, index: Index, by: list[str]) -> DataFrame:
    """Whole scores ``(*by, doc_id, s)`` of ``pairs(*by, doc_id)`` under ``weights(*by, term, w)``, from the documents' terms."""
    docs = pairs.sparkSession.read.parquet(index.forward)
    named = lookup(docs, pairs, ["doc_id"], "inner").select(*by, "doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    held = lookup(named, weights, [*by, "term"], "inner").groupBy(*by, "doc_id", "dl", "term", "w").agg(F.count("*").alias("tf"))
    return held.groupBy(*by, "doc_id").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"))).alias("s"))


def search(q: DataFrame, index: Index, k: int, by: list[str], plain: int = PLAIN) -> DataFrame:
    """Top ``k`` documents ``(*by, doc_id, score, rank)`` of ``q(*by, term, qtf)``; repeated terms count ``qtf`` times.

    The bounds of a query of more than ``MOST_TERMS`` terms add up to far more
    than any document earns, so nothing could be skipped: those queries open the
    blocks of their terms and sum up.  So do all, if their lists hold no more than
    ``plain`` postings together, which is less work than to find bounds.
    """
    spark = q.sparkSession
    q = cut(q.withColumn("bucket", bucket_of(F.col("term"), index.buckets)).join(q.groupBy(*by).agg(F.count("*").alias("_terms")), by))
    asked = [r.bucket for r in q.select("bucket").distinct().collect()]  # at most index.buckets numbers
    blocks = index.blocks(spark, asked)
    bounded = F.col("_terms") <= MOST_TERMS
    lists = blocks.groupBy("term").agg(F.sum("n").alias("_n"))
    size = q.where(bounded).join(lists, "term").agg(F.sum("_n").alias("bounded")).first().bounded or 0
    if size <= plain:
        found = [_whole_search(q.drop("_terms"), blocks, index, by)]
    else:
        found = [_whole_search(q.where(~bounded).drop("_terms"), blocks, index, by), _pruned_search(q.where(bounded).drop("_terms"), blocks, index, k, by)]
    return top_k(reduce(DataFrame.unionByName, found), by, [F.desc("score"), F.col("doc_id")], k)


def _whole_search(q: DataFrame, blocks: DataFrame, index: Index, by: list[str]) -> DataFrame:
    """Scores of all documents that hold a term of their query."""
    hits = blocks.drop("bucket").join(q, "term").withColumn("w", F.col("qtf") * weight(F.col("df"), index.n_docs))
    return _opened(hits, by).groupBy(*by, "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def _pruned_search(q: DataFrame, blocks: DataFrame, index: Index, k: int, by: list[str]) -> DataFrame:
    """Scores of the documents that can be among the top ``k``."""
    terms = q.select("term").distinct()
    # Sizes first: the block table without its postings.
    heads = cut(lookup(blocks.select("term", "df", "top", "n"), cut(terms), ["term"], "inner"))
    sized = lookup(q, cut(heads.groupBy("term").agg(F.first("df").alias("df"), F.max("top").alias("most"))), ["term"], "inner")
    sized = cut(sized.select(*by, "term", "qtf", (F.col("qtf") * weight(F.col("df"), index.n_docs)).alias("w"), "most"))

    # Floor: whole scores of documents that the best blocks name.
    best = top_k(heads.join(sized, "term").select(*by, "term", "w", "top", "n", (F.col("w") * F.col("top")).alias("up")), by,
                 [F.desc("up"), F.col("term"), F.col("n")], SEEDS).groupBy(*by, "term").agg(F.first("w").alias("w"), F.min("top").alias("least"))
    seeds = lookup(blocks, cut(best), ["term"], "inner").where(F.col("top") >= F.col("least"))
    some = _opened(seeds, by).groupBy(*by, "doc_id").agg(F.sum("s").alias("s"))
    named = cut(top_k(some, by, [F.desc("s"), F.col("doc_id")], CANDIDATES * k).select(*by, "doc_id"))
    weights = sized.select(*by, "term", "w")
    whole = scored(named, weights, index, by)
    floor = top_k(whole, by, [F.desc("s"), F.col("doc_id")], k).groupBy(*by).agg(F.min("s").alias("_s"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    floor = floor.select(*by, (F.col("_s") - SLACK).alias("floor"))

    # Optional terms: by falling bound from the end, as long as their sum stays below the floor.
    up = F.col("w") * F.col("most")
    order = W.partitionBy(*by).orderBy(up, "term")  # a row per term of a query
    parts = sized.join(floor, by, "left").withColumns({
        "rest": F.sum(up).over(W.partitionBy(*by)) - up, "under": F.sum(up).over(order)})
    parts = cut(parts.select(*by, "term", "w", F.coalesce("floor", F.lit(0.0)).alias("floor"), "rest", "under",
                             (F.col("under") < F.coalesce("floor", F.lit(0.0))).alias("optional")))
    slack = cut(parts.where("optional").groupBy(*by).agg(F.max("under").alias("slack")))

    # Candidates: documents of the other terms, from blocks that can reach the floor.
    need = lookup(blocks, parts.where("not optional"), ["term"], "inner").where(F.col("w") * F.col("top") + F.col("rest") >= F.col("floor"))
    first = _opened(need, by).groupBy(*by, "doc_id").agg(F.sum("s").alias("s"))
    alive = first.join(slack, by, "left").join(floor, by, "left").where(
        F.col("s") + F.coalesce("slack", F.lit(0.0)) >= F.coalesce("floor", F.lit(0.0))).select(*by, "doc_id", "s")
    alive = cut(alive)
    # The rest of their scores: from the documents' terms, or from the optional blocks where those hold less.
    volume = heads.join(parts.where("optional").select(*by, "term"), "term").groupBy(*by).agg(F.sum("n").alias("_v"))
    per_doc = max(1, index.n_posts // max(1, index.n_docs))
    few = cut(alive.groupBy(*by).agg(F.count("*").alias("_c")).join(volume, by, "left").select(
        *by, (F.coalesce("_v", F.lit(0)) > F.col("_c") * per_doc).alias("few")))
    alive = lookup(alive, few, by)
    one = scored(alive.where("few").select(*by, "doc_id"), weights, index, by)
    open_ = parts.where("optional").join(few.where("not few").select(*by), by, "left_semi")
    reach = lookup(blocks, open_, ["term"], "inner").where(F.col("w") * F.col("top") + F.col("rest") >= F.col("floor"))
    other = alive.where("not few").select(*by, "doc_id", "s", F.lit(True).alias("_alive")).unionByName(
        _opened(reach, by).withColumn("_alive", F.lit(None).cast("boolean"))).groupBy(*by, "doc_id").agg(
        F.sum("s").alias("s"), F.max("_alive").alias("_alive")).where("_alive").drop("_alive")
    return one.unionByName(other).select(*by, "doc_id", F.round("s", 6).alias("score"))
