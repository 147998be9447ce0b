"""BM25 for few queries of many terms: the documents' terms are read once, no index is written.

An index pays where many searches share it.  A batch of some dozen queries, each
expanded to a good part of the vocabulary, would open nearly all lists that its
terms have.  Here a term carries its queries as bits, ``BITS`` to a row.  A task
counts a document's terms where they lie and drops those that no query asks for
(by a bitmap of digests; the join that follows is exact), so only asked-for
postings are shuffled: once to their terms' weights and once to their documents,
where queries that share terms share the sums.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import postings
from gridweave.operators.lookup import lookup
from gridweave.operators.ranking import top_k
from gridweave.session import BROADCAST_ROWS, cut

#: Queries of a row of bits.
BITS = 62
#: Bits of the bitmap per term and at most (32 MB), bits of one of its rows, and documents from which a term is sent to the postings.
PER_TERM, MOST_BITS, ROW_BITS, HOT = 16, 1 << 28, 1 << 15, 10_000
#: Terms up to which they are named to the scan, and sets of queries up to which those are spelled out once.
FEW, PATTERNS = 2_000, BROADCAST_ROWS


class Texts(NamedTuple):
    """Documents ``(doc_id, terms ARRAY)`` of distinct ids, as a written table, and their number."""

    docs: DataFrame
    n_docs: int


def texts(docs: DataFrame) -> Texts | None:
    """``docs`` to search in, or nothing if ids repeat."""
    docs = docs.select("doc_id", "terms")
    ids = docs.agg(F.count("*").alias("n")).first().n
    return Texts(docs, ids) if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else None


def packed(rows: DataFrame, numbered: DataFrame, by: list[str]) -> DataFrame:
    """``rows(*by, term, qtf)`` as ``(term, _block, _bits, qtf)`` by the numbers ``_q`` of the queries."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_q"), F.lit(BITS)).cast("int"))
    return lookup(rows, numbered, by, "inner").groupBy("term", F.floor(F.col("_q") / BITS).alias("_block"), "qtf").agg(F.bit_or(one).alias("_bits")).select(
        "term", "_block", "_bits", "qtf")


def queries_of(bits: str = "_bits", block: str = "_block") -> Column:
    """The numbers in a set of bits."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.getbit(bits, i) == 1, F.col(block) * BITS + i)), lambda q: q.isNotNull())


def _bitmap(terms: DataFrame) -> tuple[int, bytes]:
    """Bits at the digests of distinct terms; at most ``MOST_BITS``, whatever the number of terms."""
    size = min(MOST_BITS, max(ROW_BITS, 1 << (PER_TERM * terms.count()).bit_length()))
    at = F.pmod(F.crc32("term"), F.lit(size))
    rows = terms.groupBy(F.floor(at / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(ROW_BITS))).alias("bits"))
    made = bytearray(size // 8)
    for r in rows.toLocalIterator():
        made[r.row * ROW_BITS // 8:(r.row + 1) * ROW_BITS // 8] = r.bits
    return size, bytes(made)


def counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, tf)`` of each document's terms that are among the distinct ``terms``, and of a few others."""
    docs = docs.where(F.size("terms") > 0).select("doc_id", "terms", F.size("terms").alias("dl"))
    named = [r.term for r in terms.limit(FEW + 1).collect()]
    if len(named) <= FEW:
        docs = docs.withColumn("terms", F.filter("terms", lambda t: t.isin(named))).where(F.size("terms") > 0)
    size, made = _bitmap(terms)
    marks = docs.sparkSession.sparkContext.broadcast(made)

    def run(parts):
        from zlib import crc32

        import numpy as np
        import pyarrow as pa

        known = np.frombuffer(marks.value, np.uint8)
        for batch in parts:
            listed = batch.column(1)
            sizes = np.diff(listed.offsets.to_numpy())
            coded = listed.flatten().dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy()
            at = np.array([crc32(n.encode()) for n in names.to_pylist()], np.int64) % size
            asked = ((known[at >> 3] >> (at & 7)) & 1).astype(bool)
            kept = asked[codes]
            both, tf = np.unique((np.repeat(np.arange(len(sizes)), sizes) * max(1, len(names)) + codes)[kept], return_counts=True)
            row, code = np.divmod(both, max(1, len(names)))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), names.take(pa.array(code)), pa.array(tf.astype(np.int32))],
                                             names=["doc_id", "dl", "term", "tf"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dl int, term string, tf int")


def search(asked: DataFrame, numbered: DataFrame, index: Texts, k: int, by: list[str]) -> DataFrame:
    """Top ``k`` documents ``(*by, doc_id, score, rank)`` of ``asked(term, _block, _bits, qtf)``.

    A term may have several rows for a query: what they add is summed.
    """
    asked = cut(asked.groupBy("term", "_block", "_bits").agg(F.sum("qtf").alias("qtf")))
    tf = cut(counted(index.docs, asked.select("term").distinct()))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = cut(asked.join(df, "term").select("term", "_block", "_bits", "df", (F.col("qtf") * postings.weight(F.col("df"), index.n_docs)).alias("w")))
    # A term of many documents has few rows of weights; its postings stay where they are.
    hot, cold = (weights.where(c).drop("df") for c in (F.col("df") > HOT, F.col("df") <= HOT))
    met = lookup(tf, hot, ["term"], "inner").unionByName(tf.join(cold, "term"))
    each = met.select("doc_id", "_block", "_bits", (F.col("w") * postings.impact(F.col("tf"), F.col("dl"))).alias("s")).repartition("doc_id")
    shared = each.groupBy("doc_id", "_block", "_bits").agg(F.sum("s").alias("s"))
    sets = cut(weights.select("_block", "_bits").distinct().withColumn("_of", queries_of()))
    shared = shared.join(F.broadcast(sets), ["_block", "_bits"]) if sets.count() <= PATTERNS else shared.withColumn("_of", queries_of())
    scores = shared.select("doc_id", F.explode("_of").alias("_q"), "s").groupBy("doc_id", "_q").agg(F.round(F.sum("s"), 6).alias("score"))
    # Scores lie by document, so every task has some of each query and limits them before they move.
    return lookup(top_k(scores, ["_q"], [F.desc("score"), F.col("doc_id")], k, salts=1), numbered, ["_q"], "inner").select(*by, "doc_id", "score", "rank")
