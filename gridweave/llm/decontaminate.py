"""Benchmark passages inside documents, by SimHash windows and a multi-index of Hamming blocks.

Words are runs of letters and digits of the lower-cased text, shingles are five
words.  A window has the length of some item and stands where one of its
shingles lies as in that item; other windows share no shingle with an item of
their length in its place and are never built.  Windows and items get a 64-bit
SimHash, each shingle weighted by its characters.  The 64 bits are cut into
``RADIUS + 1`` blocks: two fingerprints within the radius agree on a whole
block, so an equi-join on (length, block, value) meets every such pair.  Pairs
within the radius are then verified by exact weighted Jaccard similarity of
shingles, repeated shingles counting as often as they occur.

Defined results: one row per document and item, with the best window (the
first among equals); null and empty texts give none; items of fewer than five
words prove nothing and are left out; repeated ids of items or documents are
compared under their id, repeated rows give one row; rows without an id are
searched and reported with a null id; a document shorter than an item is one
window; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.session import cut

WORDS = 5
#: Fingerprint bits that may differ: at similarity 0.8 about ten do, with a deviation below three.
RADIUS = 20
BITS = 64
#: Item shingles up to which they are sent to every executor; beyond, the join shuffles.
BROADCAST_SHINGLES = 200_000

WORD_PATTERN = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often a lambda in it asks."""
    return F.transform(F.array(value), body)[0]


def _hashes(words: Column) -> Column:
    """Hash of the shingle at each place; empty for fewer than five words."""
    at = [lambda i, w, k=k: F.get(w, i + k) for k in range(WORDS)]
    return _let(words, lambda w: F.when(F.size(w) >= WORDS, F.transform(
        F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[a(i, w) for a in at]))).otherwise(F.array().cast("array<bigint>")))


def _bag(words: Column) -> Column:
    """Shingles as (hash, occurrence, weight), so that sets of them are multisets."""
    return _let(words, lambda w: _let(_hashes(w), lambda hashes: F.transform(hashes, lambda h, i: F.struct(
        h.alias("h"), F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda x: x == h)).alias("k"),
        F.length(F.array_join(F.slice(w, i + 1, F.lit(WORDS)), "")).alias("w")))))


def _weight(bag: Column) -> Column:
    return F.aggregate(bag, F.lit(0), lambda acc, s: acc + s["w"])


def _simhash(bag: Column) -> Column:
    """Bit j is the sign of the weights of hashes with bit j set, less the others."""
    sums = F.aggregate(bag, F.array_repeat(F.lit(0), BITS), lambda acc, s: F.zip_with(
        acc, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda t, j: t + F.when(F.getbit(s["h"], j) == 1, s["w"]).otherwise(-s["w"])))
    return F.aggregate(sums, F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("bit")), lambda acc, t: F.struct(
        F.when(t > 0, acc["v"].bitwiseOR(acc["bit"])).otherwise(acc["v"]).alias("v"), F.shiftleft(acc["bit"], 1).alias("bit")))["v"]


def _edges() -> list[tuple[int, int]]:
    """Bit ranges of the Hamming blocks."""
    return [(BITS * i // (RADIUS + 1), BITS * (i + 1) // (RADIUS + 1)) for i in range(RADIUS + 1)]


def _fingerprints(bags: DataFrame) -> DataFrame:
    """``bags(bag, ...)`` with its fingerprint and one (block, value) row per Hamming block."""
    blocks = F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in _edges()])
    return bags.withColumn("fp", _simhash(F.col("bag"))).select("*", F.posexplode(blocks).alias("block", "value"))


def passages(docs: DataFrame, items: DataFrame, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, n_words, similarity, distance)`` of every document that holds an item.

    ``start`` counts words from 0; a window is reported from a weighted
    similarity of ``num / den``.
    """
    item = cut(items.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("_w")).select(
        "item_id", F.size("_w").alias("n"), _bag(F.col("_w")).alias("bag")).where(F.col("n") >= WORDS))
    known = item.select("n", F.posexplode("bag").alias("p", "s")).select(F.col("s.h").alias("h"), "n", "p").distinct()
    known = cut(known)
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    words = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("_w"))
    hits = words.select("doc_id", F.size("_w").alias("_n"), F.posexplode(_hashes(F.col("_w"))).alias("_at", "h")).join(known, "h")
    start = F.greatest(F.lit(0), F.least(F.col("_at") - F.col("p"), F.col("_n") - F.col("n")))
    windows = cut(hits.select("doc_id", "n", start.alias("start")).distinct())

    # Texts meet their windows before they are cut into words again: few have any.
    placed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(windows, F.col("_id").eqNullSafe(F.col("doc_id")))
    bags = placed.select("doc_id", "n", "start", _bag(F.slice(_words(F.col("_text")), F.col("start") + 1, F.col("n"))).alias("bag"))
    theirs = _fingerprints(item).select("item_id", "n", "block", "value", F.col("fp").alias("_fp"), F.col("bag").alias("_bag"))
    near = _fingerprints(bags).join(theirs, ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp")))).where(
        F.col("distance") <= RADIUS)
    # A pair meets on every block it agrees on; the first of them speaks for it.
    differ = F.col("fp").bitwiseXOR(F.col("_fp"))
    agree = [F.when((F.col("block") > i) & (F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0), 1).otherwise(0)
             for i, (a, b) in enumerate(_edges())]
    both = _weight(F.array_intersect("bag", "_bag"))
    scored = near.where(reduce(add, agree) == 0).select("doc_id", "item_id", "start", "n", "distance", both.alias("_i"), (_weight(F.col("bag")) + _weight(F.col("_bag")) - both).alias("_u"))
    best = scored.where(F.col("_i") * den >= F.col("_u") * num).groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("_i") / F.col("_u")).alias("similarity"), (-F.col("start")).alias("_s"), "n", (-F.col("distance")).alias("_d"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b._s")).alias("start"), F.col("b.n").alias("n_words"),
                       F.col("b.similarity").alias("similarity"), (-F.col("b._d")).alias("distance"))
