"""Passage retrieval: BM25 for many queries at once, plus knowledge-graph expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import postings, scan
from gridweave.operators.containment import contains_pairs
from gridweave.operators.lookup import lookup
from gridweave.operators.ranking import top_k
from gridweave.operators.scan import BITS
from gridweave.session import cut

# Words left out of the index, and the score from which a query isn't taken apart.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the "
              "their then there these they this to was will with").split()
CONFIDENT = 8.0
#: Queries that one task numbers.
NUMBERED = 100_000
WORD = r"([\p{L}\p{N}_-]+)"
TERM = r"([\p{L}\p{N}]+)"


def terms_of(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def words_of(text: Column) -> Column:
    """Query words for the graph: lower case, longer than two."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)), lambda w: F.length(w) > 2)


# --- knowledge base ----------------------------------------------------------
def searchable(passages: DataFrame) -> DataFrame:
    """Adds the text that is indexed: context line, content, questions, concepts, keywords."""
    topic = F.when(F.size("concepts") == 0, "general").otherwise(F.array_join(F.slice("concepts", 1, 5), ", "))
    head = F.concat(F.lit("[From: "), "title", F.lit(" | Topic: "), topic, F.lit("] "), "summary")
    return passages.withColumn("searchable", F.concat_ws(
        "\n", head, "content", F.array_join("questions", " "), F.array_join("concepts", " "), F.array_join("keywords", " ")))


def concepts(passages: DataFrame) -> DataFrame:
    return passages.select(F.explode("concepts").alias("_c"), "doc_id", "title").select(F.lower("_c").alias("concept"), "doc_id", "title")


def relations(entities: DataFrame) -> DataFrame:
    """``(entity, target)`` rows -> lower-cased relations with multiplicity ``n``."""
    return entities.groupBy(F.lower("entity").alias("entity"), F.lower("target").alias("target")).agg(F.count("*").alias("n"))


def concept_relations(rel: DataFrame) -> DataFrame:
    """Both directions of every relation."""
    return rel.select(F.col("entity").alias("key"), F.col("target").alias("other")).unionByName(
        rel.select(F.col("target").alias("key"), F.col("entity").alias("other"))).distinct()


# --- BM25 -----------------------------------------------------------------------
def bm25_index(passages: DataFrame, text: str = "searchable") -> postings.Index:
    """The index of a column's terms, written once; see ``operators.postings``."""
    return postings.write(passages, terms_of(F.col(text)))


def bm25(queries: DataFrame, index: postings.Index | scan.Texts, k: int, by: list[str] = ["query_id"]) -> DataFrame:
    """Top ``k`` passages per query; ``queries(*by, terms ARRAY)``.  Repeated terms count."""
    q = queries.select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("qtf"))
    if isinstance(index, scan.Texts):
        numbered = _numbered(queries, by)
        return scan.search(scan.packed(q, numbered, by), numbered, index, k, by)
    return postings.search(q, index, k, by)


# --- knowledge graph ------------------------------------------------------------
def _touch(words: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Pairs (word, name) where either contains the other."""
    return contains_pairs(names, words, name, "word").select("word", name).unionByName(
        contains_pairs(words, names, "word", name).select("word", name)).distinct()


def query_words(queries: DataFrame, by: list[str]) -> DataFrame:
    return queries.select(*by, F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))


# Most queries reach the same terms, so a term carries its queries as sets of bits, ``BITS`` to a row
# ``(term, _block, _bits)``: an edge is followed once for all of them and the bits meet map-side, where
# a row per query and edge would be shuffled otherwise.
def _numbered(queries: DataFrame, by: list[str]) -> DataFrame:
    """A number ``_q`` per query, of a written table; queries that belong together lie side by side."""
    names = cut(queries.select(*by).distinct())
    return cut(names.repartitionByRange(names.count() // NUMBERED + 1, *by).sortWithinPartitions(*by).withColumn("_q", F.monotonically_increasing_id()))


def _packed(rows: DataFrame, numbered: DataFrame, by: list[str], term: str) -> DataFrame:
    """``rows(*by, term)`` as bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_q"), F.lit(BITS)).cast("int"))
    return lookup(rows, numbered, by, "inner").groupBy(F.col(term).alias("term"), F.floor(F.col("_q") / BITS).alias("_block")).agg(F.bit_or(one).alias("_bits"))


def _along(held: DataFrame, edges: DataFrame, key: str, other: str) -> DataFrame:
    """The bits of ``held`` at the other ends of ``edges``."""
    return held.join(edges.select(F.col(key).alias("term"), F.col(other).alias("_to")), "term").select(F.col("_to").alias("term"), "_block", "_bits")


def _merged(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("term", "_block").agg(F.bit_or("_bits").alias("_bits"))


def _unpacked(held: DataFrame, numbered: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, term)`` rows of merged bits."""
    return lookup(held.select("term", F.explode(scan.queries_of()).alias("_q")), numbered, ["_q"], "inner").select(*by, "term")


def _touched(queries: DataFrame, words: DataFrame, rel: DataFrame, numbered: DataFrame, by: list[str]) -> DataFrame:
    """Entities a query touches, as bits: multi-word inside the query, single words by mutual containment."""
    names = rel.select("entity").distinct()
    single = _touch(words.select(F.col("term").alias("word")).distinct(), names.where(~F.contains("entity", F.lit(" "))), "entity")
    text = queries.select(*by, F.lower("text").alias("_q"))
    multi = text.join(contains_pairs(text, names.where(F.contains("entity", F.lit(" "))), "_q", "entity"), "_q").select(*by, "entity")
    return _merged(_along(words, single, "word", "entity"), _packed(multi, numbered, by, "entity"))


def _reach(queries: DataFrame, words: DataFrame, rel: DataFrame, numbered: DataFrame, by: list[str]) -> list[DataFrame]:
    """One-hop terms as bits: exact entity or concept keys, and targets of touched entities."""
    return [_along(words, rel, "entity", "target"), _along(words, concept_relations(rel), "key", "other"),
            _along(_touched(queries, words, rel, numbered, by), rel, "entity", "target")]


def reachable(queries: DataFrame, rel: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``(*by, term)`` of the one-hop terms."""
    numbered = _numbered(queries, by)
    words = cut(_packed(query_words(queries, by), numbered, by, "word"))
    return _unpacked(_merged(*_reach(queries, words, rel, numbered, by)), numbered, by)


def expand(queries: DataFrame, rel: DataFrame, concept: DataFrame, by: list[str] = ["query_id"]) -> DataFrame:
    """``(*by, term)`` to append to each query: one hop, touching concepts, second hop
    into indexed concepts, minus the query's own words."""
    numbered = _numbered(queries, by)
    return _unpacked(_expansion(queries, rel, concept, numbered, by), numbered, by)


def _expansion(queries: DataFrame, rel: DataFrame, concept: DataFrame, numbered: DataFrame, by: list[str]) -> DataFrame:
    """The terms of :func:`expand` as bits."""
    words = cut(_packed(query_words(queries, by), numbered, by, "word"))
    known = concept.select("concept").distinct()
    touch = _touch(words.select(F.col("term").alias("word")).distinct(), known, "concept").where("word <> concept")
    first = cut(_merged(*_reach(queries, words, rel, numbered, by), _along(words, touch, "word", "concept")))
    edges = concept_relations(rel).join(known.withColumnRenamed("concept", "other"), "other", "left_semi")
    every = _merged(first, _along(first, edges, "key", "other"))
    return every.join(words.withColumnRenamed("_bits", "_own"), ["term", "_block"], "left").select(
        "term", "_block", F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_own", F.lit(0).cast("bigint")))).alias("_bits"))


def decompose(queries: DataFrame, rel: DataFrame, concept: DataFrame) -> DataFrame:
    """Sub-queries ``(query_id, cluster, text)``: the query's words plus up to four
    concepts of one source.  Needs three reachable concepts and two distinct clusters."""
    r = cut(reachable(queries, rel, ["query_id"]))
    enough = r.groupBy("query_id").agg(F.count("*").alias("_n")).where("_n >= 3").select("query_id")
    per = r.join(enough, "query_id", "left_semi").join(concept.select(F.col("concept").alias("term"), "title").distinct(), "term")
    ranked = top_k(per.select("query_id", "title", "term").distinct(), ["query_id", "title"], [F.col("term")], 4)
    clusters = ranked.groupBy("query_id", "title").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("cluster"))
    clusters = clusters.select("query_id", "cluster").distinct()
    several = clusters.groupBy("query_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("query_id")
    base = queries.select("query_id", F.array_join(words_of(F.col("text")), " ").alias("_words"))
    return clusters.join(several, "query_id", "left_semi").join(base, "query_id").select(
        "query_id", "cluster", F.concat_ws(" ", "_words", "cluster").alias("text"))


def kb_boost(queries: DataFrame, scores: DataFrame, rel: DataFrame, concept: DataFrame) -> DataFrame:
    """Fused scores plus 15% of the best score per (word, relation, passage) hit and
    20% per hit of a multi-word entity; repeated hits add."""
    words = queries.select("query_id", F.explode(words_of(F.col("text"))).alias("entity"))
    text = queries.select("query_id", F.lower("text").alias("_q"))
    multi = text.join(contains_pairs(text, rel.where(F.contains("entity", F.lit(" "))), "_q", "entity"), "_q")
    named = words.groupBy("query_id", "entity").agg((F.count("*") * 15).alias("_w")).unionByName(
        multi.select("query_id", "entity", F.lit(20).cast("bigint").alias("_w")))
    # Weights meet per target before passages fan out.
    per_target = named.join(rel, "entity").groupBy("query_id", F.col("target").alias("concept")).agg(F.sum(F.col("_w") * F.col("n")).alias("_w"))
    hits = per_target.join(concept.groupBy("concept", "doc_id").agg(F.count("*").alias("_m")), "concept").groupBy("query_id", "doc_id").agg(F.sum(F.col("_w") * F.col("_m")).alias("_w"))
    best = scores.groupBy("query_id").agg(F.max("score").alias("_best"))
    # Weights are hundredths and scores millionths, so sums are whole and equal sums are equal in any order.
    boost = hits.join(best, "query_id").select("query_id", "doc_id", (F.col("_w") * _millionths("_best")).alias("_s"))
    every = scores.select("query_id", "doc_id", (_millionths("score") * 100).alias("_s")).unionByName(boost)
    return every.groupBy("query_id", "doc_id").agg(F.sum("_s").alias("_s")).select("query_id", "doc_id", (F.expr("(_s + 50) div 100") / 1e6).alias("score"))


def _millionths(score: str) -> Column:
    return F.round(F.col(score) * 1e6).cast("bigint")


def kb_fused(queries: DataFrame, index: postings.Index | scan.Texts, rel: DataFrame, concept: DataFrame, k: int,
             confident: float = CONFIDENT) -> DataFrame:
    """Phases one to three: confidence probe, (sub-)queries with expansion, fused BM25.

    Pass ``rel`` and ``concept`` as written tables: they are read several times.
    """
    plain = queries.withColumn("terms", terms_of(F.col("text")))
    sure = bm25(plain, index, 1).where(F.col("score") > confident).select("query_id")
    unsure = queries.join(sure, "query_id", "left_anti")
    subs = cut(queries.select("query_id", F.lit("").alias("cluster"), "text").unionByName(decompose(cut(unsure), rel, concept)))
    by = ["query_id", "cluster"]
    own = subs.select(*by, F.explode(terms_of(F.col("text"))).alias("term"))
    if isinstance(index, scan.Texts):
        numbered = _numbered(subs, by)
        extra = _expansion(subs, rel, concept, numbered, by).where("_bits <> 0").select(
            F.explode(terms_of(F.col("term"))).alias("term"), "_block", "_bits", F.lit(1).cast("bigint").alias("qtf"))
        asked = scan.packed(own.groupBy(*by, "term").agg(F.count("*").alias("qtf")), numbered, by).unionByName(extra)
        hits = cut(scan.search(asked, numbered, index, max(3 * k, 15), by))
    else:
        extra = expand(subs, rel, concept, by).select(*by, F.explode(terms_of(F.col("term"))).alias("term"))
        terms = own.unionByName(extra).groupBy(*by, "term").agg(F.count("*").alias("qtf"))
        hits = cut(postings.search(terms, index, max(3 * k, 15), by))
    n = subs.groupBy("query_id").agg(F.count("*").alias("_subs"))
    # Whole millionths, so halves are rounded up and not by the last bit of a sum.
    total = hits.join(n, "query_id").groupBy("query_id", "doc_id", "_subs").agg(F.sum(_millionths("score")).alias("_s"))
    return total.select("query_id", "doc_id", (F.expr("(2 * _s + _subs) div (2 * _subs)") / 1e6).alias("score"))


def sandwich(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """Best first, second best last when a query has three results or more."""
    n = ranked.groupBy("query_id").agg(F.count("*").alias("_n"))
    r = F.col(rank)
    return ranked.join(n, "query_id").withColumn("position", F.when((F.col("_n") < 3) | (r == 1), r).when(
        r == 2, F.col("_n")).otherwise(r - 1)).drop("_n")


def kb_search(queries: DataFrame, passages: DataFrame, index: postings.Index | scan.Texts, rel: DataFrame, concept: DataFrame,
              k: int = 5, confident: float = CONFIDENT) -> DataFrame:
    """``(query_id, position, rank, doc_id, title, score)`` for each non-blank query."""
    q = queries.where(F.trim("text") != "")
    fused = cut(kb_fused(q, index, rel, concept, k, confident))
    scores = kb_boost(q, fused, rel, concept).where("score > 0")
    best = cut(top_k(scores, ["query_id"], [F.desc("score"), F.col("doc_id")], k))
    return lookup(passages.select("doc_id", "title"), cut(sandwich(best)), ["doc_id"], "inner")
