"""Source divergence audit: how far the sources of a language differ in their terms.

1. *Duplicate-text collapse.*  Equal texts of a language are one row with a
   multiplicity per source.  Copies are counted by digest; texts that have some
   are combined before they are shuffled, the others stay where they are.
2. *Tokenised once.*  A text's terms are counted once and added, times the
   multiplicity of each of its sources, to counts and document frequencies.
   A task adds up many texts before it emits a row per (lang, source, term).
3. *Sparse pairs.*  A term that a source lacks has the floor value of that
   source, so a pair's sum starts from the floors of all terms and is put right
   for the terms that one of the two holds (by the source's histogram of
   values) and that both hold (by a join on the term).  No dense source by
   term table is made.

Arithmetic is exact: counts are integers, quotients are taken of decimals.

Defined results: null texts, languages and sources count as empty strings;
texts without a term make their group occur; a language without a kept term
(a small one) has pairs of value 0 and no term rows; a language with one source
has no pairs; repeated rows count again; ties of value go by the item in UTF-8
order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.operators.lookup import lookup
from gridweave.operators.ranking import top_k
from gridweave.session import cut

#: Documents of a language that a kept term is in at least.
LEAST = 30
#: Scale of the shares, and count added to every term.
SCALE, ADDED = 1_000_000_000, 5
#: Terms of a group that are reported.
TOP = 50
#: Distinct (group, term) entries that a task adds up before it emits them.
HELD = 200_000
#: Texts with copies up to which their digests are sent to every executor (some 60 bytes each).
COPIED = 100_000
#: Letters A-Z become a-z, other bytes that no term holds become spaces.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def collapsed(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, text, held)``: distinct texts of a language with ``held`` = (source, copies) pairs.

    Digests say which texts have copies; only those are moved together.
    """
    d = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    d = d.withColumn("dig", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = cut(d.groupBy("lang", "dig", "source").agg(F.count("*").alias("n")).groupBy("lang", "dig").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("held")).where("all > 1"))  # an entry per source
    known = lookup(d, copies.select("lang", "dig", F.lit(True).alias("more")), ["lang", "dig"], most=COPIED)
    alone = known.where("more is null").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("bigint").alias("n"))).alias("held"))
    texts = known.where("more").groupBy("lang", "dig").agg(F.first("text").alias("text"))
    return alone.unionByName(texts.join(copies, ["lang", "dig"]).select("lang", "text", "held"))


def term_counts(distinct: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, to be added up; a task has few rows of a key."""
    def run(parts):
        import pyarrow as pa

        count: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def rows():
            for (lang, source), c in count.items():
                terms, d = list(c), docs[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                     pa.array([c[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            count.clear()
            docs.clear()

        for batch in parts:
            for lang, text, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                terms = text.as_py().translate(FOLD).split()
                found = None
                for h in held.as_py():
                    key, n = (lang.as_py(), h["source"]), h["n"]
                    if key not in count:
                        count[key], docs[key] = Counter(), Counter()
                    if n == 1:
                        count[key].update(terms)
                        docs[key].update(set(terms))
                    else:
                        found = found or Counter(terms)
                        count[key].update({t: n * k for t, k in found.items()})
                        docs[key].update(dict.fromkeys(found, n))
                if sum(map(len, count.values())) > HELD:
                    yield from rows()
        yield from rows()

    return distinct.select("lang", F.col("text").cast("binary").alias("text"), "held").mapInArrow(
        run, "lang string, source string, term string, n bigint, docs bigint")


def with_share(df: DataFrame, name: str, count: str, total: str = "total", terms: str = "terms") -> DataFrame:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms))`` as column ``name``; null without terms."""
    return df.withColumn(name, F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(19,0))) div nullif(cast({total} + {ADDED} * {terms} as decimal(19,0)), 0)"))


def kept_counts(docs: DataFrame, least: int, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, term, n)`` of the kept terms, and ``(lang, source, total, terms)`` of all groups; both written."""
    # Dealt out once, by term: sums of a source and of its language need no other shuffle.
    rows = term_counts(collapsed(docs, text, lang, source)).repartition("lang", "term")
    rows = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = F.sum("docs").over(W.partitionBy("lang", "term"))  # a row per source
    counts = cut(rows.withColumn("_d", of_lang).where(F.col("_d") >= least).select("lang", "source", "term", "n"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.groupBy("lang", "term").agg(F.count("*").alias("_s")).groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    return counts, cut(groups)


def pair_rows(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: summed differences to every other source of the language.

    ``shares(lang, source, term, p)`` has the terms a source holds; the floor of
    a source (``p0``) stands for the others.
    """
    floors = with_share(groups.withColumn("_none", F.lit(0)), "p0", "_none").select("lang", "source", "terms", F.coalesce("p0", F.lit(0)).alias("p0"))
    mine, other = floors, floors.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = mine.join(other, "lang").where("source < item").withColumn("value", F.col("terms") * F.abs(F.col("p0") - F.col("q0")))

    # Terms that one side holds against the other's floor: a histogram of shares is enough.
    bars = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one = bars.join(floors.select("lang", "source", "p0"), ["lang", "source"]).join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("v"))
    # Terms that both hold: their true difference in place of what the two sides have put.
    held = shares.join(floors.select("lang", "source", "p0"), ["lang", "source"])
    there = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = held.join(there, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(
        F.sum(F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q")) + F.abs(F.col("p0") - F.col("q0"))).alias("v"))

    low, high = F.least("source", "item"), F.greatest("source", "item")
    moved = one.unionByName(both).groupBy("lang", low.alias("source"), high.alias("item")).agg(F.sum("v").alias("v"))
    summed = cut(pairs.join(moved, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("value") + F.coalesce("v", F.lit(0))).alias("value")))
    return summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def term_rows(counts: DataFrame, shares: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms a group has more of than its language."""
    size = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(size, "lang")
    whole = with_share(whole, "q", "n").select("lang", "term", "q")
    over = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return top_k(over, ["lang", "source"], [F.col("value").desc(), F.col("item")], top)


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every pair of sources and each group's ``top`` terms."""
    counts, groups = kept_counts(docs, least, text, lang, source)
    shares = cut(with_share(counts.join(groups, ["lang", "source"]), "p", "n").select("lang", "source", "term", "p"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")  # a group has a row per other source
    pairs = pair_rows(shares, groups).withColumn("rank", F.row_number().over(order))
    rows = pairs.withColumn("part", F.lit("pair")).unionByName(term_rows(counts, shares, groups, top).withColumn("part", F.lit("term")))
    return rows.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
