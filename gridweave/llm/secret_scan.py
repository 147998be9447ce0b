"""Secret scan through a trigram index.

Each rule's pattern is turned into a Boolean query over trigrams (an OR of
ANDs, derived from the parsed pattern, lower-cased).  The index holds a posting
``(trigram, doc_id)`` for every trigram that some rule asks for; postings are
intersected per rule and branch, and the rule's pattern then runs only over the
texts that are left.  A rule without a mandatory trigram runs over every text.

Defined results: null text counts as empty; a text without secrets has an empty
array; every row of the input comes back once, repeated ids included (an id's
postings are those of all its rows, which only adds candidates); rows without
an id are scanned like the rest; texts are scanned whole.  A column named
``found`` is replaced, other columns are kept.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base rules and four public token formats.
#: A bound inside a pattern stands for a least length where both give the same matches (runs of one class).
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ("assign", "access", "hex")
#: Members up to which a character class is spelled out, and branches up to which a query is kept apart.
CLASS_MOST, BRANCH_MOST = 8, 64
GAP = "\0"  # stands for text that may be anything


def _strings(tree) -> list[str]:
    """Literal texts that any match has to follow, with gaps; one string per branch."""
    out = [""]
    for op, arg in tree:
        if op is kind.LITERAL:
            step = [chr(arg)]
        elif op is kind.IN and len(arg) <= CLASS_MOST and all(o is kind.LITERAL for o, _ in arg):
            step = [chr(c) for _, c in arg]
        elif op is kind.BRANCH:
            step = [s for branch in arg[1] for s in _strings(branch)]
        elif op is kind.SUBPATTERN:
            step = _strings(arg[3])
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT) and arg[0] > 0:
            step = [s + GAP for s in _strings(arg[2])]
        elif op is kind.AT:
            step = [""]
        else:
            step = [GAP]
        if len(out) * len(step) > BRANCH_MOST:
            step = [GAP]
        out = [a + b for a in out for b in step]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams; empty if some match need not hold any."""
    branches = set()
    for s in _strings(parser.parse(pattern)):
        grams = {p[i:i + 3].lower() for p in s.split(GAP) for i in range(len(p) - 2)}
        if not grams:
            return []
        branches.add(frozenset(grams))
    return sorted((b for b in branches if not any(o < b for o in branches)), key=sorted)


def postings(docs: DataFrame, grams: list[str], doc_id: str, text: str) -> DataFrame:
    """The index, ``(trigram, doc_id)``, for the trigrams that are asked for."""
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, rules)``: the indexed rules whose trigram query the document meets."""
    # A branch's trigrams are numbered, so that its postings combine as bits (up to 62 trigrams of a branch are asked for).
    terms = [(r.kind, i, g, 1 << k, min(len(b), 62)) for r in rules for i, b in enumerate(trigram_query(r.pattern))
             for k, g in enumerate(sorted(b)[:62])]
    query = docs.sparkSession.createDataFrame(terms, "rule string, branch int, trigram string, bit bigint, size int")
    posts = postings(docs, sorted({t[2] for t in terms}), doc_id, text)
    # The query side has one row per trigram of the rules, whatever the data.
    met = posts.join(F.broadcast(query), "trigram").groupBy("doc_id", "rule", "branch").agg(
        F.bit_or("bit").alias("_bits"), F.first("size").alias("size"))
    return met.where(F.bit_count("_bits") == F.col("size")).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _matches(rule: Rule, order: int, text: Column) -> Column:
    """All matches of a rule: the texts between them give their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    walk = F.aggregate(
        F.filter(parts, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string,text:string>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
            F.when(F.length(p["value"]) >= rule.least, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["gap"])).alias("start"), F.lit(order).alias("order"),
                (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                F.lit(rule.kind).alias("kind"), p["hit"].alias("text"))))).otherwise(acc["spans"]).alias("spans")))
    return walk["spans"]


def scan(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``found``: an array of ``(kind, start, end, text)`` by start, then in the rules' order.

    Starts and ends count code points, the end is exclusive.
    """
    keep = [c for c in docs.columns if c != "found"]
    hits = candidates(docs, rules, doc_id, text).select(F.col("doc_id").alias("_for"), F.col("rules").alias("_rules"))
    joined = docs.select(*keep).join(hits, F.col(doc_id).eqNullSafe(F.col("_for")), "left").withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,text:string>>")
    each = []
    for i, r in enumerate(rules):
        asked = F.array_contains("_rules", r.kind) if trigram_query(r.pattern) else F.rlike("_t", F.lit(r.pattern))
        each.append(F.when(asked, _matches(r, i, F.col("_t"))).otherwise(none))
    spans = F.transform(F.sort_array(F.concat(*each)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return joined.select(*[F.col(c) for c in keep], spans.alias("found"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by its kind in brackets."""
    walk = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(
            acc["out"]).alias("out")))
    rest = F.transform(F.array(walk), lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text))))[0]
    return F.when(F.size(found) > 0, rest).otherwise(text)
