"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` it begins with.  Consecutive lines
of one level form a passage; blank lines end it.  Passages are normalised
(lower case, single blanks) and hashed.  A quoted passage links to the earliest
message of its conversation that holds the passage in its own words (level 0),
if that is an earlier turn; else to the earliest message whose own lines include
all lines of the passage, if that is an earlier turn, so answers between the
lines and trimmed quotes keep their link.  A message replies to the origin of its first linked
passage of the lowest level.  Replies form threads; a conversation lists thread
by thread, and each message keeps its own lines only.

The earliest holder of a passage is a minimum per (conversation, hash), so a
passage that thousands repeat costs one row each and no pairs.  So is that of a
line; several lines are sought once per conversation and set of lines, in the
messages that hold the rarest of them.  Threads are found by pointer jumping
over written tables.  Places are counted by blocks of turns and by ranges of
threads, so a huge conversation is never sorted in one task.

Defined results: null text counts as empty; a message of quotes only keeps an
empty content; rows without conversation or turn have no links, are threads of
their own and have no place; rows that repeat a (conversation, turn) share its
links and take neighbouring places; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridweave.session import cut

#: Turns that are counted as one block of places, and threads as one range.
TURNS = 1024
QUOTE = r"^(?:[ \t]*>)+"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """``(level, body)`` of each line."""
    return F.transform(F.split(text, "\n"), lambda l: _let(F.regexp_extract(l, QUOTE, 0), lambda q: F.struct(
        F.length(F.translate(q, " \t", "")).alias("level"), F.trim(F.translate(F.substring(l, F.length(q) + 1, F.length(l)), "\t\r\f\u000b", "    ")).alias("body"))))


def passages(all_lines: Column) -> Column:
    """``(level, hash, parts)`` of each run of non-blank lines of one level; ``parts`` are the hashes of its lines."""
    def normal(x: Column) -> Column:
        return F.md5(F.trim(F.regexp_replace(F.lower(x), " +", " ")).cast("binary"))

    marked = _let(all_lines, lambda ls: F.transform(ls, lambda x, i: F.when(x["body"] == "", F.lit("")).otherwise(F.concat(
        F.when((i > 0) & (F.get(ls, i - 1)["level"] == x["level"]) & (F.get(ls, i - 1)["body"] != ""), F.lit("\u0002")).otherwise(
            F.concat(F.lit("\u0003"), x["level"].cast("string"), F.lit("\u0001"))), F.translate(x["body"], "\u0001\u0002\u0003", "   ")))))
    runs = F.filter(F.split(F.array_join(marked, ""), "\u0003"), lambda r: r != "")
    return F.transform(runs, lambda r: F.struct(
        F.substring_index(r, "\u0001", 1).cast("int").alias("level"),
        normal(F.translate(F.substring_index(r, "\u0001", -1), "\u0002", " ")).alias("hash"),
        F.array_sort(F.array_distinct(F.transform(F.split(F.substring_index(r, "\u0001", -1), "\u0002"), normal))).alias("parts")))


def own(all_lines: Column) -> Column:
    """The lines of level 0, without blank ends."""
    return F.regexp_replace(F.array_join(F.transform(F.filter(all_lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")


def part_origins(found: DataFrame, quoted: DataFrame) -> DataFrame:
    """``(conv_id, parts, _first)``: the earliest message whose own lines include all of ``parts``, for each set of lines in ``quoted``."""
    asked = cut(quoted.select("conv_id", "parts").distinct())
    wanted = asked.select("conv_id", F.explode("parts").alias("part")).distinct()
    held = cut(found.where("level = 0").select("conv_id", "turn", F.explode("parts").alias("part")).join(wanted, ["conv_id", "part"], "left_semi").distinct())
    counts = held.groupBy("conv_id", "part").agg(F.count("*").alias("_n"), F.min("turn").alias("_first"))
    parts = asked.select("conv_id", "parts", F.explode("parts").alias("part")).join(counts, ["conv_id", "part"], "left")
    # The rarest line of each set; a set with a line that nobody wrote has no origin.
    rarest = cut(parts.groupBy("conv_id", "parts").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "part", "_first")).alias("r")).where("r._n > 0").select("conv_id", "parts", "r.part", "r._first"))
    one = rarest.where(F.size("parts") == 1).select("conv_id", "parts", "_first")
    at = rarest.where(F.size("parts") > 1).select("conv_id", "parts", "part").join(held, ["conv_id", "part"]).select("conv_id", "turn", "parts")
    own_parts = held.groupBy("conv_id", "turn").agg(F.collect_set("part").alias("_own"))
    many = at.join(own_parts, ["conv_id", "turn"]).where(F.size(F.array_except("parts", "_own")) == 0).groupBy("conv_id", "parts").agg(F.min("turn").alias("_first"))
    return one.unionByName(many)


def threads(parents: DataFrame) -> DataFrame:
    """``parents(conv_id, turn, parent)`` with the first message of each reply chain, as ``root``."""
    todo = cut(parents.select("conv_id", "turn", "parent", F.col("parent").alias("root")))
    while True:
        up = todo.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_up"))
        step = cut(todo.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "parent", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        todo = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return todo


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, content, parent_turn, thread, place, n_quotes, n_linked)`` of every message."""
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"),
                        lines(F.coalesce(F.col(text), F.lit(""))).alias("_l"))
    found = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode(passages(F.col("_l"))).alias("k", "p")).select(
        "conv_id", "turn", "k", "p.level", "p.hash", "p.parts")
    origin = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("_from"))
    whole_links = cut(found.where("level > 0").join(origin, ["conv_id", "hash"], "left").select(
        "conv_id", "turn", "k", "level", "parts", F.when(F.col("_from") < F.col("turn"), F.col("_from")).alias("_from")))
    sought = part_origins(found, whole_links.where("_from is null"))
    quoted = whole_links.join(sought, ["conv_id", "parts"], "left").select(
        "conv_id", "turn", "k", "level", F.coalesce("_from", F.when(F.col("_first") < F.col("turn"), F.col("_first"))).alias("_from"))
    linked = cut(quoted.distinct().groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("_from").alias("n_linked"),
        F.min(F.when(F.col("_from").isNotNull(), F.struct("level", "k", "_from")))["_from"].alias("parent")))
    roots = threads(linked.where("parent is not null"))
    facts = linked.join(roots.select("conv_id", "turn", "root"), ["conv_id", "turn"], "left")
    whole = m.join(facts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", own(F.col("_l")).alias("content"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"))
    placed = whole.withColumn("_b", F.floor(F.col("turn") / TURNS))
    block = ["conv_id", "thread", "_b"]
    span = F.floor(F.col("thread") / TURNS).alias("_r")
    sizes = placed.groupBy(*block).agg(F.count("*").alias("_n")).select("*", span)
    ranges = sizes.groupBy("conv_id", "_r").agg(F.sum("_n").alias("_n"))
    lower = ranges.select("conv_id", "_r", (F.sum("_n").over(W.partitionBy("conv_id").orderBy("_r")) - F.col("_n")).alias("_low"))
    upto = F.sum("_n").over(W.partitionBy("conv_id", "_r").orderBy("thread", "_b")) - F.col("_n")
    before = sizes.select(*block, "_r", upto.alias("_up")).join(lower, ["conv_id", "_r"]).select(*block, (F.col("_low") + F.col("_up")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*block).orderBy("turn", "role", "content"))
    return placed.withColumn("_in", inside).join(before, block, "left").select(
        "conv_id", "turn", "role", "content", "parent_turn", "thread", (F.col("_before") + F.col("_in")).alias("place"), "n_quotes", "n_linked")
