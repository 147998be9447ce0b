"""Licence scan: normalised passages against licence templates by Dice coefficient over word bigrams.

A document's units are its whole text and each of its lines; besides them, every
run of words is a window, whatever lines it spans.  Texts and templates are
lower-cased and cut into words; both become bags of adjacent word pairs (a pair
counts as often as it occurs).  The Dice coefficient is
``2 * |A & B| / (|A| + |B|)``; a coefficient of at least ``num / den`` bounds the
larger bag by ``(2 * den - num) / num`` times the smaller, so a unit meets only
the templates of sizes within that bound.  Bigrams are an inverted index over
the templates; the bags' intersection is counted from its postings.

The best window of a template begins and ends with one of its pairs, so windows
stand only between the places of such pairs, and only where enough of them lie
close together.  A document's windows are taken best first, those that overlap a
taken one are left out; what is left are the licences that it holds.

Defined results: one row per row of the table and licence that it holds, and one
row for a row without any; null or empty texts and those without a match have
null licence and line and a coefficient of 0; a licence that a unit matches has
the place and coefficient of its best unit (then the whole text before lines and
the first line), any other those of its best window, whose line is that of its
first word; of equal matches of one place the first licence by name wins; units
and windows of fewer than three words match nothing; rows that share an id are
told apart by their text; repeated rows repeat their result; columns of the
output's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short forms in which texts state their licence, by SPDX name, and two full grants.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
WORD = "[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _pairs(words: Column) -> Column:
    """Adjacent word pairs; none for fewer than two words."""
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= 2, F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>")))[0]


def templates(spark, rows=TEMPLATES) -> DataFrame:
    """``(template, licence, pair, times, size)``: the inverted index; its size is that of the template list."""
    raw = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "template int, licence string, text string")
    bags = raw.select("template", "licence", _pairs(_words(F.col("text"))).alias("_p")).select("template", "licence", F.size("_p").alias("size"), F.explode("_p").alias("pair"))
    return bags.groupBy("template", "licence", "size", "pair").agg(F.count("*").alias("times"))


def unit_matches(docs: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """``(doc_id, key, licence, line, dice)``: the best unit of each licence that a unit of ``docs(doc_id, key, text)`` matches.

    ``line`` counts from 1; 0 stands for the whole text.
    """
    sizes = index.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).first()
    lo, hi = sizes["lo"] or 0, sizes["hi"] or 0

    def within(n: Column, a, b) -> Column:
        return (n * (2 * den - num) >= F.lit(a) * num) & (n * num <= F.lit(b) * (2 * den - num))

    # Bounds on words, from the sizes of all templates, keep most units out before pairs are made.
    units = F.concat(F.array("text"), F.when(F.instr("text", "\n") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    unit = docs.select("doc_id", "key", F.posexplode(units).alias("line", "_t")).where(
        F.length("_t") >= 2 * lo * num / (2 * den - num))
    words = unit.select("doc_id", "key", "line", _words(F.col("_t")).alias("_w")).where(within(F.size("_w") - 1, lo, hi) & (F.size("_w") >= 3))
    pairs = words.select("doc_id", "key", "line", (F.size("_w") - 1).alias("n"), F.explode(_pairs(F.col("_w"))).alias("pair"))
    # The index has one row per pair of the template list, whatever the data.
    hit = pairs.join(F.broadcast(index), "pair").where((F.col("n") * (2 * den - num) >= F.col("size") * num) & (F.col("n") * num <= F.col("size") * (2 * den - num)))
    counted = hit.groupBy("doc_id", "key", "line", "n", "template", "licence", "size", "pair", "times").agg(F.count("*").alias("c"))
    both = counted.groupBy("doc_id", "key", "line", "n", "template", "licence", "size").agg(F.sum(F.least("c", "times")).alias("_i"))
    scored = both.where(F.col("_i") * 2 * den >= (F.col("n") + F.col("size")) * num).withColumn("dice", 2 * F.col("_i") / (F.col("n") + F.col("size")))
    best = scored.groupBy("doc_id", "key", "licence").agg(F.min(F.struct((-F.col("dice")).alias("d"), "line")).alias("b"))
    return best.select("doc_id", "key", "licence", F.col("b.line").alias("line"), (-F.col("b.d")).alias("dice"))


def window_matches(docs: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """``(doc_id, key, licence, line, dice, start, n)``: windows of ``n`` pairs from pair ``start`` on, of each start those that no shorter one equals.

    Of a document only the pairs that a template holds are kept, with their line.
    """
    lined = F.flatten(F.transform(F.split(F.lower("text"), "\n"), lambda l, i: F.transform(
        F.regexp_extract_all(l, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    # zip_with ends the longer side's last pair in null, which meets no template.
    pairs = F.transform(F.array(lined), lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(
        F.concat(a["w"], F.lit(" "), b["w"]).alias("pair"), a["line"].alias("line"))))[0]
    hit = docs.select("doc_id", "key", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "key", "pos", F.col("p.pair").alias("pair"), F.col("p.line").alias("line")).join(
        F.broadcast(index), "pair")
    of = ["doc_id", "key", "template", "licence", "size"]
    # A hit adds to a window's intersection if the last hit of its pair that is one too many lies before the window.
    spots = hit.groupBy(*of, "pair", "times").agg(F.sort_array(F.collect_set(F.struct("pos", "line"))).alias("_s"))
    hits = spots.select(*of, F.explode(F.transform("_s", lambda s, k: F.struct(s["pos"].alias("pos"), F.when(k >= F.col("times"), F.get("_s", (k - F.col("times")).cast("int"))["pos"]).otherwise(-1).alias("over"), s["line"].alias("line")))).alias("h"))
    least, most = F.ceil(F.col("size") * num / (2 * den - num)).cast("int"), F.floor(F.col("size") * (2 * den - num) / num).cast("int")
    lists = hits.groupBy(*of).agg(F.sort_array(F.collect_list("h")).alias("_h")).withColumns({"_least": least, "_most": most}).where(F.size("_h") >= F.col("_least"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_h") - F.col("_least")), lambda i: F.get("_h", i + F.col("_least") - 1)["pos"] - F.get("_h", i)["pos"] < F.col("_most"))
    begun = lists.select(*of, "_h", "_most", F.explode(begins).alias("_i")).select(
        *of, F.get("_h", F.col("_i"))["pos"].alias("start"), F.get("_h", F.col("_i"))["line"].alias("line"), F.slice("_h", F.col("_i") + 1, F.col("_most")).alias("_g"), "_most")

    def longer(acc: Column, h: Column) -> Column:
        both = acc["i"] + F.when(h["over"] < F.col("start"), 1).otherwise(0)
        n = h["pos"] - F.col("start") + 1
        better = (n >= 2) & (n <= F.col("_most")) & (both * (acc["n"] + F.col("size")) > acc["both"] * (n + F.col("size")))
        good = better & (both * 2 * den >= (n + F.col("size")) * num)
        return F.struct(both.alias("i"), F.when(better, both).otherwise(acc["both"]).alias("both"), F.when(better, n).otherwise(acc["n"]).alias("n"),
                        F.when(good, F.concat(acc["w"], F.array(F.struct(both.alias("both"), n.alias("n"))))).otherwise(acc["w"]).alias("w"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("both"), F.lit(0).alias("n"), F.array().cast("array<struct<both:int,n:int>>").alias("w"))
    return begun.select("doc_id", "key", "licence", "line", "size", "start", F.explode(F.aggregate("_g", zero, longer)["w"]).alias("b")).select(
        "doc_id", "key", "licence", "line", (2 * F.col("b.both") / (F.col("b.n") + F.col("size"))).alias("dice"), "start", F.col("b.n").alias("n"))


def matches(docs: DataFrame, index: DataFrame, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, key, licence, line, dice)``: every licence of each document that has one; ``key`` is the digest of its text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    units = unit_matches(d, index, num, den).groupBy("doc_id", "key").agg(F.collect_list(F.struct("licence", "line", "dice")).alias("_u"))
    best = F.array_min(F.transform("_u", lambda u: F.struct((-u["dice"]).alias("d"), u["line"].alias("line"), u["licence"].alias("licence"))))["licence"]
    placed = window_matches(d, index, num, den).join(
        units.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_u", best.alias("_best")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    # The licence of the best unit first, then the best window.
    order = F.struct((~F.col("licence").eqNullSafe(F.col("_best"))).alias("other"), (-F.col("dice")).alias("d"), (-F.col("n")).alias("m"), "start", "licence", "line", "n", "dice")
    listed = placed.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(order)).alias("_w"), F.first("_u").alias("_u"))

    def taken(acc: Column, w: Column) -> Column:
        apart = ~F.exists(acc, lambda t: (w["start"] <= t["start"] + t["n"]) & (t["start"] <= w["start"] + w["n"]))
        return F.when(apart, F.concat(acc, F.array(w))).otherwise(acc)

    kept = listed.withColumn("_k", F.aggregate("_w", F.slice("_w", 1, 0), taken))
    each = kept.select("doc_id", "key", "_u", "_k", F.explode(F.array_distinct(F.transform("_k", lambda w: w["licence"]))).alias("licence"))
    unit = F.get(F.filter(F.coalesce("_u", F.array().cast("array<struct<licence:string,line:int,dice:double>>")), lambda u: u["licence"] == F.col("licence")), F.lit(0))
    window = F.get(F.filter("_k", lambda w: w["licence"] == F.col("licence")), F.lit(0))
    return each.select("doc_id", "key", "licence", F.coalesce(unit["line"], window["line"]).alias("line"), F.coalesce(unit["dice"], window["dice"]).alias("dice"))


def scan(docs: DataFrame, index: DataFrame, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``licence``, ``line`` and ``dice`` of each licence it holds, a row for each."""
    found = matches(docs, index, num, den, doc_id, text).withColumnsRenamed({"doc_id": "_for", "key": "_digest"})
    keep = [c for c in docs.columns if c not in ("licence", "line", "dice")]
    return docs.select(*keep, F.xxhash64(text).alias("_own")).join(found, F.col(doc_id).eqNullSafe(F.col("_for")) & (F.col("_own") == F.col("_digest")), "left").select(
        *keep, "licence", "line", F.coalesce("dice", F.lit(0.0)).alias("dice"))
