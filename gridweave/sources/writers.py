"""File sinks for training sets, archives and stamp text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.ranking import draw


def write_splits(df: DataFrame, path: str, fmt: str = "chat") -> None:
    """One folder of JSON lines per split: ``{"messages": …}`` or ``{"text": …}``."""
    field = "messages" if fmt == "chat" else "text"
    df.select("split", F.to_json(F.struct(field)).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).text(path)


def merge_splits(base: DataFrame, new: DataFrame, seed: int = 42) -> DataFrame:
    """Append ``new(split, value)`` to the splits that ``base`` has, and reshuffle.

    The order is a deterministic digest order within each split, by a
    distributed range sort.
    """
    have = base.select("split").distinct()
    both = base.where("trim(value) <> ''").unionByName(new.join(have, "split", "left_semi"))
    return both.withColumn("_k", draw(seed, F.col("value"))).orderBy("split", "_k", "value").drop("_k")


def write_archive(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per theme."""
    df.write.mode("overwrite").partitionBy("theme").json(path)


def stamp_text(entries: DataFrame, palette: DataFrame) -> DataFrame:
    """Text blocks in order: header, palette lines, then one block per entry.

    ``entries(name, palette, size, affordance, tags, accuracy, grid)``; returns
    ``(palette, part, ord, text)`` rows to be written sorted, so a palette with
    very many stamps is never gathered into one value.
    """
    head = palette.select("palette").distinct().select("palette", F.lit(0).alias("part"), F.lit("").alias("ord"), F.concat(
        F.lit("# stamps generated from a corpus\n[palette."), "palette", F.lit("]")).alias("text"))
    hexed = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 2, "0"))
    pal = palette.select("palette", F.lit(1).alias("part"), F.col("sym").alias("ord"), F.concat(
        F.lit('"'), "sym", F.lit('" = "#'), hexed("r"), hexed("g"), hexed("b"), hexed("a"), F.lit('"')).alias("text"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("[stamp."), "name", F.lit("]")), F.when(F.col("affordance").isNotNull(), F.concat(F.lit("# affordance: "), "affordance")),
        F.when(F.size("tags") > 0, F.concat(F.lit("# tags: "), F.array_join("tags", ", "))),
        F.concat(F.lit("# accuracy: "), F.format_number(F.col("accuracy") * 100, 0), F.lit("%")),
        F.concat(F.lit('palette = "'), "palette", F.lit('"')), F.concat(F.lit('size = "'), "size", F.lit('"')), F.concat(F.lit("grid = '''\n"), "grid", F.lit("\n'''")))
    return head.unionByName(pal).unionByName(entries.select("palette", F.lit(2).alias("part"), F.col("name").alias("ord"), body.alias("text")))


def write_stamp_text(entries: DataFrame, palette: DataFrame, path: str) -> None:
    t = stamp_text(entries, palette)
    t.repartitionByRange("palette", "part", "ord").sortWithinPartitions("palette", "part", "ord").select("text").write.mode("overwrite").text(path)
