"""Top-k, deterministic order and exact global rank without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(seed: int | str, *ids: Column) -> Column:
    """Deterministic pseudo-random text: md5 of seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def draw_int(seed: int | str, *ids: Column, bits: int = 32) -> Column:
    return F.conv(F.substring(draw(seed, *ids), 1, bits // 4), 16, 10).cast("bigint")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank",
          salts: int = 32) -> DataFrame:
    """First ``k`` rows per group by ``order`` (make it total), exact under skew.

    Two rounds: each group is first reduced inside ``salts`` sub-groups, so a
    hot group never sorts in one task; the second round sees at most
    ``salts * k`` rows per group.  Without salts only the second round runs: that
    is enough where groups lie over all tasks, as each task then sends its own
    first ``k`` rows of a group and no others.
    """
    last = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    if salts <= 1:
        return df.withColumn(rank, last).where(F.col(rank) <= k)
    salt = F.pmod(F.xxhash64(*[F.struct(*df.columns)]), F.lit(salts))
    first = W.partitionBy(*by, "_salt").orderBy(*order)
    part = df.withColumn("_salt", salt).withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
    return (
        part.drop(rank, "_salt")
        .withColumn(rank, last)
        .where(F.col(rank) <= k)
    )


def exact_rank(df: DataFrame, key: Column, tie: list[str], rank: str = "rank", digits: int = 3) -> DataFrame:
    """Global 1-based rank by a hex digest, plus ``n`` rows in all.

    The digest is cut into ``16**digits`` near-equal buckets.  Bucket offsets
    come from a table of at most that many rows; rows are only sorted inside
    their own bucket.
    """
    d = df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, digits))
    counts = d.groupBy("_b").agg(F.count("*").alias("_c"))
    # Fixed size: 16**digits rows whatever the data, so one sorted partition is fine.
    w = W.partitionBy(F.lit(0)).orderBy("_b")
    offsets = counts.select(
        "_b", (F.sum("_c").over(w) - F.col("_c")).alias("_off"),
        F.sum("_c").over(W.partitionBy(F.lit(0))).alias("n"))
    inner = F.row_number().over(W.partitionBy("_b").orderBy("_k", *tie))
    return (
        d.withColumn("_r", inner).join(F.broadcast(offsets), "_b")
        .withColumn(rank, F.col("_off") + F.col("_r")).drop("_k", "_b", "_r", "_off")
    )


def next_in_order(df: DataFrame, by: list[str], key: str, width: int, out: str = "next") -> DataFrame:
    """Each row's next larger ``key`` of its group as ``out`` (null for the last); keys are distinct integers.

    Keys are sorted inside ranges of ``width`` only.  The last of a range takes
    the first key of the group's next range, from a table with a row per range,
    so a group of any size is many tasks' work.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    inside = F.lead(key).over(W.partitionBy(*by, "_range").orderBy(key))
    firsts = ranged.groupBy(*by, "_range").agg(F.min(key).alias("_first"))
    after = firsts.select(*by, "_range", F.lead("_first").over(W.partitionBy(*by).orderBy("_range")).alias("_after"))
    return ranged.withColumn("_in", inside).join(after, [*by, "_range"]).withColumn(out, F.coalesce("_in", "_after")).drop("_in", "_after", "_range")
