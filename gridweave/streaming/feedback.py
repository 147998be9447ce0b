"""Streaming feedback: running statistics and an incremental style fingerprint."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.feedback import stats_columns
from gridweave.operators.style import latent_from_sums, symbol_sums, tile_sums
from gridweave.streaming.versions import Versions


def fb_stream_stats(stream: DataFrame, by: list[str], watermark: str | None = None, window: str = "1 day") -> DataFrame:
    """Running counts, acceptance and mean scores per group.

    With a watermark the aggregate is per tumbling window of ``ts``, so state
    is bounded by the open windows; without one it is per group for all time.
    """
    if watermark is None:
        return stream.groupBy(*by).agg(*stats_columns())
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window), *by).agg(*stats_columns())


def write_latest(result: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Run to the end of the input, keeping the latest row of every key as a versioned table.

    Batches bring the groups that changed (``update``), so under a watermark the
    state of closed windows is dropped while their rows stay in the table.  A
    batch writes a version from the one before it and commits it in one step.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        log = Versions(batch.sparkSession, path)
        number = batch_id + 1
        if number in log.numbers():
            return
        batch = batch.persist()
        older = log.newest(number)
        if older is None:
            log.write(batch, number)
        else:
            old, new = log.read(older).alias("old"), batch.select(*keys).distinct().alias("new")
            same = reduce(and_, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
            log.write(batch.unionByName(old.join(new, same, "left_anti")), number)
        batch.unpersist()

    return (result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def fb_stream_style(stream: DataFrame, tiles: DataFrame, by: list[str], state_path: str, checkpoint: str):
    """Fold accepted grids into mergeable sums, one partial per micro-batch.

    A batch overwrites its own folder, so a replay after a failure is
    idempotent.  :func:`read_stream_style` merges the partials.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        # Repeated events on one tile fold to a count before the tile join.
        hits = batch.where("action IN ('accept', 'edit')").groupBy(*by, "tile_id").agg(F.count("*").alias("times"))
        t = tiles.select("tile_id", "grid").join(hits, "tile_id")
        keys = [*by, "times"]
        s = symbol_sums(t, keys).groupBy(*by, "sym").agg(
            F.sum(F.col("cells") * F.col("times")).alias("cells"), F.sum(F.col("pos_sum") * F.col("times")).alias("pos_sum"))
        c = tile_sums(t, keys).groupBy(*by).agg(*[F.sum(F.col(x) * F.col("times")).alias(x) for x in ("tiles", "cells", "runs", "breadth_sum")])
        s.write.mode("overwrite").parquet(f"{state_path}/symbols/batch={batch_id}")
        c.write.mode("overwrite").parquet(f"{state_path}/totals/batch={batch_id}")

    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fold).start())


def read_stream_style(spark, state_path: str, palette: DataFrame, by: list[str]) -> DataFrame:
    s = spark.read.parquet(f"{state_path}/symbols").groupBy(*by, "sym").agg(F.sum("cells").alias("cells"), F.sum("pos_sum").alias("pos_sum"))
    c = spark.read.parquet(f"{state_path}/totals").groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tiles", "cells", "runs", "breadth_sum")])
    return latent_from_sums(s, c, palette, by)
