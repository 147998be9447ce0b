"""Streaming archive: merge each evaluated batch into the elites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.operators.dataset import elites, merge_elites
from gridweave.streaming.versions import Versions


def elite_stream(stream: DataFrame, archive_path: str, checkpoint: str, id_col: str = "map_id"):
    """Each batch writes version ``batch + 1`` from the version before it; old versions go.

    Versions are never changed in place: replaying a batch rewrites the same
    version from the same predecessor.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        log = Versions(batch.sparkSession, archive_path)
        older = log.newest(batch_id + 1)
        log.write(elites(batch, id_col) if older is None else merge_elites(log.read(older), batch, id_col), batch_id + 1)

    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start())


def read_elites(spark: SparkSession, archive_path: str) -> DataFrame:
    return Versions(spark, archive_path).read()
