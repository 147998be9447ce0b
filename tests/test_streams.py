"""Versioned results and late data of the streams."""

import os

import pytest
from pyspark.sql import functions as F

from gridweave.streaming import feedback
from gridweave.streaming.versions import Versions


def folders(path):
    return {n for n in os.listdir(path) if n.startswith("v=")}


def test_versions_commit_replay_and_retention(spark, tmp_path):
    log = Versions(spark, str(tmp_path / "t"), keep=3)
    with pytest.raises(FileNotFoundError):
        log.read()
    for n in range(1, 51):
        log.write(spark.range(n).coalesce(1), n)
        assert len(folders(log.path)) <= 3
    assert log.numbers() == [48, 49, 50] and log.read().count() == 50
    log.write(spark.range(999), 50)  # a replay of what is committed
    assert log.read().count() == 50
    spark.range(7).write.parquet(f"{log.path}/v=51")  # a crash between write and commit
    assert log.newest() == 50 and log.read().count() == 50
    log.write(spark.range(51).coalesce(1), 51)
    assert log.read().count() == 51 and folders(log.path) == {"v=49", "v=50", "v=51"}


def test_late_events_and_bounded_state(spark, tmp_path):
    """Closed windows leave the state and stay in the table; events behind the watermark are not counted."""
    def put(n, rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, tileset_id int, action string, reject_reason string, style_score double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/f={n}"))

    def run():
        schema = "event_id long, ts timestamp, tileset_id int, action string, reject_reason string, style_score double"
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        s = feedback.fb_stream_stats(s, ["tileset_id"], "1 hour").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tileset_id", "accepts")
        q = feedback.write_latest(s, str(tmp_path / "out"), str(tmp_path / "cp"), ["day", "tileset_id"])
        q.awaitTermination()
        return q.recentProgress

    event = lambda i, ts: (i, ts, 1 if i % 2 else None, "accept", None, 0.5)
    put(1, [event(i, f"2024-01-0{i % 9 + 1} 10:00:00") for i in range(18)])
    first = run()
    put(2, [event(20, "2024-03-01 10:00:00"), event(21, "2024-03-01 11:00:00")])
    put(3, [event(22, "2024-01-01 10:00:00"), event(23, "2024-03-01 12:00:00")])
    later = run()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in [*first, *later] if p["stateOperators"]]
    assert max(states) >= 18 and states[-1] <= 2
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in later) >= 1
    got = {(r.day, r.tileset_id): r.accepts for r in Versions(spark, str(tmp_path / "out")).read().collect()}
    assert len(got) == 20 and got["2024-01-01", None] == 1 and got["2024-03-01", 1] == 2 and got["2024-03-01", None] == 1
    assert run() == [] or Versions(spark, str(tmp_path / "out")).read().count() == 20  # nothing new changes nothing
    assert len(folders(tmp_path / "out")) <= 3
