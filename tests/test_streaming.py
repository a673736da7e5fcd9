"""Streams over files in small batches."""

import datetime

import pytest

import samples
from trailmill.operators.features import feature_table
from trailmill.session import exactly
from trailmill.sources.catalog import Database
from trailmill.streaming.running import _versions, append_stream, keep_features, kept_features, read_events, running_counts, stream_sessions

SCHEMA = "object_id long, timestamp timestamp, action_id int"
AT = datetime.datetime(2020, 1, 1)


def at(minute):
    return AT + datetime.timedelta(minutes=minute)


@pytest.fixture
def folder(spark, tmp_path):
    for i, rows in enumerate([[(1, at(0), 1), (1, at(10), 2)], [(1, at(100), 1), (2, at(5), 1)], [(1, at(20), 2), (0, at(1), 1), (9, at(60 * 24 * 30), 3)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}.parquet")
    return tmp_path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_append(spark, folder):
    table = Database(spark, f"file://{folder}/db").table("t")
    append_stream(table, stream(spark, folder), f"{folder}/c").awaitTermination()
    assert sorted((r.object_id, r.action_id) for r in table.events().collect()) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (9, 3)]
    assert len({r.seq for r in table.events().collect()}) == 6


def test_running_counts(spark, folder):
    job = running_counts(stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("rc").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    job.awaitTermination()
    assert {r.action_id: r.n for r in spark.table("rc").collect()} == {1: 4, 2: 2, 3: 1}


def test_sessions_with_late_events(spark, folder):
    found = stream_sessions(stream(spark, folder))
    job = found.writeStream.outputMode("append").format("memory").queryName("ss").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {(r.object_id, r.start): r.n_events for r in spark.table("ss").collect()}
    assert got[1, at(0)] == 3 and got[1, at(100)] == 1 and got[2, at(5)] == 1 and (9, at(60 * 24 * 30)) not in got


def test_features_are_kept(spark, tmp_path):
    rows = samples.events(seed=4)
    e = exactly(samples.frames(spark, rows, [])[0], "event_id", "object_id", "timestamp", "action_id", "seq")
    for i in range(3):
        e.where(f"coalesce(seq, 0) % 3 = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}.parquet")
    deliveries = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = f"file://{tmp_path}/features"
    keep_features(deliveries, path, f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, kept_features(spark, path).collect())) == sorted(map(tuple, feature_table(e).collect()))
    assert _versions(spark, path) == [1, 2]


def test_read_events(spark, folder):
    spark.range(3).write.parquet(f"{folder}/data/events.parquet")
    spark.range(5).write.parquet(f"{folder}/data/other.parquet")
    assert read_events(spark, f"{folder}/data", "events", "id long").isStreaming
