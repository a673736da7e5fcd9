"""Events as a stream: append to tables, running counts, features kept up, sessions with late data."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import flat_features, update_features
from ..session import file_system, intermediate_tables
from ..sources.catalog import Table


def append_stream(table: Table, stream: DataFrame, checkpoint: str, available_now: bool = True):
    """Append every micro-batch of events to a table; rejected rows are dropped.

    A batch that is run again after a failure takes the place of what it wrote
    before: its folder is named after the checkpoint and its number.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, f"{name}-{number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Events per action so far; output mode ``complete`` or ``update``."""
    return stream.groupBy("action_id").agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose features, which are written last, are complete."""
    fs, p = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    whole = lambda n: fs.exists(file_system(spark, f"{path}/{n}/features/_SUCCESS")[1])
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and whole(n))


def keep_features(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Bring a feature table up to date with every micro-batch of deliveries (see ``update_features``).

    Each batch writes a version under ``path`` from the one before it; a batch
    that is run again writes the same version again.  The last two are kept.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [v for v in _versions(spark, path) if v < number]
        state = tuple(spark.read.parquet(f"{path}/v{done[-1]}/{name}") for name in ("features", "firsts")) if done else None
        with intermediate_tables(spark):
            features, firsts = update_features(batch, state)
            firsts.write.mode("overwrite").parquet(f"{path}/v{number}/firsts")
            features.write.mode("overwrite").parquet(f"{path}/v{number}/features")
        for old in done[:-1]:
            fs, p = file_system(spark, f"{path}/v{old}")
            fs.delete(p, True)

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table after the last micro-batch: ``object_id, action_id, n, last_ts, last_event_id``."""
    return flat_features(spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}/features"))


def stream_sessions(stream: DataFrame, time: str = "timestamp", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of objects as they close, with events up to ``late`` behind the watermark.

    Spark ends a session ``gap`` after its last event, so events exactly
    ``gap`` apart begin a new one, unlike in ``operators.sessions``.
    """
    s = F.session_window(time, gap)
    counted = stream.withWatermark(time, late).groupBy("object_id", s.alias("session")).agg(F.count("*").alias("n_events"))
    return counted.select("object_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_events")


def read_events(spark: SparkSession, directory: str, name: str, schema) -> DataFrame:
    """A stream over the Parquet files of a table ``name`` in a directory."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)
