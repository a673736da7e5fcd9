"""Synthetic paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_events(spark: SparkSession, paths: int = 100, average_events: int = 10, actions: int = 100, seed: int = 0) -> DataFrame:
    """Random events: each path has 1 to ``2 * average_events - 1`` of them, with actions 1 to ``actions``.

    A seed gives the same events at any parallelism, as numbers come from
    hashes of path and place.
    """
    pick = lambda most, *salt: F.pmod(F.xxhash64(*salt, F.lit(seed)), F.lit(most))
    per_path = spark.range(1, paths + 1).withColumnRenamed("id", "object_id")
    n = pick(2 * average_events - 1, F.col("object_id"), F.lit("n")) + 1
    events = per_path.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return events.select(
        "object_id",
        pick(2**62, F.col("object_id"), F.col("i"), F.lit("t")).alias("ts"),
        (F.col("object_id") * (2 * average_events) + F.col("i")).alias("seq"),
        (pick(actions, F.col("object_id"), F.col("i"), F.lit("a")) + 1).cast("int").alias("action_id"),
    )
