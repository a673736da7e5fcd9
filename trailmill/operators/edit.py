"""Changes to sets of events, and scans of paths.

Tables are only appended to; these operators give changed DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import Slicing
from .state import order

IDENTITY = ["object_id", "ts", "seq"]


def insert_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """Events of both; one that is there already, by object, time and arrival, is not added again.

    Missing columns of either side become null.
    """
    added = new.join(events.select(*IDENTITY), IDENTITY, "left_anti").dropDuplicates(IDENTITY)
    return events.unionByName(added, allowMissingColumns=True)


def remove_events(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events without those named by object, time and arrival."""
    return events.join(gone.select(*IDENTITY), IDENTITY, "left_anti")


def set_property(events: DataFrame, name: str, value: object, where: Column) -> DataFrame:
    """A property's value replaced, or added, on some events; its type stays."""
    kind = events.schema[name].dataType if name in events.columns else None
    new = F.lit(value).cast(kind) if kind else F.lit(value)
    return events.withColumn(name, F.when(where, new).otherwise(F.col(name) if kind else F.lit(None)))


def unset_property(events: DataFrame, name: str, where: Column) -> DataFrame:
    """A property taken from some events, which then no longer set it."""
    return events.withColumn(name, F.when(~F.coalesce(where, F.lit(False)), F.col(name)))


def scan_paths(events: DataFrame, tie_break: str = "lifo", slicing: Slicing | None = None) -> DataFrame:
    """Events with their ``position`` in the path, from 1."""
    slicing = slicing or Slicing()
    e = slicing.add(events)
    position = F.row_number().over(Window.partitionBy("object_id", "slice").orderBy(*order(tie_break))).cast("long")
    if slicing:
        e = slicing.carry(e, ["object_id"], [F.count("*").alias("_n")], lambda w: [F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_n0")])
        return e.withColumn("position", position + F.coalesce("_n0", F.lit(0))).drop("slice", "_n0")
    return e.withColumn("position", position).drop("slice")


def scan_block(events: DataFrame, objects: tuple[int, int], times: tuple[int, int]) -> DataFrame:
    """Events of a block: a range of objects and one of times, both ends included.

    The bounds are plain comparisons, so files and row groups outside of them
    are not read; a table clustered by object and time reads little else.
    """
    return events.where(F.col("object_id").between(*objects) & F.col("ts").between(*times))


def file_ranges(events: DataFrame) -> DataFrame:
    """Objects and times that each file holds, as its statistics tell a reader."""
    return events.groupBy(F.input_file_name().alias("file")).agg(
        F.min("object_id").alias("min_object_id"), F.max("object_id").alias("max_object_id"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n")
    )
