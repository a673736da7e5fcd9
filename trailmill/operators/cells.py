"""Attribute rows resolved to one typed value per event and property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import exactly
from .paths import piled_keys

#: Registered properties that may be sent to all tasks: ids of 8 bits.
MOST_PROPERTIES = 256
#: Blanks of any kind at either end of a text.
BLANKS = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"
WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
VALUES = {"Int": "int_value", "Float": "float_value", "Boolean": "boolean_value", "String": "string_value"}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def typed_columns(kind: Column) -> dict[str, Column]:
    """``v_int, v_float, v_bool, v_str`` of a row, read as the registered type ``kind``.

    At most one is filled; all are null if the row is not readable.  Numbers
    that do not fit the type (an integer beyond 64 bits, a decimal beyond the
    range of doubles) are not readable.  Should several value columns be
    filled, the column of the registered type comes first.
    """
    text = F.regexp_replace("string_value", BLANKS, "")
    i, f, b, s = (F.col(VALUES[k]) for k in ("Int", "Float", "Boolean", "String"))
    whole = F.when(_finite(f) & (f == F.floor(f)) & (f >= -(2.0**63)) & (f < 2.0**63), f.cast("decimal(20,0)").try_cast("long"))
    as_int = F.coalesce(i, whole, F.when(s.isNotNull() & text.rlike(WHOLE), text.try_cast("long")))
    number = F.when(s.isNotNull() & text.rlike(DECIMAL), text.try_cast("double"))
    as_float = F.coalesce(F.when(_finite(f), f), i.cast("double"), F.when(_finite(number), number)) + F.lit(0.0)
    low = F.lower(text)
    as_bool = F.coalesce(
        b,
        F.when(i.isin(0, 1), i == 1),
        F.when(s.isNotNull() & low.isin("true", "yes", "1"), F.lit(True)).when(s.isNotNull() & low.isin("false", "no", "0"), F.lit(False)),
    )
    as_str = F.coalesce(s, i.cast("string"), F.when(b, "true").when(~b, "false"))
    return {
        "v_int": F.when(kind == "Int", as_int),
        "v_float": F.when(kind == "Float", as_float),
        "v_bool": F.when(kind == "Boolean", as_bool),
        "v_str": F.when(kind == "String", as_str),
    }


def registered(event_data: DataFrame, properties: DataFrame, objects_only: bool = False) -> DataFrame:
    """Attribute rows of registered keys with the registered type ``kind``.

    Rows without event or with a key nobody registered are left out.  Copies of
    the rows of an event that has very many are dropped before any shuffle.  The
    registry is broadcast: ids have 8 bits, and the size is checked.
    """
    p = exactly(properties, "id", "data_type").where(F.col("id").isNotNull() & (F.col("id") > 0 if objects_only else F.lit(True)))
    table = p.groupBy("id").agg(F.min("data_type").alias("kind")).select(F.col("id").alias("key"), "kind").limit(MOST_PROPERTIES + 1).collect()
    if len(table) > MOST_PROPERTIES:
        raise ValueError(f"more than {MOST_PROPERTIES} registered properties")
    small = event_data.sparkSession.createDataFrame(table, "key int, kind string")
    rows = exactly(event_data, "event_id", "idx", "key", "data_type", *VALUES.values())
    piled = piled_keys(rows, "event_id")
    rows = rows.where(F.col("event_id").isNotNull())
    if piled:
        rows = rows.where(~F.col("event_id").isin(piled)).unionByName(rows.where(F.col("event_id").isin(piled)).distinct())
    return rows.join(F.broadcast(small), "key")


def readable_cells(event_data: DataFrame, properties: DataFrame) -> DataFrame:
    """Distinct ``event_id, key`` of object properties that have a value; partitioned by event."""
    rows = registered(event_data, properties, objects_only=True)
    v = typed_columns(F.col("kind"))
    ok = F.coalesce(*(c.isNotNull() & F.lit(True) for c in [F.coalesce(v["v_int"].cast("string"), v["v_float"].cast("string"), v["v_bool"].cast("string"), v["v_str"])]))
    return rows.where(ok).select("event_id", "key").repartition("event_id").distinct()


def cells(event_data: DataFrame, properties: DataFrame, objects_only: bool = False) -> DataFrame:
    """One row per cell: ``event_id, key, kind, v_int, v_float, v_bool, v_str, status``.

    The value is that of the readable row with the highest ``idx`` (a missing
    ``idx`` comes first; equal ones are taken by label and content, so copies
    and ties give one defined row).  ``status`` is ``rejected`` without a
    readable row, ``repaired`` if the row is not labelled exactly with the
    registered type or does not hold the value in that type's column, else
    ``ok``.  Partitioned by event, so joins on ``event_id`` follow without a
    shuffle.
    """
    rows = registered(event_data, properties, objects_only)
    rows = rows.withColumns(typed_columns(F.col("kind")))
    readable = F.coalesce(F.col("v_int").isNotNull() | F.col("v_float").isNotNull() | F.col("v_bool").isNotNull() | F.col("v_str").isNotNull(), F.lit(False))
    own = F.when(F.col("kind") == "Int", F.col("int_value").isNotNull()).when(F.col("kind") == "Float", F.col("float_value").isNotNull()).when(F.col("kind") == "Boolean", F.col("boolean_value").isNotNull()).otherwise(F.col("string_value").isNotNull())
    plain = F.coalesce((F.col("data_type") == F.col("kind")) & own, F.lit(False))
    rows = rows.select(
        "event_id", "key", "kind", "idx", "v_int", "v_float", "v_bool", "v_str",
        F.when(~readable, "rejected").when(plain, "ok").otherwise("repaired").alias("status"),
    ).repartition("event_id")
    best = Window.partitionBy("event_id", "key").orderBy(
        (F.col("status") == "rejected"), F.col("idx").desc_nulls_last(), "status", "v_int", "v_float", "v_bool", "v_str"
    )
    return rows.withColumn("_before", F.lag(F.lit(1)).over(best)).where(F.col("_before").isNull()).drop("_before", "idx")
