"""Kinds and data types of properties."""

from __future__ import annotations

from pyspark.sql import types as T

OBJECT, ACTION = "object", "action"
DATA_TYPES: dict[str, T.DataType] = {"Int": T.LongType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(), "String": T.StringType()}
ZERO = {"Int": 0, "Float": 0.0, "Boolean": False, "String": ""}
#: Range of property ids: object properties count up from 1, action properties down from -1.
MOST_OBJECT, MOST_ACTION = 127, -128
MOST_ACTION_ID = 65_535


def kind_of(property_id: int) -> str:
    return OBJECT if property_id > 0 else ACTION
