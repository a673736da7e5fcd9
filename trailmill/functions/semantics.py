"""Arithmetic and casts of path programs as Spark columns.

Integers have 64 bits and wrap; their division truncates and by zero gives
0.  The right operand is cast to the type of the left one.  Expressions
must be built inside ``wrapping``, which turns off Spark's overflow errors for
what is built there.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans analysed inside use wrapping integers; an expression keeps the mode it was analysed in."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def int_divide(a: Column, b: Column) -> Column:
    """Quotient towards zero; 0 where ``b`` is 0."""
    return F.when(b == -1, -a).when(b != 0, F.call_function("div", a, b)).otherwise(0)


def float_divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, by_zero).otherwise(a / b)


def float_equal(a: Column, b: Column) -> Column:
    """Ordered equality: NaN equals nothing."""
    return (a == b) & ~F.isnan(a)


def cast(value: Column, source: str, target: str) -> Column:
    """Implicit casts: decimals are cut off, a Boolean is the lowest bit of a number."""
    if source == target:
        return value
    if target == "Boolean":
        return value.cast("long").bitwiseAND(1) == 1
    if target == "Int":
        return value.cast("long")
    if target == "Float":
        return value.cast("long").cast("double") if source == "Boolean" else value.cast("double")
    raise TypeError(f"no cast from {source} to {target}")


def binary(op: str, a: Column, b: Column, kind: str) -> Column:
    """``a op b`` for operands of the same type ``kind``."""
    if op == "==":
        return float_equal(a, b) if kind == "Float" else a == b
    if op == "/":
        return float_divide(a, b) if kind == "Float" else int_divide(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def now_micros() -> Column:
    """Microseconds at which the query runs, the same in all its rows."""
    return F.unix_micros(F.current_timestamp())


def iso_micros(text: Column) -> Column:
    """Microseconds of times like ``2010-01-02T10:30:20Z`` (whole seconds, session in UTC); null if not of that form."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.unix_micros(F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))
