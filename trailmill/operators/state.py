"""State of objects at their events, and steps between actions.

Events are rows ``object_id, ts (microseconds), seq, action_id`` with a typed,
nullable column per property; null means that the event does not set it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import ZERO
from .paths import Slicing


def order(tie_break: str = "lifo") -> list[Column]:
    """Time order; of equal times the later arrival comes first (``lifo``) or last (``fifo``)."""
    if tie_break not in ("lifo", "fifo"):
        raise ValueError(f"unknown tie break: {tie_break}")
    return [F.col("ts"), F.col("seq").desc_nulls_last() if tie_break == "lifo" else F.col("seq").asc_nulls_first()]


def _rank(tie_break: str) -> Column:
    no = F.coalesce(-F.col("seq"), F.lit(2**63 - 1)) if tie_break == "lifo" else F.coalesce(F.col("seq"), F.lit(-(2**63) + 1))
    return F.struct(F.col("ts"), no.alias("no"))


def with_state(events: DataFrame, sticky: dict[str, str], transient: dict[str, str], tie_break: str = "lifo", slicing: Slicing | None = None) -> DataFrame:
    """Events with object properties as they stand and action properties of the event.

    ``sticky`` and ``transient`` map columns to data types.  A sticky property
    keeps its last value along the path, a transient one counts only on its
    event; without value either is its type's zero.  Without sticky
    properties nothing is shuffled.

    Filters on anything but ``object_id`` belong after this operator: a row
    left out before it may carry a value that later rows inherit.
    """
    slicing = slicing or Slicing()
    out = events
    if sticky:
        out = slicing.add(out)
        if slicing:
            rank = _rank(tie_break)
            out = slicing.carry(
                out, ["object_id"],
                [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c in sticky],
                lambda w: [F.last(f"_last_{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{c}") for c in sticky],
            )
        path = Window.partitionBy("object_id", "slice").orderBy(*order(tie_break)).rowsBetween(Window.unboundedPreceding, 0)
        kept = {c: F.coalesce(F.last(c, ignorenulls=True).over(path), *([F.col(f"_before_{c}")] if slicing else []), F.lit(ZERO[t])) for c, t in sticky.items()}
        out = out.withColumns(kept).drop("slice", *(f"_before_{c}" for c in sticky))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(ZERO[t])) for c, t in transient.items()}) if transient else out


def with_previous(events: DataFrame, columns: dict[str, Column], tie_break: str = "lifo", slicing: Slicing | None = None) -> DataFrame:
    """Events with what expressions, which must not be null, were at the event before in the path; null at the first."""
    slicing = slicing or Slicing()
    e = slicing.add(events).withColumns({f"_own_{c}": v for c, v in columns.items()})
    if slicing:
        rank = _rank(tie_break)
        e = slicing.carry(
            e, ["object_id"], [F.max_by(f"_own_{c}", rank).alias(f"_end_{c}") for c in columns], lambda w: [F.lag(f"_end_{c}").over(w).alias(f"_before_{c}") for c in columns]
        )
    path = Window.partitionBy("object_id", "slice").orderBy(*order(tie_break))
    before = {c: F.coalesce(F.lag(f"_own_{c}").over(path), *([F.col(f"_before_{c}")] if slicing else [])) for c in columns}
    return e.withColumns(before).drop("slice", *(f"_own_{c}" for c in columns), *(f"_before_{c}" for c in columns))


def state_at(events: DataFrame, at: int, sticky: dict[str, str], tie_break: str = "lifo") -> DataFrame:
    """One row per object: its object properties as they stood at time ``at`` (microseconds).

    Objects without event up to then have no row.  Aggregated per task before
    the shuffle, so a hot object is no burden.
    """
    rank = _rank(tie_break)
    found = [F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), rank)), F.lit(ZERO[t])).alias(c) for c, t in sticky.items()]
    return events.where(F.col("ts") <= at).groupBy("object_id").agg(*found)


def transitions(events: DataFrame, tie_break: str = "lifo", slicing: Slicing | None = None) -> DataFrame:
    """How often each action follows each other directly in a path: ``prev_action_id, action_id, n``.

    The sparse form of the matrix of steps; events without action take part as action 0.
    """
    slicing = slicing or Slicing()
    e = slicing.add(events.select("object_id", "ts", "seq", F.coalesce("action_id", F.lit(0)).alias("action_id")))
    before = F.lag("action_id").over(Window.partitionBy("object_id", "slice").orderBy(*order(tie_break)))
    if slicing:
        e = slicing.carry(
            e, ["object_id"], [F.max_by("action_id", _rank(tie_break)).alias("_last")], lambda w: [F.lag("_last").over(w).alias("_before")]
        )
        before = F.coalesce(before, F.col("_before"))
    return e.withColumn("prev_action_id", before).where(F.col("prev_action_id").isNotNull()).groupBy("prev_action_id", "action_id").agg(F.count("*").alias("n"))


def action_statistics(events: DataFrame, column: str) -> DataFrame:
    """Least, greatest and mean value of a property per action, of the events that set it."""
    value = F.col(column)
    return events.where(value.isNotNull()).groupBy("action_id").agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def path_lengths(events: DataFrame) -> DataFrame:
    """Number of events, first and last time of every path."""
    return events.groupBy("object_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
