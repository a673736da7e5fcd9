"""Valid events, path order, and slices that keep long paths out of one task.

A *path* is the sequence of one object's valid events by time, equal times
with the later delivery first.  Windows over paths partition by
``(object_id, slice)``: nearly every object has the single slice 0, an object
with more rows than ``slice_rows`` is cut at times that split its rows evenly,
and the slices are numbered upwards from 1.  Cuts lie between different times,
so events of equal time stay together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, exactly, prepare, small_or_stored, stored

#: Rows of one object that a single window partition may hold.
SLICE_ROWS = 1_000_000
#: Slices that a path, or a slice of it, is cut into at a time.
FAN = 64
#: Times a slice that is still too long is cut again; numbers of slices then still fit a long.
MOST_LEVELS = 9
#: Rows of one key that may travel through a shuffle, and how often such a key stands in the sample that finds it.
PILE_ROWS, PILE_LEAST = 1_000_000, 50
#: Rows that the sample has at least.
PILE_SAMPLE = 100_000
#: Piled keys that are named in a plan; if there are more, all keys are reduced.
MOST_PILES = 10_000


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session in UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def piled_keys(rows: DataFrame, key: str) -> list[int] | None:
    """Values of ``key`` so frequent that their rows must be reduced before a shuffle by it; None if there are very many.

    Those with more than ``PILE_ROWS`` rows are looked for in a sample in which
    each is expected ``2 * PILE_LEAST`` times, however large the table is.  It
    only decides how rows travel; results do not depend on it.
    """
    total = rows.count()  # answered from Parquet footers
    if total <= PILE_ROWS:
        return []
    share = min(1.0, max(PILE_SAMPLE / total, 2 * PILE_LEAST / PILE_ROWS))
    sample = rows.select(key).sample(share, seed=1).where(F.col(key).isNotNull())
    found = sample.groupBy(key).count().where(F.col("count") >= PILE_LEAST).select(key).limit(MOST_PILES + 1).collect()
    return [r[0] for r in found] if len(found) <= MOST_PILES else None


def first_deliveries(rows: DataFrame, piled: list[int] | None) -> DataFrame:
    """``rows`` (``event_id, object_id, ts, seq, action_id``) with only the first delivery of the events in ``piled``, or of all if it is None."""
    if piled == []:
        return rows
    order = [c for n in ("seq", "ts", "object_id", "action_id") for c in (F.col(n).isNull().alias(f"no_{n}"), F.col(n))]
    many = rows if piled is None else rows.where(F.col("event_id").isin(piled))
    first = many.groupBy("event_id").agg(F.min(F.struct(*order)).alias("r")).select("event_id", "r.object_id", "r.ts", "r.seq", "r.action_id")
    return first if piled is None else rows.where(~F.col("event_id").isin(piled)).unionByName(first)


def valid_events(events: DataFrame) -> DataFrame:
    """``event_id, object_id, ts, seq, action_id`` of every valid event.

    Of the deliveries of an ``event_id`` the one with the lowest ``seq``
    counts (a missing ``seq`` comes after all others; equal ones are taken by
    time, object and action, so the result is defined).  It is dropped if its
    object is missing or not above 0, or its time is missing; the other
    deliveries never take its place.  Rows without ``event_id`` are no events.
    Events delivered so often that they would fill a task are reduced before
    the shuffle.  Columns beyond those needed are ignored; an empty table gives
    an empty result.
    """
    prepare(events.sparkSession)
    events = exactly(events, "event_id", "object_id", "timestamp", "seq", "action_id")
    rows = events.where(F.col("event_id").isNotNull()).select(
        "event_id", "object_id", micros("timestamp").alias("ts"), "seq", "action_id"
    )
    rows = first_deliveries(rows, piled_keys(events, "event_id"))
    deliveries = Window.partitionBy("event_id").orderBy(
        F.col("seq").asc_nulls_last(), F.col("ts").asc_nulls_last(), F.col("object_id").asc_nulls_last(), F.col("action_id").asc_nulls_last()
    )
    # A row without a predecessor is the first; unlike row_number() = 1 this
    # adds no second sort before the shuffle, which unique ids would not repay.
    return (
        rows.withColumn("_earlier", F.lag(F.lit(1)).over(deliveries))
        .where(F.col("_earlier").isNull() & (F.col("object_id") > 0) & F.col("ts").isNotNull())
        .drop("_earlier")
    )


def path_order() -> list[Column]:
    """Order of events within a path; ``event_id`` only separates equal ``seq``."""
    return [F.col("ts"), F.col("seq").desc_nulls_last(), F.col("event_id")]


@dataclass
class Slicing:
    """Cut times of the paths that are too long for one task.

    Each level is a table ``object_id, slice, cuts``: what was one slice so far
    is cut at these times, ``FAN - 1`` at most.  ``slices`` is how many there
    are in the end.
    """

    levels: list[tuple[DataFrame, bool]] = field(default_factory=list)
    slices: int = 0

    def __bool__(self) -> bool:
        return bool(self.levels)

    def add(self, df: DataFrame, time: str = "ts", into: str = "slice") -> DataFrame:
        """``df`` (with ``object_id`` and ``time``) and its slice: 0 of a short path, from 1 in order of time of a long one."""
        number = F.lit(0).cast("long")
        for i, (cuts, small) in enumerate(self.levels):
            df = df.withColumn("_at", number)
            cuts = cuts.withColumnRenamed("slice", "_at")
            df = df.join(F.broadcast(cuts) if small else cuts, ["object_id", "_at"], "left")
            part = F.size(F.filter("_cuts", lambda c: c <= F.col(time))).cast("long")
            here = F.when(F.col("_cuts").isNotNull(), part + (1 if i == 0 else 0)).otherwise(0)
            df = df.withColumn(into, F.col("_at") * FAN + here).drop("_at", "_cuts")
            number = F.col(into)
        return df if self else df.withColumn(into, number)

    def bounded(self, df: DataFrame, rows_a_slice: int = 1) -> DataFrame:
        """A table of at most ``rows_a_slice`` rows per slice, to be sent to all tasks if that is few.

        Else it is joined by a shuffle: by object and slice, no key has more
        rows than a slice.
        """
        return F.broadcast(df) if self.slices * rows_a_slice <= SMALL_ROWS else df

    def carry(self, df: DataFrame, keys: list[str], aggs: list[Column], over: Callable[[Window], list[Column]], rows_a_slice: int = 1) -> DataFrame:
        """Join to ``df`` what a slice must know of its object's other slices.

        ``aggs`` sum up each slice of a long path, ``over`` gives columns of a
        window over an object's slices in time order.  The joined table has one
        row per slice (and further key) of a long path; short paths get nulls.
        """
        per = df.where(F.col("slice") > 0).groupBy(*keys, "slice").agg(*aggs)
        slices = Window.partitionBy(*keys).orderBy("slice")
        return df.join(self.bounded(per.select(*keys, "slice", *over(slices)), rows_a_slice), [*keys, "slice"], "left")


def plan_slices(events: DataFrame, slice_rows: int | None = None, time: str = "timestamp") -> Slicing:
    """Find the objects with more than ``slice_rows`` rows (default ``SLICE_ROWS``), and their cut times.

    ``time`` is a timestamp, or a number of microseconds.  Rows are counted and
    cut with map-side aggregation over two columns.  A path is cut into up to
    ``FAN`` slices at approximate quantiles; where that leaves more than
    ``slice_rows``, the slices are counted and cut again.  Each level of cuts
    is handed over by the driver if it is small, else written to the shared
    folder.  Only rows of one object and the very same time are never parted.
    """
    prepare(events.sparkSession)
    slice_rows = SLICE_ROWS if slice_rows is None else slice_rows
    events = exactly(events, "object_id", time)
    if events.count() <= slice_rows:  # answered from Parquet footers
        return Slicing()
    at = F.col(time) if dict(events.dtypes)[time] == "bigint" else micros(time)
    rows = events.where(F.col("object_id").isNotNull() & F.col(time).isNotNull()).select("object_id", at.alias("ts"))
    found = Slicing()
    quantiles = [i / FAN for i in range(1, FAN)]
    parts = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / slice_rows).cast("int"))
    chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("q", F.round(i * FAN / parts).cast("int") - 1))
    for _ in range(MOST_LEVELS):
        nodes = found.add(rows)
        crowded, small = small_or_stored(nodes.groupBy("object_id", "slice").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows))
        most = crowded.agg(F.max("n")).first()[0]
        if most is None:
            break
        crowd = nodes.join(F.broadcast(crowded) if small else crowded, ["object_id", "slice"])
        cut = crowd.groupBy("object_id", "slice", "n").agg(F.percentile_approx("ts", quantiles, 16 * FAN).alias("q"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        level, small = small_or_stored(cut.where("lo < hi").select("object_id", "slice", F.array_distinct(chosen).alias("_cuts")))
        new = level.agg(F.sum(F.size("_cuts") + 1)).first()[0]
        if new is None:
            break
        found = Slicing([*found.levels, (level, small)], found.slices + new)
        if most <= FAN // 2 * slice_rows:
            break
    return found


def sliced_events(events: DataFrame, slicing: Slicing, actions_only: bool = False) -> DataFrame:
    """Valid events with their slice; ``actions_only`` leaves out events without action first.

    Where paths are sliced, the events are written to the shared folder: their
    slices are summed up and gone through, and neither should find them anew.
    """
    found = valid_events(events)
    if actions_only:
        found = found.where(F.col("action_id") > 0)
    found = slicing.add(found)
    return stored(found)[0] if slicing else found
