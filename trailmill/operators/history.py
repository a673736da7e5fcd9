"""History of changing attributes: versions with their validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .cells import MOST_PROPERTIES, cells
from .paths import Slicing, path_order, plan_slices, valid_events

VALUE = ("v_int", "v_float", "v_bool", "v_str")


def diff_snapshots(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], kept: list[str] = ()) -> DataFrame:
    """Compare two snapshots: ``keys``, ``change`` and the ``values`` and ``kept`` columns of ``after``.

    A null-safe full outer join classifies each key as ``inserted`` (only
    after), ``deleted`` (only before), ``changed`` (values differ; two nulls
    are equal) or ``same``.  Null keys match each other.  Keys must be unique
    in either snapshot; columns beyond those named are ignored.
    """
    b = before.select(*(F.col(k).alias(f"_bk_{i}") for i, k in enumerate(keys)), *(F.col(v).alias(f"_bv_{i}") for i, v in enumerate(values)), F.lit(True).alias("_b"))
    a = after.select(*(F.col(k).alias(f"_ak_{i}") for i, k in enumerate(keys)), *values, *kept, F.lit(True).alias("_a"))
    on = [F.col(f"_bk_{i}").eqNullSafe(F.col(f"_ak_{i}")) for i in range(len(keys))]
    same = F.lit(True)
    for i, v in enumerate(values):
        same = same & F.col(v).eqNullSafe(F.col(f"_bv_{i}"))
    change = F.when(F.col("_b").isNull(), "inserted").when(F.col("_a").isNull(), "deleted").when(same, "same").otherwise("changed")
    joined = b.join(a, on, "full_outer").withColumn("change", change)
    return joined.select(*(F.when(F.col("_a"), F.col(f"_ak_{i}")).otherwise(F.col(f"_bk_{i}")).alias(k) for i, k in enumerate(keys)), "change", *values, *kept)


def snapshot_history(snapshots: DataFrame, number: str, keys: list[str], values: list[str]) -> DataFrame:
    """Validity of attribute versions from periodic full snapshots.

    ``number`` counts the snapshots 1, 2, 3, ... without holes.  Every snapshot
    is compared with the one before in a single join, by shifting numbers by
    one.  A key missing from a snapshot was deleted there, and a version ends
    with its key's deletion.

    Result: ``keys``, ``values``, ``valid_from`` and ``valid_to`` (snapshot
    numbers; ``valid_to`` null while valid).  Repeated rows must have been
    removed; an empty table gives no version.
    """
    last = snapshots.agg(F.max(number)).first()[0]
    shifted = snapshots.withColumn(number, F.col(number) + 1).where(F.col(number) <= F.lit(last))
    changes = diff_snapshots(shifted, snapshots, [*keys, number], values).where(F.col("change") != "same")
    following = Window.partitionBy(*keys).orderBy(number)
    return (
        changes.withColumn("valid_to", F.lead(number).over(following))
        .where(F.col("change") != "deleted")
        .select(*keys, *values, F.col(number).alias("valid_from"), "valid_to")
    )


def periodic_snapshots(log: DataFrame, period: int, kept: int) -> DataFrame:
    """Snapshots ``object_id, key, number, v_int, v_float, v_bool, v_str`` at the end of every period of ``period`` microseconds.

    A key stands in a snapshot with its last update in path order if that lies
    in the snapshot's period or the ``kept - 1`` before it; then it is deleted.
    Periods are numbered from 1970; ``log`` is as ``updates`` gives it.  Updates
    of one period are combined before the shuffle.
    """
    at = F.struct(F.col("ts"), F.coalesce(-F.col("seq"), F.lit(2**63 - 1)).alias("no"), F.col("event_id"))
    number = F.call_function("div", F.col("ts") - F.pmod("ts", F.lit(period)), F.lit(period))  # rounds down, also before 1970
    ends = log.groupBy("object_id", "key", number.alias("number")).agg(F.max_by(F.struct(*VALUE), at).alias("v"))
    following = F.lead("number").over(Window.partitionBy("object_id", "key").orderBy("number"))
    until = F.least(F.col("number") + (kept - 1), F.coalesce(following - 1, F.col("number") + (kept - 1)))
    return ends.withColumn("until", until).select("object_id", "key", F.explode(F.sequence("number", "until")).alias("number"), "v.*")


def updates(events: DataFrame, event_data: DataFrame, properties: DataFrame) -> DataFrame:
    """Cells with a value, of valid events and object properties, with object and time."""
    have = cells(event_data, properties, objects_only=True).where(F.col("status") != "rejected").drop("status", "kind")
    return have.join(valid_events(events).drop("action_id"), "event_id")


def attribute_history(events: DataFrame, event_data: DataFrame, properties: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Versions of every object's properties with the period each was valid.

    The n-th update of an object's key is its n-th snapshot.  Each snapshot is
    joined to the one before (null-safe full outer join on object, key and
    shifted number); those inserted or changed begin a version, which lasts
    until the next one begins.  The update log has no deletions: a number
    that is only in the earlier snapshot is the last update and stays valid.

    Updates follow path order, also those of equal time, so a version may have
    an empty period.  Empty tables give no version.

    Result: ``object_id, key, start_event_id, v_int, v_float, v_bool, v_str,
    change, valid_from, valid_to`` (microseconds, ``valid_to`` null while valid).
    """
    slicing = plan_slices(events) if slicing is None else slicing
    log = slicing.add(updates(events, event_data, properties))
    if slicing:
        log, _ = stored(log)  # its slices are summed up and gone through
    path = Window.partitionBy("object_id", "key", "slice").orderBy(*path_order())
    numbered = log.withColumn("n", F.row_number().over(path).cast("long"))
    if slicing:
        numbered = slicing.carry(
            numbered, ["object_id", "key"], [F.count("*").alias("_n")],
            lambda w: [F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_n0")], MOST_PROPERTIES,
        ).withColumn("n", F.col("n") + F.coalesce("_n0", F.lit(0)))
    now = numbered.select("object_id", "key", "n", *VALUE, F.col("ts"), F.col("seq"), F.col("event_id"), "slice")
    before = numbered.select("object_id", "key", (F.col("n") + 1).alias("n"), *VALUE)
    changes = diff_snapshots(before, now, ["object_id", "key", "n"], [*VALUE], ["ts", "seq", "event_id", "slice"])
    begun = changes.where(F.col("change").isin("inserted", "changed"))
    later = Window.partitionBy("object_id", "key", "slice").orderBy("n")
    until = F.lead("ts").over(later)
    if slicing:
        begun = slicing.carry(
            begun, ["object_id", "key"], [F.min("ts").alias("_first")],
            lambda w: [F.first("_first").over(w.rowsBetween(1, 1)).alias("_next")], MOST_PROPERTIES,
        )
        until = F.coalesce(until, F.col("_next"))
    return begun.select("object_id", "key", F.col("event_id").alias("start_event_id"), *VALUE, "change", F.col("ts").alias("valid_from"), until.alias("valid_to"))
