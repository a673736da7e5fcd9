"""Runs of repeated consecutive events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.paths import Slicing, path_order, plan_slices, sliced_events
from ..session import collect_small, exactly

MINUTE = 60_000_000
#: Registered actions that may be sent to all tasks: as many as ids of 16 bits.
MOST_ACTIONS = 65_536


def same_actions(actions: DataFrame) -> DataFrame:
    """``action_id, same``: registered ids whose names agree in ASCII letters and digits share ``same``.

    An id without a name stands for itself.  An id with several names takes
    the first of them in order.
    """
    plain = F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", ""))
    named = exactly(actions, "id", "name").where(F.col("id").isNotNull() & F.col("name").isNotNull()).groupBy(F.col("id").alias("action_id")).agg(F.min(plain).alias("_plain"))
    return named.withColumn("same", F.min("action_id").over(Window.partitionBy("_plain"))).select("action_id", "same")


def collapse_runs(events: DataFrame, actions: DataFrame, pause: int = 10 * MINUTE, slicing: Slicing | None = None) -> DataFrame:
    """One row per run of equal actions in a path.

    Events without action are left out first.  An event continues the run of
    its predecessor if both have the same action (see ``same_actions``) and at
    most ``pause`` microseconds lie between them.

    Only boundary rows are kept: events that differ from their predecessor,
    with their position and the predecessor's id and time, and the last row of
    each slice.  ``lead`` over these gives a run's length as a difference of
    positions and its end as what the next boundary knows of its predecessor.

    Runs of one event are included (``n_events`` 1, ``duration_us`` 0).
    Repeated deliveries, events without object or time never count; an empty
    table gives no run.

    Result: ``object_id, action_id, first_event_id, last_event_id, first_ts,
    last_ts, n_events, duration_us``; ``action_id`` is the lowest of the ids
    that count as the same.
    """
    slicing = plan_slices(events) if slicing is None else slicing
    spark = events.sparkSession
    table = collect_small(same_actions(actions), MOST_ACTIONS)
    same = spark.createDataFrame(table, "action_id int, same int")
    e = (
        sliced_events(events, slicing, actions_only=True)
        .join(F.broadcast(same), "action_id", "left")
        .select("object_id", "slice", "ts", "seq", "event_id", F.coalesce("same", "action_id").alias("action"))
    )
    part = Window.partitionBy("object_id", "slice").orderBy(*path_order())
    if slicing:
        row = F.struct(F.col("ts"), F.coalesce(-F.col("seq"), F.lit(2**63 - 1)).alias("no"), F.col("event_id"), F.col("action"))
        e = slicing.carry(
            e, ["object_id"], [F.max(row).alias("_row"), F.count("*").alias("_n")],
            lambda w: [F.lag("_row").over(w).alias("_b"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_pos0")],
        ).withColumns({"_b_ts": F.col("_b.ts"), "_b_event": F.col("_b.event_id"), "_b_action": F.col("_b.action")}).drop("_b")
    else:
        e = e.withColumns({c: F.lit(None).cast(t) for c, t in (("_pos0", "long"), ("_b_ts", "long"), ("_b_event", "long"), ("_b_action", "int"))})
    seen = e.withColumns(
        {
            "pos": F.row_number().over(part) + F.coalesce(F.col("_pos0"), F.lit(0)),
            "prev_ts": F.coalesce(F.lag("ts").over(part), "_b_ts"),
            "prev_event": F.coalesce(F.lag("event_id").over(part), "_b_event"),
            "prev_action": F.coalesce(F.lag("action").over(part), "_b_action"),
            "last": F.lead("event_id").over(part).isNull(),
        }
    )
    begins = F.coalesce((F.col("prev_action") != F.col("action")) | (F.col("ts") - F.col("prev_ts") > pause), F.lit(True))
    edges = seen.withColumn("begins", begins).where(F.col("begins") | F.col("last")).select(
        "object_id", "slice", "ts", "seq", "event_id", "action", "pos", "prev_ts", "prev_event", "begins", "last"
    )
    nxt = F.lead(F.struct("begins", "pos", "prev_ts", "prev_event", "ts", "event_id")).over(part)
    # What ends a run that is still open at the end of a slice: the first start
    # in a later slice, else the last row of the path.
    if slicing:
        start = F.when(F.col("begins"), F.struct("pos", "prev_event", "prev_ts"))
        end = F.when(F.col("last"), F.struct("pos", "event_id", "ts"))
        edges = slicing.carry(
            edges, ["object_id"], [F.min(start).alias("_first"), F.max(end).alias("_last")],
            lambda w: [
                F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_open"),
                F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_close"),
            ],
        )
    else:
        edges = edges.withColumns({"_open": F.lit(None).cast("struct<pos:bigint,prev_event:bigint,prev_ts:bigint>"), "_close": F.lit(None).cast("struct<pos:bigint,event_id:bigint,ts:bigint>")})
    following = edges.withColumn("_n", nxt).where("begins")
    own_last = F.col("_n").isNull()
    inner = ~own_last & F.col("_n.begins")
    past = (own_last | ~F.col("_n.begins"))
    def pick(inner_value, open_value, close_value, tail_value, self_value):
        """Next boundary in the slice, in a later slice, at the path's end, at the slice's last row, at the row itself."""
        return (
            F.when(inner, inner_value)
            .when(past & F.col("_open").isNotNull(), open_value)
            .when(past & F.col("_close").isNotNull(), close_value)
            .when(own_last, self_value)
            .otherwise(tail_value)
        )
    runs = following.withColumns(
        {
            "last_event_id": pick(F.col("_n.prev_event"), F.col("_open.prev_event"), F.col("_close.event_id"), F.col("_n.event_id"), F.col("event_id")),
            "last_ts": pick(F.col("_n.prev_ts"), F.col("_open.prev_ts"), F.col("_close.ts"), F.col("_n.ts"), F.col("ts")),
            "n_events": pick(
                F.col("_n.pos") - F.col("pos"), F.col("_open.pos") - F.col("pos"), F.col("_close.pos") - F.col("pos") + 1, F.col("_n.pos") - F.col("pos") + 1, F.lit(1)
            ).cast("long"),
        }
    )
    return runs.select(
        "object_id", F.col("action").alias("action_id"), F.col("event_id").alias("first_event_id"), "last_event_id",
        F.col("ts").alias("first_ts"), "last_ts", "n_events", (F.col("last_ts") - F.col("ts")).alias("duration_us"),
    )
