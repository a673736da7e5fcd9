"""Sessions by pairing starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import Slicing, path_order, plan_slices, sliced_events

MINUTE = 60_000_000


def sessions(events: DataFrame, gap: int = 30 * MINUTE, slicing: Slicing | None = None) -> DataFrame:
    """Sessions of valid events; a longer pause than ``gap`` microseconds begins a new one.

    A RANGE frame over earlier times finds events with no near predecessor
    (starts), one over later times those with no near successor (ends).
    Starts and ends are numbered separately along the path; the n-th start
    belongs to the n-th end, and the difference of their positions counts the
    events.  Both frames reach to the unbounded side, which Spark extends row
    by row; a frame of ``gap`` width would be summed anew for each row.

    Equal times lie in one session; the first and last event follow path
    order.  Invalid events and repeated deliveries do not count (see
    ``valid_events``); an empty table gives no session.

    Result: ``object_id, start_event_id, end_event_id, start_ts, end_ts,
    duration_us, n_events``.
    """
    slicing = plan_slices(events) if slicing is None else slicing
    e = sliced_events(events, slicing).select("object_id", "slice", "ts", "seq", "event_id")
    if slicing:
        e = slicing.carry(
            e, ["object_id"], [F.min("ts").alias("_lo"), F.max("ts").alias("_hi")],
            lambda w: [F.lag("_hi").over(w).alias("_before"), F.lead("_lo").over(w).alias("_after")],
        )
    else:
        e = e.withColumns({"_before": F.lit(None).cast("long"), "_after": F.lit(None).cast("long")})

    part = Window.partitionBy("object_id", "slice")
    path = part.orderBy(*path_order())
    earlier = part.orderBy(F.col("ts")).rangeBetween(Window.unboundedPreceding, -1)
    later = part.orderBy(-F.col("ts")).rangeBetween(Window.unboundedPreceding, -1)
    near = e.withColumns({"_later": F.min("ts").over(later)}).withColumns(
        {
            "_pos": F.row_number().over(path).cast("long"),
            "_tie_before": F.lag("ts").over(path) == F.col("ts"),
            "_tie_after": F.lead("ts").over(path) == F.col("ts"),
            "_earlier": F.max("ts").over(earlier),
        }
    )
    far = lambda a, b: F.coalesce(a - b > gap, F.lit(True))
    marked = near.withColumns(
        {
            "_start": far(F.col("ts"), F.coalesce("_earlier", "_before")) & ~F.coalesce("_tie_before", F.lit(False)),
            "_end": far(F.coalesce("_later", "_after"), F.col("ts")) & ~F.coalesce("_tie_after", F.lit(False)),
        }
    ).select("object_id", "slice", "ts", "seq", "event_id", "_pos", "_start", "_end")
    if slicing:
        marked = slicing.carry(
            marked, ["object_id"], [F.sum(F.col("_start").cast("long")).alias("_s"), F.sum(F.col("_end").cast("long")).alias("_e"), F.count("*").alias("_n")],
            lambda w: [F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{c}0") for c in ("_s", "_e", "_n")],
        )
    ranked = marked.withColumns(
        {
            "_start_no": F.sum(F.col("_start").cast("long")).over(path.rowsBetween(Window.unboundedPreceding, 0)),
            "_end_no": F.sum(F.col("_end").cast("long")).over(path.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where(F.col("_start") | F.col("_end"))
    if slicing:
        shift = lambda c, k: F.col(c) + F.coalesce(F.col(k), F.lit(0))
        ranked = ranked.withColumns({"_start_no": shift("_start_no", "_s0"), "_end_no": shift("_end_no", "_e0"), "_pos": shift("_pos", "_n0")})

    # The join of starts and ends on equal numbers is one grouping of both:
    # the shuffle carries each mark once and the path is computed once.
    mark = lambda flag, no, is_start: F.when(
        F.col(flag), F.struct(F.col(no).alias("no"), F.lit(is_start).alias("is_start"), "event_id", "ts", F.col("_pos").alias("pos"))
    )
    marks = ranked.select("object_id", F.explode(F.array_compact(F.array(mark("_start", "_start_no", True), mark("_end", "_end_no", False)))).alias("m")).select("object_id", "m.*")
    of = lambda c, start: F.max(F.when(F.col("is_start") == F.lit(start), F.col(c)))
    return (
        marks.groupBy("object_id", "no")
        .agg(
            of("event_id", True).alias("start_event_id"), of("event_id", False).alias("end_event_id"),
            of("ts", True).alias("start_ts"), of("ts", False).alias("end_ts"),
            (of("pos", False) - of("pos", True) + 1).alias("n_events"),
        )
        .select("object_id", "start_event_id", "end_event_id", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_us"), "n_events")
    )
