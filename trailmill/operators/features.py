"""Per-object feature table, kept up by signed deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import exactly, prepare, stored
from .paths import first_deliveries, micros, piled_keys

KEYS = ["object_id", "action_id"]
ROW = ["event_id", "object_id", "ts", "seq", "action_id"]
#: Features put into columns at a time in a task.
BLOCK_ROWS = 1 << 16


def usable() -> Column:
    """Rows that count if their delivery is the event's first: object above 0, time and action given."""
    # A plain conjunction lets joins on the keys infer nothing new, so that the
    # shuffle of inserted features is the same everywhere and runs once.
    return (F.col("object_id") > 0) & F.col("ts").isNotNull() & (F.col("action_id") > 0)


def _rows(events: DataFrame) -> DataFrame:
    prepare(events.sparkSession)
    events = exactly(events, "event_id", "object_id", "timestamp", "seq", "action_id")
    rows = events.where(F.col("event_id").isNotNull()).select("event_id", "object_id", micros("timestamp").alias("ts"), "seq", "action_id")
    return first_deliveries(rows, piled_keys(events, "event_id"))


def delivered(events: DataFrame) -> DataFrame:
    """Usable deliveries; ``counts`` tells whether the row is the event or a later delivery of it."""
    return _marked(_rows(events))


def _order() -> list[Column]:
    return [F.col("seq").asc_nulls_last(), F.col("ts").asc_nulls_last(), F.col("object_id").asc_nulls_last(), F.col("action_id").asc_nulls_last()]


def _marked(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("event_id").orderBy(*_order())
    return rows.withColumn("counts", F.lag(F.lit(1)).over(first).isNull()).where(usable())


def _latest() -> list:
    """Last event in path order: greatest time, of equal times the lowest ``seq``, then the greatest id."""
    rank = F.struct(F.col("ts"), F.coalesce(-F.col("seq"), F.lit(2**63 - 1)).alias("no"), F.col("event_id"))
    return [F.max(rank).alias("last")]


def deltas(rows: DataFrame, sign: int) -> DataFrame:
    """Sum up rows to inserted (+1) or retracted (-1) features per object and action.

    Result: ``object_id, action_id, n, last``; ``n`` carries the sign, ``last``
    is the latest of the rows whatever the sign.  Rows are combined before the
    shuffle, so one object with a third of them is no burden.
    """
    return rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("n"), *_latest())


def apply_deltas(inserted: DataFrame, retracted: DataFrame, live: DataFrame) -> DataFrame:
    """Features after retractions.

    Counts are added.  The latest event is kept unless a retracted row is that
    event; only for those groups is it found anew among the ``live`` rows.
    Groups whose count falls to 0 disappear.
    """
    merged = (
        inserted.select(*KEYS, "n", "last", F.lit(None).cast(inserted.schema["last"].dataType).alias("gone"))
        .unionByName(retracted.select(*KEYS, "n", F.lit(None).cast(inserted.schema["last"].dataType).alias("last"), F.col("last").alias("gone")))
        .groupBy(*KEYS)
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("gone").alias("gone"))
        .where(F.col("n") > 0)
    )
    stale = F.coalesce(F.col("gone") >= F.col("last"), F.lit(False))
    again = live.join(merged.where(stale).select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(*_latest())
    found = again.select(*KEYS, F.col("last").alias("anew"))
    return merged.join(found, KEYS, "left").select(*KEYS, "n", F.coalesce("anew", "last").alias("last"))


def feature_table(events: DataFrame) -> DataFrame:
    """Count, last event and its time of each action in each object's path.

    This is the first load of the table that ``update_features`` then keeps up.
    Every usable delivery is inserted as it comes, combined before the shuffle
    (of an event delivered extremely often only the first); deliveries that
    turn out not to be their event's first are then retracted.  So the events themselves are never regrouped by object: only
    the few groups whose latest row was retracted are looked up again.

    Events without action (null or 0) are no feature.  Repeated deliveries,
    missing objects and times do not count; an empty table gives no row.

    Result: ``object_id, action_id, n, last_ts, last_event_id``.
    """
    rows = _rows(events)
    marked = _marked(rows)
    inserted = deltas(rows.where(usable()), 1)
    retracted = deltas(marked.where(~F.col("counts")), -1)
    return flat_features(apply_deltas(inserted, retracted, marked.where("counts")))


def update_features(deliveries: DataFrame, state: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(features, firsts)`` after new deliveries, from those before (None at the start).

    ``features`` are ``object_id, action_id, n, last`` and ``firsts`` the first
    delivery of each event so far, valid or not.  Few new deliveries meet only
    the firsts of their own events, many meet all in one shuffle.  One that is its event's first is inserted, and
    the one it takes the place of, if any, is retracted; later deliveries of
    known events change nothing.  Counts are added; the latest event is looked
    up again only in groups whose latest was retracted.

    Both tables are written to the shared folder, so lineage does not grow with
    the number of updates.  The order in which deliveries come in batches does
    not matter, nor does a batch that comes twice.
    """
    new = _rows(deliveries)
    if state is None:  # nothing to take the place of
        order = Window.partitionBy("event_id").orderBy(*_order())
        beginning, _ = stored(new.withColumn("first", F.lag(F.lit(1)).over(order).isNull()).where("first").select(*ROW))
        return stored(deltas(beginning.where(usable()), 1))[0], beginning
    features, firsts = state
    small = new.count() * 10 < firsts.count()  # else most of the firsts would travel for either join below
    known = firsts.join(new.select("event_id").distinct(), "event_id", "left_semi") if small else firsts
    both = known.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    order = Window.partitionBy("event_id").orderBy(*_order(), F.col("old").desc())
    seen, _ = stored(both.withColumn("first", F.lag(F.lit(1)).over(order).isNull()).where(F.col("first") | F.col("old")))
    after = seen.where("first").select(*ROW)
    if small:
        after, _ = stored(firsts.join(seen.select("event_id").distinct(), "event_id", "left_anti").select(*ROW).unionByName(after))
    inserted = deltas(seen.where("first and not old").where(usable()), 1)
    retracted = deltas(seen.where("old and not first").where(usable()), -1)
    live = after.where(usable())
    return stored(apply_deltas(features.unionByName(inserted), retracted, live))[0], after


def flat_features(features: DataFrame) -> DataFrame:
    """``object_id, action_id, n, last_ts, last_event_id``."""
    return features.select(*KEYS, "n", F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_event_id"))


def feature_rows(features: DataFrame) -> DataFrame:
    """One row per object: totals, and per action a struct of count, share and recency.

    ``features`` maps the action id to ``n``, ``share`` of the object's actions
    and ``age_us`` before the object's last action; an action never done has
    no entry.  A row has at most as many entries as there are actions.
    """
    total = Window.partitionBy("object_id")
    f = features.withColumns({"_n": F.sum("n").over(total), "_last": F.max("last_ts").over(total)})
    one = F.struct("n", (F.col("n") / F.col("_n")).alias("share"), (F.col("_last") - F.col("last_ts")).alias("age_us"))
    return f.groupBy("object_id").agg(
        F.max("_n").alias("n_actions"), F.count("*").alias("n_kinds"), F.max("_last").alias("last_ts"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("action_id", one.alias("f"))))).alias("features")
    )


def _dense(action_ids: list[int], names: list[str]):
    """Rows per object and action, sorted by object, to one row per object with columns per action."""
    ids = np.array(sorted(action_ids), np.int64)
    place = np.array([np.searchsorted(ids, a) for a in action_ids], np.int64)

    def wide(rows: pa.Table) -> pa.RecordBatch:
        obj, action, n, age, total, last = (rows.column(c).combine_chunks().to_numpy() for c in ("object_id", "action_id", "n", "age_us", "n_actions", "last_ts"))
        starts = np.flatnonzero(np.r_[True, obj[1:] != obj[:-1]])
        line = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(obj)]))
        at = np.minimum(np.searchsorted(ids, action), max(0, len(ids) - 1))
        known = ids[at] == action if len(ids) else np.zeros(len(obj), bool)
        counts, ages = np.zeros((len(ids), len(starts)), np.int64), np.full((len(ids), len(starts)), -1, np.int64)
        counts[at[known], line[known]], ages[at[known], line[known]] = n[known], age[known]
        out = [obj[starts], total[starts], last[starts]]
        for i in place:
            out += [counts[i], pa.array(ages[i], mask=ages[i] < 0), counts[i] / total[starts]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                rows = pa.Table.from_batches(held)
                obj = rows.column("object_id").combine_chunks().to_numpy()
                whole = int(np.searchsorted(obj, obj[-1]))  # the last object may go on
                if whole:
                    yield wide(rows.slice(0, whole))
                held, size = rows.slice(whole).combine_chunks().to_batches(), size - whole
        if size:
            yield wide(pa.Table.from_batches(held))

    return run


def feature_columns(features: DataFrame, action_ids: list[int]) -> DataFrame:
    """One row per object with columns ``n_<id>``, ``age_<id>``, ``share_<id>`` for the given actions.

    An action never done has count 0, share 0.0 and no age.  Rows of an object
    stand together after one shuffle and stream through a task in blocks, in
    which counts are put into place; an object has at most one row per action.

    Result: ``object_id, n_actions, last_ts`` (of all its actions, given or not) and the columns.
    """
    total = Window.partitionBy("object_id")
    f = features.withColumns({"n_actions": F.sum("n").over(total), "_last": F.max("last_ts").over(total)})
    f = f.select("object_id", "action_id", "n", (F.col("_last") - F.col("last_ts")).alias("age_us"), "n_actions", F.col("_last").alias("last_ts")).sortWithinPartitions("object_id")
    schema = "object_id long, n_actions long, last_ts long" + "".join(f", n_{a} long, age_{a} long, share_{a} double" for a in action_ids)
    names = [c.split()[0] for c in schema.split(", ")]
    return f.mapInArrow(_dense(action_ids, names), schema)
