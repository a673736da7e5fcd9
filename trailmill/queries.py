"""Registered queries of the core: each takes (spark, directory of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.asof import known_attributes
from .operators.features import feature_columns, feature_rows, feature_table, flat_features, update_features
from .operators.history import VALUE, attribute_history, periodic_snapshots, snapshot_history, updates
from .operators.sessions import sessions
from .operators.wide import cell_status, wide_rows
from .session import collect_small, prepare, stored

DAY = 86_400_000_000
#: Action ids with columns of their own in ``p7_wide``: those of 8 bits.
WIDE_ACTIONS = range(1, 256)


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/{name}.parquet")


def _p1(spark: SparkSession, d: str) -> DataFrame:
    actions = load(spark, d, "sky_action")
    ids = [r[0] for r in collect_small(actions.where(F.col("name") == "purchase").select("id").distinct())]
    return known_attributes(load(spark, d, "sky_event"), load(spark, d, "sky_event_data"), load(spark, d, "sky_property"), ids)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).select("event_id", "key", "source_event_id")


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_rows(load(spark, d, "sky_event_data"), load(spark, d, "sky_property"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cell_status(p3_wide(spark, d), load(spark, d, "sky_property"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return attribute_history(load(spark, d, "sky_event"), load(spark, d, "sky_event_data"), load(spark, d, "sky_property"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_history(spark, d).select("object_id", "key", "start_event_id")


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """History from daily snapshots, in which an attribute stands for a week after its last update."""
    log = updates(load(spark, d, "sky_event"), load(spark, d, "sky_event_data"), load(spark, d, "sky_property"))
    snapshots, _ = stored(periodic_snapshots(log, DAY, 7))
    return snapshot_history(snapshots, "number", ["object_id", "key"], [*VALUE])


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(load(spark, d, "sky_event"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_sessions(spark, d).select("object_id", "start_event_id", "end_event_id")


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(load(spark, d, "sky_event")).select("object_id", "action_id", "n", "last_ts", "last_event_id")


def p7_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Features of the later half of the deliveries, brought up to date with the earlier half, which retracts many."""
    events = load(spark, d, "sky_event")
    half = events.agg(F.percentile_approx("seq", 0.5)).first()[0]
    later = F.coalesce(F.col("seq") > F.lit(half), F.lit(False))
    state = update_features(events.where(later))
    return flat_features(update_features(events.where(~later), state)[0])


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    return feature_columns(feature_table(load(spark, d, "sky_event")), [*WIDE_ACTIONS])


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the row per object; the map of features is left out, as rows compare by value."""
    return feature_rows(feature_table(load(spark, d, "sky_event"))).select("object_id", "n_actions", "n_kinds", "last_ts")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The map of features in the row per object, entry by entry."""
    found = feature_rows(feature_table(load(spark, d, "sky_event")))
    return found.select("object_id", F.explode("features").alias("action_id", "f")).select("object_id", "action_id", "f.n", "f.share", "f.age_us")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(load(spark, d, "sky_event")).select("object_id", "action_id", "last_event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p3_wide, p5_found, p5_history, p5_snapshots, p6_found, p6_sessions, p7_found, p7_features, p7_rows, p7_shares, p7_maintained, p7_wide)
}
