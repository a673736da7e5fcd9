"""Registered queries over ``events`` as paths: the path language and the operators behind it.

Users are the objects, event types the actions (ids by first appearance), and
properties are derived from ``value`` and ``props``: object properties
``level``, ``balance`` and ``plan`` are set by some events and stay, action
properties ``amount`` and ``flag`` belong to theirs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.semantics import cast, iso_micros, now_micros, wrapping
from .operators.edit import file_ranges, insert_events, remove_events, scan_block, scan_paths, set_property, unset_property
from .operators.paths import micros, plan_slices
from .operators.state import action_statistics, path_lengths, state_at, transitions, with_state
from .plans import run
from .registry import Registry
from .session import collect_small, own_path, prepare
from .sources.catalog import Database
from .sources.footers import footer_ranges
from .sources.generator import generate_events
from .sources.messages import handle
from .sources.msgpack import to_msgpack
from .streaming.running import read_events, running_counts

STICKY = {"level": "Int", "balance": "Float", "plan": "String"}
TRANSIENT = {"amount": "Float", "flag": "Boolean"}
MOST_ACTIONS = 65_535

RESULT = "[Hashable(\"id\")] [Serializable] class Result { public Int id; public Int count; public Int total; public Float amount; public Int last; }"
LOOP = "Cursor cursor = path.events(); for each (Event e in cursor) { %s } return;"
PROGRAMS = {
    "action_count": "Result r = data.get(e.actionId); r.count = r.count + 1;",
    "state_totals": "Result r = data.get(e.actionId); r.count = r.count + 1; r.total = r.total + e.level; r.amount = r.amount + e.amount;",
    "action_id_sum": "Result r = data.get(0); r.total = r.total + e.actionId;",
    "conditional_keep_group": "Result r = data.get(e.actionId); if (e.level == 0) { r.count = r.count + 1; }",
    "conditional_filter": "if (e.level == 0) { Result r = data.get(e.actionId); r.count = r.count + 1; }",
    "conditional_chain": "Result r = data.get(e.actionId); if (e.level == 0) { r.count = r.count + 1; } else if (e.flag) { r.count = r.count + 100; } else { r.total = r.total - 1; }",
    "int_float_trunc": "Result r = data.get(e.actionId); r.total = r.total + (e.actionId + e.amount); r.amount = r.amount + (e.amount + e.actionId);",
    "int_division": "Result r = data.get(e.actionId); r.total = r.total + (0 - e.level) / 7;",
    "last_write": "Result r = data.get(e.actionId); r.last = e.level;",
    "string_equals": 'if (e.plan.equals("p1")) { Result r = data.get(e.actionId); r.count = r.count + 1; }',
    "multi_get": "Result a = data.get(e.actionId); a.count = a.count + 1; if (e.flag) { Result b = data.get(100 + e.level); b.total = b.total + 1; }",
    "key_expression": "Int bucket = e.level / 30; Result r = data.get(bucket * 10 + e.actionId); r.count = r.count + 1;",
    "float_arithmetic": "Result r = data.get(e.actionId); r.amount = r.amount + (e.amount - 1.5) * 2.0 / 4.0;",
    "float_by_zero": "Result r = data.get(e.actionId); if (e.amount / 0.0 == e.amount / 0.0) { r.count = r.count + 1; }",
    "float_equal": "Result r = data.get(e.actionId); if (e.amount == e.balance) { r.count = r.count + 1; }",
    "boolean_equal": "Result r = data.get(e.actionId); Boolean even = e.level / 2 * 2 == e.level; if (e.flag == even) { r.count = r.count + 1; }",
    "array_literal": "Array<Int> w = [5, 7]; Result r = data.get(e.actionId); r.total = r.total + w.getItemAt(1) * e.actionId;",
}
#: Programs with locals across events, a return or ``find``: planned all the same.
ACROSS = {
    "previous_level": "Int prev = 0; Cursor cursor = path.events(); for each (Event e in cursor) { Result r = data.get(e.actionId); r.total = r.total + (e.level - prev); prev = e.level; } return;",
    "fold_first_action": "Cursor cursor = path.events(); for each (Event e in cursor) { Result r = data.get(e.actionId); r.count = r.count + 1; return; }",
    "fold_repeats": "Int prev = 0; Cursor cursor = path.events(); for each (Event e in cursor) { if (e.actionId == prev) { Result r = data.get(prev); r.count = r.count + 1; } prev = e.actionId; } return;",
    "fold_find": LOOP % "Result r = data.find(e.actionId); if (r == null) { Result n = data.get(e.actionId); n.count = n.count + 10; } else { r.count = r.count + 1; }",
}
#: Programs with objects of their own, which are interpreted.
FOLDS = {
    "class_methods": "class Scale { private Int by; public void init() { this.by = 3; return; } public Int of(Int x) { return x * this.by; } } Scale s; "
    + LOOP % "Result r = data.get(e.actionId); r.total = r.total + s.of(e.level);",
    "anonymous_function": "class Calc { public Int twice(Int x, Function<Int a : Int> f) { return f(f(x)); } } Calc c; "
    + LOOP % "Result r = data.get(e.actionId); r.total = r.total + c.twice(e.level, function(a):Int { return a + 7; });",
    "terse_lambda": "class Each { public void visit(Int x, Function<Int v : void> f) { f(x + 1); return; } } Each k; "
    + LOOP % "Int out = 0; k.visit(e.level, :out = v); Result r = data.get(e.actionId); r.total = r.total + out;",
    "template_class": "class Box<T> { private T item; public void put(T x) { this.item = x; return; } public T take() { return this.item; } } Box<Int> b; Box<Float> f; "
    + LOOP % "b.put(e.level); f.put(e.amount); Result r = data.get(e.actionId); r.total = r.total + b.take(); r.amount = r.amount + f.take();",
    "enumerable_class": "[Enumerable] class Range { public Int at; public Int to; public Boolean eof() { return this.at == this.to; } public void next(Range r) { r.at = this.at; this.at = this.at + 1; return; } } "
    + LOOP % "Range range; range.to = e.level / 10; Result r = data.get(e.actionId); for each (Range i in range) { r.total = r.total + i.at; }",
    "array_set_item": LOOP % "Array<Int> w = [1, 2, 3]; w.setItemAt(50, e.level / 40); Result r = data.get(e.actionId); r.total = r.total + w.getItemAt(0) + w.getItemAt(1) * 100;",
    "conditional_return": LOOP % "if (e.flag) { Result r = data.get(e.actionId); r.count = r.count + 1; return; }",
    "two_loops": "Int n = 0; for each (Event e in path.events()) { n = n + 1; } for each (Event f in path.events()) { Result r = data.get(f.actionId); r.total = r.total + n; } return;",
    "toggle": LOOP % "Result r = data.get(e.actionId); r.total = 1 - r.total;",
}
#: An import with sections in an order of its own, words without quotes and missing commas.
IMPORT = """{ table: {
  properties: [ {dataType: Boolean, type: action, name: paid} {name: "floor", dataType: Int, type: object} {type: "action" dataType: "Float" name: "weight"} ]
  actions: [ {name: check_in}, {name: "check out"} ]
  blockSize: 128
  events: [
    {timestamp: "2031-12-01T00:00:00Z", objectId: 70, action: check_in, data: {floor: 3}}
    {action: "check out", timestamp: "2031-12-03T11:00:00Z", objectId: 70, data: {paid: true, weight: 12.5}}
    {objectId: 71, data: {floor: -2, weight: 1}, timestamp: "2031-12-02T09:30:00Z"}
    {objectId: 71, timestamp: "2031-12-02T10:00:00Z", action: "check out", data: {weight: null}}
    {objectId: 0, timestamp: "2031-12-02T10:00:00Z", action: "check out"}
  ] } }"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    """``events`` in the engine's form."""
    events = prepare(spark).read.parquet(f"{d}/events.parquet")
    ids = spark.createDataFrame([(a.name, a.id) for a in registry(events).all_actions()], "event_type string, action_id int")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.join(F.broadcast(ids), "event_type", "left").select(
        F.col("user_id").alias("object_id"), micros("ts").alias("ts"), F.col("event_id").alias("seq"), "action_id",
        F.when(k % 3 == 0, k).alias("level"),
        F.when(F.col("event_type") == "signup", F.col("value")).alias("balance"),
        F.when(k % 5 == 0, F.concat(F.lit("p"), (k % 4).cast("string"))).alias("plan"),
        F.when(F.col("event_type").isin("purchase", "click"), F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "view", k % 2 == 1).alias("flag"),
    )


def registry(events: DataFrame) -> Registry:
    """Actions registered in order of first appearance."""
    found = Registry()
    rows = collect_small(events.where(F.col("event_type").isNotNull()).groupBy("event_type").agg(F.min("event_id").alias("first")), MOST_ACTIONS)
    for name, _ in sorted(rows, key=lambda r: r[1]):
        found.add_action(name)
    return found


def _program(name: str, text: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(f"{RESULT} {text}", paths(spark, d), STICKY, TRANSIENT, strategy)

    query.__name__ = name
    return query


def action_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(a.id, a.name) for a in registry(prepare(spark).read.parquet(f"{d}/events.parquet")).all_actions()], "id int, name string")


def step_counts(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return transitions(p, slicing=plan_slices(p, time="ts"))


def path_length(spark: SparkSession, d: str) -> DataFrame:
    return path_lengths(paths(spark, d))


def event_state(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return with_state(p, STICKY, TRANSIENT, slicing=plan_slices(p, time="ts")).select("seq", "object_id", *STICKY, *TRANSIENT)


def event_state_fifo(spark: SparkSession, d: str) -> DataFrame:
    """The same with a coarse clock, on which equal times are common, and earlier arrivals first."""
    p = paths(spark, d).withColumn("ts", F.col("ts") - F.col("ts") % 86_400_000_000)
    return with_state(p, {"level": "Int"}, {}, "fifo", plan_slices(p, time="ts")).select("seq", "level")


def event_state_lifo(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d).withColumn("ts", F.col("ts") - F.col("ts") % 86_400_000_000)
    return with_state(p, {"level": "Int"}, {}, "lifo", plan_slices(p, time="ts")).select("seq", "level")


def property_zero_defaults(spark: SparkSession, d: str) -> DataFrame:
    return with_state(paths(spark, d), {}, TRANSIENT).groupBy("amount", "flag").agg(F.count("*").alias("n"))


def state_at_time(spark: SparkSession, d: str) -> DataFrame:
    return state_at(paths(spark, d), 1_705_276_800_000_000, STICKY)  # 2024-01-15


def bool_from_number(spark: SparkSession, d: str) -> DataFrame:
    with wrapping(spark):
        p = paths(spark, d)
        return p.select("seq", cast(F.col("level"), "Int", "Boolean").alias("of_int"), cast(F.col("amount"), "Float", "Boolean").alias("of_float"), cast(F.col("flag"), "Boolean", "Int").alias("to_int"))


def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    events = prepare(spark).read.parquet(f"{d}/events.parquet")
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select("event_id", iso_micros(text).alias("ts"), iso_micros(F.concat(text, F.lit("!"))).alias("bad"))


def table_append(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a table of the catalog in two parts, and read back with their state."""
    table = Database(prepare(spark), own_path(spark, "db")).table("users")
    p = paths(spark, d)
    for name, kind in STICKY.items():
        table.add_property("object", kind, name)
    table.append(p.where(F.col("ts") < 1_705_276_800_000_000).select("object_id", "ts", "seq", "action_id", *STICKY))
    for name, kind in TRANSIENT.items():  # registered late: null in the older files
        table.add_property("action", kind, name)
    table.append(p.where(F.col("ts") >= 1_705_276_800_000_000).select("object_id", "ts", "seq", "action_id", *STICKY, *TRANSIENT))
    return table.with_state(["level", "plan"]).groupBy("object_id").agg(F.count("*").alias("n"), F.sum("level").alias("levels"), F.max("plan").alias("plan"))


def table_query(spark: SparkSession, d: str) -> DataFrame:
    """A program run through the catalog, over events appended as a stream would, one batch of them twice."""
    table = Database(prepare(spark), own_path(spark, "db")).table("users")
    p = paths(spark, d)
    for kind, properties in (("object", STICKY), ("action", TRANSIENT)):
        for name, data_type in properties.items():
            table.add_property(kind, data_type, name)
    for batch in (0, 1, 0):
        table.append(p.where(F.col("seq") % 2 == batch), f"part-{batch}")
    return table.query(f"{RESULT} {LOOP % PROGRAMS['state_totals']}")


def table_compact(spark: SparkSession, d: str) -> DataFrame:
    """Path lengths after the files were written anew, clustered; and how many files overlap another in their objects by more than one."""
    table = Database(prepare(spark), own_path(spark, "db")).table("users")
    p = paths(spark, d).select("object_id", "ts", "seq", "action_id").where(F.col("action_id").isNotNull())
    for batch in range(2):
        table.append(p.where(F.col("seq") % 2 == batch))
    table.compact(4)
    files = sorted(collect_small(file_ranges(table.events()).select("min_object_id", "max_object_id")))
    apart = all(a[1] <= b[0] for a, b in zip(files, files[1:]))
    return path_lengths(table.events()).withColumn("clustered", F.lit(apart))


def json_import(spark: SparkSession, d: str) -> DataFrame:
    """An import document into a table, and a program over it; the event without object is rejected."""
    table = Database(prepare(spark), own_path(spark, "db")).table("guests")
    rejected = table.import_json(IMPORT).count()
    found = table.query(
        '[Serializable] [Hashable("floor")] class Result { public Float weight; public Int floor; public Int paid; } for each (Event e in path.events()) '
        "{ Result r = data.get(e.floor); r.weight = r.weight + e.weight; if (e.paid) { r.paid = r.paid + 1; } }"
    )
    return found.withColumn("rejected", F.lit(rejected))


def message_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each of the eight requests, and what it answers."""
    db = Database(prepare(spark), own_path(spark, "db"))
    program = '[Hashable("id")] [Serializable] class Result { public Int id; public Int n; } for each (Event e in path.events()) { Result r = data.get(e.actionId); r.n = r.n + e.rank; }'
    sent = [
        ("aadd", {"name": "open"}), ("padd", {"type": "object", "dataType": "Int", "name": "rank"}), ("aget", {"actionId": 1}), ("aget", {"actionId": 9}), ("pget", {"propertyId": 1}),
        ("aall", None), ("pall", None), ("eadd", {"objectId": 5, "timestamp": 10, "actionId": 1, "data": {"rank": 4}}), ("eadd", {"objectId": -5, "timestamp": 10, "actionId": 1}),
        ("eadd", {"events": [{"objectId": 5, "timestamp": 20, "actionId": 1}, {"objectId": 6, "timestamp": 5, "actionId": 2}]}),
        ("peach", {"query": program}),
    ]
    rows = []
    for step, (name, body) in enumerate(sent):
        answer = handle(db, name, "t", body)
        rows.append((step, name, json.dumps([r.asDict() for r in answer.collect()] if isinstance(answer, DataFrame) else answer)))
    return spark.createDataFrame(rows, "step int, request string, answer string")


def msgpack_rows(spark: SparkSession, d: str) -> DataFrame:
    found = run(f"{RESULT} {LOOP % PROGRAMS['action_count']}", paths(spark, d), STICKY, TRANSIENT).select("id", "count")
    return to_msgpack(found).select(F.lower(F.hex("value")).alias("packed"))


def last_write_ties(spark: SparkSession, d: str) -> DataFrame:
    """Last writes on a coarse clock, where one event of an object and day may lack its number of arrival."""
    p = paths(spark, d).withColumn("ts", F.col("ts") - F.col("ts") % 86_400_000_000)
    bare = F.min(F.when(F.col("seq") % 7 == 0, F.col("seq"))).over(Window.partitionBy("object_id", "ts"))
    p = p.withColumn("_bare", bare).withColumn("seq", F.when(F.col("seq").eqNullSafe(F.col("_bare")), F.lit(None)).otherwise(F.col("seq"))).drop("_bare")
    return run(f"{RESULT} {LOOP % PROGRAMS['last_write']}", p, STICKY, TRANSIENT, "declarative").select("id", "last")


def amount_statistics(spark: SparkSession, d: str) -> DataFrame:
    return action_statistics(paths(spark, d), "amount")


def block_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan_block(paths(spark, d), (10, 60), (1_704_067_200_000_000, 1_705_276_800_000_000)).select("object_id", "ts", "seq")


def timestamp_now(spark: SparkSession, d: str) -> DataFrame:
    """The time is one for all rows, and after the events."""
    p = paths(spark, d).withColumn("now", now_micros())
    return p.agg(F.count_distinct("now").alias("times"), F.min(F.col("now") > F.col("ts")).alias("later"))


def stream_action_count(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept by a stream over the events, run until all that is there is read."""
    schema = prepare(spark).read.parquet(f"{d}/events.parquet").schema
    name = f"counts_{uuid.uuid4().hex}"
    stream = read_events(spark, d, "events", schema).withColumn("action_id", F.col("event_type"))
    job = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    job.option("checkpointLocation", own_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("action_id").alias("event_type"), "n")


def event_scan(spark: SparkSession, d: str) -> DataFrame:
    p = paths(spark, d)
    return scan_paths(p, slicing=plan_slices(p, time="ts")).select("object_id", "position", "seq", "action_id")


def event_insert_remove(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth event taken out, every eighth put back, and one half of these twice."""
    p = paths(spark, d)
    kept = remove_events(p, p.where(F.col("seq") % 4 == 0))
    back = p.where(F.col("seq") % 8 == 0)
    return path_lengths(insert_events(kept, back.unionByName(p.where(F.col("seq") % 16 == 0)).unionByName(p.where(F.col("seq") % 4 == 1)))).select("object_id", "n")


def event_set_unset(spark: SparkSession, d: str) -> DataFrame:
    p = set_property(paths(spark, d), "level", 7, F.col("action_id") == 1)
    p = unset_property(p, "level", F.col("level") > 50)
    return with_state(p, {"level": "Int"}, {}, slicing=plan_slices(p, time="ts")).select("seq", "level")


def block_ranges(spark: SparkSession, d: str) -> DataFrame:
    files = file_ranges(paths(spark, d))
    return files.agg(F.min("min_object_id").alias("min_object_id"), F.max("max_object_id").alias("max_object_id"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("n").alias("n"))


def block_footers(spark: SparkSession, d: str) -> DataFrame:
    """The same ranges from the files' footers, of the stored columns."""
    found = footer_ranges(prepare(spark), f"{d}/events.parquet", ["user_id", "ts"])
    return found.agg(F.min("min_user_id").alias("min_user_id"), F.max("max_user_id").alias("max_user_id"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.sum("rows").alias("n"))


def synthetic_paths(spark: SparkSession, d: str) -> DataFrame:
    """A thousand paths of the generator, which reads no table."""
    return path_lengths(generate_events(prepare(spark), paths=1_000, average_events=10, actions=100, seed=7)).select("object_id", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _program(n, LOOP % body, "declarative") for n, body in PROGRAMS.items()},
    **{n: _program(n, text, "declarative") for n, text in ACROSS.items()},
    **{n: _program(n, text, "fold") for n, text in FOLDS.items()},
    **{
        f.__name__: f
        for f in (
            action_registry, step_counts, path_length, event_state, event_state_fifo, event_state_lifo, property_zero_defaults, state_at_time,
            bool_from_number, timestamp_parse, event_scan, event_insert_remove, event_set_unset, block_ranges, block_footers, table_append, table_query, table_compact,
            json_import, message_requests, msgpack_rows, last_write_ties, amount_statistics, block_scan, timestamp_now, stream_action_count, synthetic_paths,
        )
    },
}

PATHS = """actions AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id))::INTEGER AS action_id FROM events GROUP BY event_type),
k AS (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events),
p AS (
  SELECT user_id AS object_id, epoch_us(ts) AS ts, event_id AS seq, action_id,
    CASE WHEN k % 3 = 0 THEN k END AS level, CASE WHEN event_type = 'signup' THEN value END AS balance, CASE WHEN k % 5 = 0 THEN 'p' || (k % 4) END AS plan,
    CASE WHEN event_type IN ('purchase', 'click') THEN value END AS amount, CASE WHEN event_type = 'view' THEN k % 2 = 1 END AS flag
  FROM k JOIN actions USING (event_type))"""
_LAST = "coalesce(last_value({0} IGNORE NULLS) OVER w, {1}) AS {0}"
STATE = f"""WITH {PATHS},
s AS (
  SELECT object_id, ts, seq, action_id, {_LAST.format("level", 0)}, {_LAST.format("balance", "0.0::DOUBLE")}, {_LAST.format("plan", "''")}, coalesce(amount, 0) AS amount, coalesce(flag, false) AS flag
  FROM p WINDOW w AS (PARTITION BY object_id ORDER BY ts, seq DESC ROWS UNBOUNDED PRECEDING))"""


def _grouped(count: str = "0::BIGINT", total: str = "0::BIGINT", amount: str = "0::DOUBLE", last: str = "0::BIGINT", key: str = "action_id::BIGINT", where: str = "true") -> str:
    return f"{STATE} SELECT {key} AS id, {count} AS count, {total} AS total, {amount} AS amount, {last} AS last FROM s WHERE {where} GROUP BY 1"


_COARSE = f"""WITH {PATHS}, q AS (SELECT object_id, ts - ts % 86400000000 AS ts, seq, level FROM p)
SELECT seq, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY ts, seq @ ROWS UNBOUNDED PRECEDING), 0) AS level FROM q"""
_STEPS = f"""WITH {PATHS}, l AS (SELECT lag(action_id) OVER (PARTITION BY object_id ORDER BY ts, seq DESC) AS prev, action_id FROM p)"""
SQL: dict[str, str] = {
    "action_count": _grouped("count(*)"),
    "state_totals": _grouped("count(*)", "sum(level)::BIGINT", "sum(amount)"),
    "action_id_sum": _grouped(total="sum(action_id)::BIGINT", key="0::BIGINT"),
    "conditional_keep_group": _grouped("count(*) FILTER (level = 0)"),
    "conditional_filter": _grouped("count(*)", where="level = 0"),
    "conditional_chain": _grouped("sum(CASE WHEN level = 0 THEN 1 WHEN flag THEN 100 ELSE 0 END)::BIGINT", "sum(CASE WHEN level = 0 OR flag THEN 0 ELSE -1 END)::BIGINT"),
    "int_float_trunc": _grouped(total="sum(action_id + trunc(amount)::BIGINT)::BIGINT", amount="sum(amount + action_id)"),
    "int_division": _grouped(total="sum(trunc(-level / 7.0)::BIGINT)::BIGINT"),
    "last_write": _grouped(last="last(level ORDER BY object_id, ts, seq DESC)"),
    "string_equals": _grouped("count(*)", where="plan = 'p1'"),
    "multi_get": f"""{STATE} SELECT action_id::BIGINT AS id, count(*) AS count, 0::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM s GROUP BY 1
UNION ALL SELECT 100 + level AS id, 0::BIGINT AS count, count(*) AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM s WHERE flag GROUP BY 1""",
    "key_expression": _grouped("count(*)", key="(level // 30) * 10 + action_id"),
    "array_literal": _grouped(total="sum(7 * action_id)::BIGINT"),
    "fold_first_action": f"""WITH {PATHS}, f AS (SELECT first(action_id ORDER BY ts, seq DESC)::BIGINT AS id FROM p GROUP BY object_id)
SELECT id, count(*) AS count, 0::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM f GROUP BY id""",
    "fold_repeats": f"{_STEPS} SELECT action_id::BIGINT AS id, count(*) AS count, 0::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM l WHERE prev = action_id GROUP BY 1",
    "fold_find": _grouped("count(*) + 9"),
    "previous_level": f"""{STATE}, b AS (SELECT *, level - lag(level, 1, 0) OVER (PARTITION BY object_id ORDER BY ts, seq DESC) AS step FROM s)
SELECT action_id::BIGINT AS id, 0::BIGINT AS count, sum(step)::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM b GROUP BY 1""",
    "float_arithmetic": _grouped(amount="sum((amount - 1.5::DOUBLE) * 2 / 4)"),
    "float_by_zero": _grouped("count(*) FILTER (amount <> 0)"),
    "float_equal": _grouped("count(*) FILTER (amount = balance)"),
    "boolean_equal": _grouped("count(*) FILTER (flag = (level // 2 * 2 = level))"),
    "class_methods": _grouped(total="sum(level * 3)::BIGINT"),
    "anonymous_function": _grouped(total="sum(level + 14)::BIGINT"),
    "terse_lambda": _grouped(total="sum(level + 1)::BIGINT"),
    "template_class": _grouped(total="sum(level)::BIGINT", amount="sum(amount)"),
    "enumerable_class": _grouped(total="sum((level // 10) * (level // 10 - 1) // 2)::BIGINT"),
    "array_set_item": _grouped(total="sum(CASE WHEN level // 40 = 0 THEN 50 ELSE 1 END + 100 * CASE WHEN level // 40 = 1 THEN 50 ELSE 2 END)::BIGINT"),
    "conditional_return": f"""{STATE}, f AS (SELECT first(action_id ORDER BY ts, seq DESC)::BIGINT AS id FROM s WHERE flag GROUP BY object_id)
SELECT id, count(*) AS count, 0::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM f GROUP BY id""",
    "two_loops": f"""{STATE}, n AS (SELECT action_id, count(*) OVER (PARTITION BY object_id) AS n FROM s)
SELECT action_id::BIGINT AS id, 0::BIGINT AS count, sum(n)::BIGINT AS total, 0::DOUBLE AS amount, 0::BIGINT AS last FROM n GROUP BY 1""",
    "toggle": _grouped(total="count(*) % 2"),
    "table_query": _grouped("count(*)", "sum(level)::BIGINT", "sum(amount)", where="object_id > 0"),
    "table_compact": "SELECT user_id AS object_id, count(*) AS n, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, true AS clustered FROM events WHERE user_id > 0 AND event_type IS NOT NULL GROUP BY 1",
    "json_import": "SELECT * FROM (VALUES (12.5::DOUBLE, 3::BIGINT, 1::BIGINT, 1), (1.0::DOUBLE, -2::BIGINT, 0::BIGINT, 1)) t(weight, floor, paid, rejected)",
    "message_requests": """SELECT * FROM (VALUES
  (0, 'aadd', '{"id": 1, "name": "open"}'), (1, 'padd', '{"id": 1, "type": "object", "dataType": "Int", "name": "rank"}'), (2, 'aget', '{"id": 1, "name": "open"}'), (3, 'aget', 'null'),
  (4, 'pget', '{"id": 1, "type": "object", "dataType": "Int", "name": "rank"}'), (5, 'aall', '[{"id": 1, "name": "open"}]'),
  (6, 'pall', '[{"id": 1, "type": "object", "dataType": "Int", "name": "rank"}]'), (7, 'eadd', '{"status": "ok"}'), (8, 'eadd', '{"status": "error", "reason": "object id must be above 0"}'),
  (9, 'eadd', '{"status": "ok"}'), (10, 'peach', '[{"id": 1, "n": 8}, {"id": 2, "n": 0}]')) t(step, request, answer)""",
    "msgpack_rows": f"""{STATE}, g AS (SELECT action_id::BIGINT AS id, count(*) AS n FROM s GROUP BY 1)
SELECT '82a26964' || printf('%02x', id) || 'a5636f756e74' || CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 256 THEN 'cc' || printf('%02x', n) WHEN n < 65536 THEN 'cd' || printf('%04x', n) ELSE 'ce' || printf('%08x', n) END AS packed FROM g""",
    "last_write_ties": f"""WITH {PATHS}, q AS (SELECT object_id, ts - ts % 86400000000 AS ts, seq, action_id, level FROM p),
b AS (SELECT * REPLACE (CASE WHEN seq = min(CASE WHEN seq % 7 = 0 THEN seq END) OVER (PARTITION BY object_id, ts) THEN NULL ELSE seq END AS seq) FROM q),
s AS (SELECT object_id, ts, seq, action_id, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST ROWS UNBOUNDED PRECEDING), 0) AS level FROM b)
SELECT action_id::BIGINT AS id, last(level ORDER BY object_id, ts, seq DESC NULLS LAST) AS last FROM s GROUP BY 1""",
    "amount_statistics": f"WITH {PATHS} SELECT action_id, min(amount) AS least, max(amount) AS most, avg(amount) AS mean, count(*) AS n FROM p WHERE amount IS NOT NULL GROUP BY 1",
    "block_scan": f"WITH {PATHS} SELECT object_id, ts, seq FROM p WHERE object_id BETWEEN 10 AND 60 AND ts BETWEEN 1704067200000000 AND 1705276800000000",
    "timestamp_now": "SELECT 1::BIGINT AS times, true AS later",
    "action_registry": "SELECT row_number() OVER (ORDER BY min(event_id))::INTEGER AS id, event_type AS name FROM events GROUP BY event_type",
    "step_counts": f"{_STEPS} SELECT prev AS prev_action_id, action_id, count(*) AS n FROM l WHERE prev IS NOT NULL GROUP BY ALL",
    "path_length": "SELECT user_id AS object_id, count(*) AS n, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM events GROUP BY 1",
    "event_state": f"{STATE} SELECT seq, object_id, level, balance, plan, amount, flag FROM s",
    "event_state_fifo": _COARSE.replace("@", "ASC"),
    "event_state_lifo": _COARSE.replace("@", "DESC"),
    "property_zero_defaults": f"{STATE} SELECT amount, flag, count(*) AS n FROM s GROUP BY ALL",
    "state_at_time": f"""WITH {PATHS}, u AS (SELECT * FROM p WHERE ts <= 1705276800000000)
SELECT object_id, coalesce(last(level ORDER BY ts, seq DESC) FILTER (level IS NOT NULL), 0) AS level, coalesce(last(balance ORDER BY ts, seq DESC) FILTER (balance IS NOT NULL), 0) AS balance,
  coalesce(last(plan ORDER BY ts, seq DESC) FILTER (plan IS NOT NULL), '') AS plan FROM u GROUP BY object_id""",
    "bool_from_number": f"WITH {PATHS} SELECT seq, (level & 1) = 1 AS of_int, (trunc(amount)::BIGINT & 1) = 1 AS of_float, flag::BIGINT AS to_int FROM p",
    "timestamp_parse": "SELECT event_id, epoch_us(date_trunc('second', ts)) AS ts, NULL::BIGINT AS bad FROM events",
    "event_scan": f"WITH {PATHS} SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY ts, seq DESC) AS position, seq, action_id FROM p",
    "event_insert_remove": "SELECT user_id AS object_id, count(*) AS n FROM events WHERE event_id % 4 <> 0 OR event_id % 8 = 0 GROUP BY 1",
    "event_set_unset": f"""WITH {PATHS}, q AS (SELECT object_id, ts, seq, CASE WHEN action_id = 1 THEN 7 ELSE level END AS level FROM p), u AS (SELECT * REPLACE (CASE WHEN level > 50 THEN NULL ELSE level END AS level) FROM q)
SELECT seq, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY ts, seq DESC ROWS UNBOUNDED PRECEDING), 0) AS level FROM u""",
    "block_ranges": "SELECT min(user_id) AS min_object_id, max(user_id) AS max_object_id, epoch_us(min(ts)) AS min_ts, epoch_us(max(ts)) AS max_ts, count(*) AS n FROM events",
    "block_footers": "SELECT min(user_id) AS min_user_id, max(user_id) AS max_user_id, epoch_us(min(ts)) AS min_ts, epoch_us(max(ts)) AS max_ts, count(*) AS n FROM events",
    "table_append": f"{STATE} SELECT object_id, count(*) AS n, sum(level)::BIGINT AS levels, max(plan) AS plan FROM s WHERE object_id > 0 GROUP BY object_id",  # a table takes objects above 0 only
    "stream_action_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
