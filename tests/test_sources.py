import struct

import pytest
from pyspark.sql import functions as F

from trailmill.operators.state import path_lengths
from trailmill.registry import RegistryError
from trailmill.sources.catalog import Database
from trailmill.sources.footers import footer_ranges
from trailmill.sources.generator import generate_events
from trailmill.sources.jsonimport import parse_lenient, parse_timestamp
from trailmill.sources.messages import handle
from trailmill.sources.msgpack import pack, to_msgpack

#: A library's lendings: events before a second list of actions, nested data in any order, commas missing in several places.
DOCUMENT = """{ "table" : {
  properties: [
    {name: shelf dataType: String, type: "object"}
    {type: action, name: "pages" dataType: Int},
    {dataType: "Float" type: object name: "fine"},
  ],
  actions: [{name: lend}, {name: "give back"}],
  events: [
    {data: {pages: 310 shelf: "B 7"}, action: lend, timestamp: "1999-02-28T23:59:59Z" objectId: 41}
    {objectId: 41, timestamp: "1999-03-09T12:00:00Z", data: {fine: 1.25}}
    {objectId: 41, data: {}, timestamp: "1999-03-09T12:00:00Z", action: "give back"},
    {timestamp: "1999-03-01T00:00:00Z", objectId: 40, action: lend, data: {pages: 90}}
  ] } }"""
#: Pages lent and fines standing, by whether anything is on a shelf.
PROGRAM = """
[Serializable]
[Hashable("group")]
class Result { public Float fines; public Int pages; public Int group; }
for each (Event e in path.events()) {
  Int group = 2;
  if (e.shelf.equals("")) { group = 1; }
  Result found = data.get(group);
  if (e.actionId == 1) { found.pages = found.pages + e.pages; } else { found.fines = found.fines + e.fine; }
}"""


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def test_lenient_json():
    assert parse_lenient('{a: [1 2.5, "x\\n\\u00e9"], b: {c: true d: null}, e: word}') == {"a": [1, 2.5, "x\né"], "b": {"c": True, "d": None}, "e": "word"}
    for bad in ("{a: 1", "[1] 2", "{1}", "{:}", ""):
        with pytest.raises(ValueError):
            parse_lenient(bad)


def test_timestamps():
    assert parse_timestamp("1970-01-01T00:00:01Z") == 1_000_000
    assert parse_timestamp("1969-12-31T23:59:59Z") == -1_000_000
    assert parse_timestamp("2080-01-01T00:00:00Z") == 3_471_292_800_000_000
    for bad in ("2010-01-02T10:30:20.5Z", "2010-01-02T10:30:20", "2010-01-02 10:30:20Z"):
        with pytest.raises(ValueError):
            parse_timestamp(bad)


def test_import_and_query(spark, db):
    t = db.table("loans")
    assert t.import_json(DOCUMENT).count() == 0
    # 41: lend, then of equal times the later arrival first: given back (fine still 0), then the fine itself
    want = [(0.0, 90, 1), (1.25, 310, 2)]
    assert [tuple(r) for r in t.query(PROGRAM).collect()] == want
    assert db.table("loans") is t
    again = Database(spark, db.path).table("loans")
    assert [tuple(r) for r in again.query(PROGRAM).collect()] == want
    assert [r.name for r in again.all_actions().orderBy("id").collect()] == ["lend", "give back"] and again.registry == t.registry
    assert [(r.object_id, r.shelf, r.fine) for r in t.state_at(parse_timestamp("1999-03-09T12:00:00Z")).orderBy("object_id").collect()] == [(40, "", 0.0), (41, "B 7", 1.25)]
    assert [r.action_id for r in t.events_of(41).collect()] == [1, 2, 0]
    assert {(r.prev_action_id, r.action_id): r.n for r in t.transitions().collect()} == {(1, 2): 1, (2, 0): 1}


@pytest.mark.parametrize(
    "text",
    [
        "{tables: {}}", '{table: {events: [{objectId: 1, timestamp: "2001-05-01T08:02:00Z", action: "none"}]}}', "{table: {extra: 1}}",
        '{table: {events: [{objectId: 1, timestamp: "2001-05-01T08:02:00Z", data: {none: 1}}]}}', '{table: {actions: [{nam: "x"}]}}', '{table: {actions: [{name: "x"}, {name: "x"}]}}',
        '{table: {properties: [{type: "object", dataType: "Date", name: "x"}]}}',
    ],
)
def test_import_errors(db, text):
    with pytest.raises(ValueError):
        db.table("t").import_json(text)


def test_append_rejects(spark, db):
    t = db.table("t")
    t.add_action("go")
    t.add_property("object", "Int", "n")
    rows = spark.createDataFrame(
        [(1, 10, "go", "5"), (0, 10, "go", None), (None, 10, "go", None), (2, None, "go", None), (3, 10, "fly", None), (4, 10, None, "x"), (5, 10, None, None), (6, 10, None, "7")],
        "object_id long, ts long, action string, n string",
    )
    rejected = {r.object_id: r.reason for r in t.append(rows).collect()}
    assert set(rejected) == {0, None, 2, 3, 4, 5} and rejected[4] == "wrong type: n" and rejected[3] == "unknown action"
    assert sorted((r.object_id, r.action_id, r.n) for r in t.events().collect()) == [(1, 1, 5), (6, 0, 7)]
    with pytest.raises(RegistryError):
        t.append(rows.withColumn("other", F.lit(1)))


def test_later_arrivals_sort_first_and_new_properties_are_null_before(db):
    t = db.table("t")
    t.add_property("object", "Int", "a")
    t.append_rows([{"object_id": 1, "ts": 5, "action_id": 1, "a": 1}, {"object_id": 1, "ts": 5, "action_id": 2, "a": 2}])
    t.add_property("action", "String", "b")
    t.append_rows([{"object_id": 1, "ts": 5, "action_id": 3, "b": "x"}])
    assert [(r.action_id, r.a, r.b) for r in t.events_of(1).collect()] == [(3, None, "x"), (2, 2, None), (1, 1, None)]
    assert [(r.action_id, r.a) for r in t.with_state(["a"]).orderBy(F.desc("seq")).collect()] == [(3, 0), (2, 2), (1, 1)]
    with pytest.raises(RegistryError):
        t.append_rows([{"object_id": 1, "ts": 5, "action_id": 3, "c": 1}])


def test_compact_keeps_rows(spark, db):
    t = db.table("t")
    t.append_rows([{"object_id": i % 5 + 1, "ts": i, "action_id": 1} for i in range(50)])
    t.append(spark.createDataFrame([(9, 3, 2)], "object_id long, ts long, action_id int"), "one")
    before = sorted(map(tuple, t.events().collect()))
    t.compact(4)
    assert sorted(map(tuple, t.events().collect())) == before and t.folder != "events"
    again = Database(spark, db.path).table("t")
    assert sorted(map(tuple, again.events().collect())) == before
    again.append_rows([{"object_id": 3, "ts": 9, "action_id": 1}])
    assert again.events().count() == 52 and len({r.seq for r in again.events().collect()}) == 52


def test_a_batch_replaces_itself(spark, db):
    t = db.table("t")
    rows = spark.createDataFrame([(1, 3, 2), (2, 4, 1)], "object_id long, ts long, action_id int")
    t.append(rows, "b-0")
    first = sorted(map(tuple, t.events().collect()))
    t.append(rows, "b-0")
    assert sorted(map(tuple, t.events().collect())) == first
    t.append(rows, "b-1")
    assert t.events().count() == 4 and len({r.seq for r in t.events().collect()}) == 4


def test_lock(spark, db):
    t, other = db.table("t"), Database(spark, db.path).table("t")
    with t.locked():
        t.append_rows([{"object_id": 1, "ts": 1, "action_id": 1}])
        for write in (lambda: other.append_rows([{"object_id": 1, "ts": 1, "action_id": 1}]), other.compact):
            with pytest.raises(RegistryError, match="locked"):
                write()
        other.unlock()
    other.append_rows([{"object_id": 1, "ts": 1, "action_id": 1}])
    assert t.events().count() == 2


def test_messages(db):
    assert handle(db, "aadd", "t", {"name": "go"}) == {"id": 1, "name": "go"}
    assert handle(db, "padd", "t", {"type": "action", "dataType": "Float", "name": "w"}) == {"id": -1, "type": "action", "dataType": "Float", "name": "w"}
    assert handle(db, "aget", "t", {"actionId": 1})["name"] == "go" and handle(db, "aget", "t", {"actionId": 2}) is None
    assert handle(db, "pget", "t", {"propertyId": -1})["name"] == "w" and handle(db, "pget", "t", {"propertyId": 1}) is None
    assert len(handle(db, "aall", "t")) == len(handle(db, "pall", "t")) == 1
    assert handle(db, "eadd", "t", {"objectId": 4, "timestamp": 1, "actionId": 9, "data": {"w": 1.5}}) == {"status": "ok"}
    assert handle(db, "eadd", "t", {"objectId": 0, "timestamp": 1, "actionId": 9})["status"] == "error"
    with pytest.raises(RegistryError):
        handle(db, "eadd", "t", {"objectId": 4, "timestamp": 1, "data": {"v": 1}})
    assert handle(db, "eadd", "t", {"events": [{"objectId": 4, "timestamp": 1, "actionId": 8}, {"objectId": 4, "timestamp": 2, "actionId": 8}]}) == {"status": "ok"}
    program = '[Hashable("id")] [Serializable] class Result { public Int id; public Float w; } for each (Event e in path.events()) { Result r = data.get(e.actionId); r.w = r.w + e.w; }'
    assert [tuple(r) for r in handle(db, "peach", "t", {"query": program}).collect()] == [(8, 0.0), (9, 1.5)]
    with pytest.raises(ValueError):
        handle(db, "other", "t")


def test_footers(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).selectExpr("id", "timestamp_micros(id * 10) AS at", "CAST(NULL AS LONG) AS none", "CAST(id AS STRING) AS text", "IF(id < 25, NULL, id) AS some")
    df.write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/t")
    got = sorted(map(tuple, footer_ranges(spark, f"file://{tmp_path}/t", ["id", "none", "text", "some", "missing"]).drop("file").collect()))
    assert [r[:3] for r in got] == [(25, i, i + 24) for i in (0, 25, 50, 75)]
    assert all(r[3:7] == (None,) * 4 and r[9:] == (None, None) for r in got) and [r[7:9] for r in got] == [(None, None), (25, 49), (50, 74), (75, 99)]
    assert footer_ranges(spark, f"file://{tmp_path}/t", []).count() == 4


def unpack(b: bytes):
    """Reads what ``pack`` writes: value and rest."""
    c, rest = b[0], b[1:]
    if c < 0x80:
        return c, rest
    if c >= 0xE0:
        return c - 256, rest
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], rest
    for code, form in ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q"), (0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"), (0xCB, ">d")):
        if c == code:
            n = struct.calcsize(form)
            return struct.unpack(form, rest[:n])[0], rest[n:]
    if c & 0xF0 == 0x80:
        out = {}
        for _ in range(c & 15):
            k, rest = unpack(rest)
            out[k], rest = unpack(rest)
        return out, rest
    n, rest = (c & 31, rest) if c & 0xE0 == 0xA0 else (rest[0], rest[1:]) if c == 0xD9 else (int.from_bytes(rest[:2]), rest[2:]) if c == 0xDA else (int.from_bytes(rest[:4]), rest[4:])
    return rest[:n].decode(), rest[n:]


def test_msgpack(spark):
    for v in (None, True, False, 0, 127, 128, 255, 256, 2**16, 2**32, 2**63 - 1, -1, -32, -33, -129, -(2**15) - 1, -(2**31) - 1, -(2**63), 1.5, "", "é", "x" * 40, "y" * 300, "z" * 70_000, {"a": 1, "b": None}):
        assert unpack(pack(v)) == (v, b"")
    with pytest.raises(OverflowError):
        pack(2**64)
    df = spark.createDataFrame([(1, 2.5, None), (300, -1.0, "s")], "a long, b double, c string")
    assert [unpack(r.value)[0] for r in to_msgpack(df).collect()] == [{"a": 1, "b": 2.5, "c": None}, {"a": 300, "b": -1.0, "c": "s"}]


def test_generator(spark):
    a, b = (generate_events(spark, 50, 4, 3, seed=s) for s in (1, 2))
    n = [r.n for r in path_lengths(a).collect()]
    assert len(n) == 50 and min(n) >= 1 and max(n) <= 7 and {r.action_id for r in a.collect()} == {1, 2, 3}
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(a) == key(generate_events(spark, 50, 4, 3, seed=1).repartition(7)) != key(b)
