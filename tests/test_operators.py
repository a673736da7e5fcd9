"""Operators on small dirty tables against plain Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import samples
from trailmill.operators.asof import PersistentTree, known_attributes
from trailmill.operators.cells import cells
from trailmill.operators.features import apply_deltas, deltas, feature_columns, feature_rows, feature_table, flat_features, update_features
from trailmill.operators.history import attribute_history, diff_snapshots, periodic_snapshots, snapshot_history
from trailmill.operators.paths import Slicing, plan_slices, valid_events
from trailmill.operators.sessions import sessions
from trailmill.queries import QUERIES
from trailmill import session
from trailmill.session import exactly
from trailmill.operators.wide import cell_status, outer_join_all, wide_rows

MINUTE = 60_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module", params=[0, 1])
def sample(request, spark):
    e, d = samples.events(seed=request.param), samples.data(seed=request.param)
    return e, d, *(f.cache() for f in samples.frames(spark, e, d))


@pytest.fixture(params=[0, 25], ids=["whole", "sliced"])
def slicing(request, sample):
    if not request.param:
        return Slicing()
    s = plan_slices(sample[2], request.param)
    assert s.slices >= 3
    return s


def test_valid_events(sample):
    assert rows(valid_events(sample[2]).select("event_id", "object_id", "ts", "seq", "action_id")) == sorted(samples.valid(sample[0]), key=repr)


def test_cells(sample):
    want = samples.cells(sample[1])
    got = {(r.event_id, r.key): r for r in cells(sample[3], sample[4]).collect()}
    assert set(got) == set(want)
    for k, (status, values) in want.items():
        value = next((v for v in (got[k].v_int, got[k].v_float, got[k].v_bool, got[k].v_str) if v is not None), None)
        assert got[k].status == status and value in values, (k, got[k], want[k])


def test_wide_rows(sample):
    wide = wide_rows(sample[3], sample[4])
    want = samples.cells(sample[1])
    assert [c for c in wide.columns if "__" not in c] == ["event_id", "a2_a_b", "a1_n", "o1_level", "o2_plan", "o3_on", "o4_score"]
    got = {r.event_id: r for r in wide.collect()}
    assert set(got) == {e for e, _ in want} and wide.count() == len(got)
    name = {1: "o1_level", 2: "o2_plan", 3: "o3_on", 4: "o4_score", -1: "a1_n", -2: "a2_a_b"}
    for event, row in got.items():
        for key, column in name.items():
            status, values = want.get((event, key), (None, {None}))
            assert row[f"{column}__cell"] == status and row[column] in values
    assert rows(cell_status(wide, sample[4])) == sorted(((e, k, s) for (e, k), (s, _) in want.items() if s != "ok"), key=repr)


def test_outer_join_all():
    import numpy as np

    tables = [(np.arange(i, i + 3), np.arange(3)[None]) for i in range(5)]
    entities, at = outer_join_all(tables)
    assert entities.tolist() == list(range(7)) and at.shape == (5, 7)
    assert all(at[i, e] == (e - i if 0 <= e - i < 3 else -1) for i in range(5) for e in range(7))


def test_wide_blocks(sample, monkeypatch):
    """Blocks smaller than a task's cells give the same rows."""
    from trailmill.operators import wide

    want = rows(wide_rows(sample[3], sample[4]))
    join = wide._join_blocks

    def small(*args):
        def run(batches):
            from trailmill.operators import wide as w

            w.BLOCK_CELLS = 3
            return join(*args)(piece for b in batches for piece in (b.slice(i, 2) for i in range(0, b.num_rows, 2)))

        return run

    monkeypatch.setattr(wide, "_join_blocks", small)
    assert rows(wide_rows(sample[3], sample[4])) == want


def test_sessions(sample, slicing):
    want = []
    for o, path in samples.paths(sample[0]).items():
        for i, v in enumerate(path):
            if i and v[2] - path[i - 1][2] <= 30 * MINUTE:
                want[-1] = (*want[-1][:2], v[0], want[-1][3], v[2], v[2] - want[-1][3], want[-1][6] + 1)
            else:
                want.append((o, v[0], v[0], v[2], v[2], 0, 1))
    assert rows(sessions(sample[2], 30 * MINUTE, slicing)) == sorted(want, key=repr)


def test_features(sample):
    want = {}
    for o, path in samples.paths(sample[0]).items():
        for v in path:
            if v[4] and v[4] > 0:
                want[o, v[4]] = (want.get((o, v[4]), (0,))[0] + 1, v[2], v[0])
    table = feature_table(sample[2])
    assert rows(table) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    got = {r.object_id: r for r in feature_rows(table).collect()}
    assert all(got[o].features[a].n == v[0] for (o, a), v in want.items())
    assert all(math.isclose(sum(f.share for f in r.features.values()), 1) for r in got.values())
    wide = {r.object_id: r for r in feature_columns(table, [1, 2, 999]).collect()}
    assert all(r.n_1 == want.get((o, 1), (0,))[0] and r.n_999 == 0 and r.age_999 is None for o, r in wide.items())


def test_features_are_kept_up(sample):
    """Batches in any order, one of them twice, end in the table of a single load."""
    want = rows(feature_table(sample[2]))
    parts = [sample[2].where(c) for c in ("coalesce(seq, 0) % 3 = 2", "coalesce(seq, 0) % 3 = 0", "seq % 3 = 2", "seq % 3 = 1")]
    state = None
    for part in parts:
        state = update_features(part, state)
    assert rows(flat_features(state[0])) == want
    for n in (3, 40):  # few deliveries meet only their own events
        state = update_features(sample[2].where(f"seq < {n}"), update_features(sample[2].where(f"seq >= {n} or seq is null")))
        assert rows(flat_features(state[0])) == want and rows(state[1]) == rows(update_features(sample[2])[1])
    again = update_features(sample[2].where("seq = -1"), state)
    assert rows(flat_features(again[0])) == want


def test_feature_blocks(sample, monkeypatch):
    from trailmill.operators import features

    want = rows(feature_columns(feature_table(sample[2]), [3, 1]))
    dense = features._dense

    def small(*args):
        def run(batches):
            from trailmill.operators import features as f

            f.BLOCK_ROWS = 3
            return dense(*args)(piece for b in batches for piece in (b.slice(i, 2) for i in range(0, b.num_rows, 2)))

        return run

    monkeypatch.setattr(features, "_dense", small)
    assert rows(feature_columns(feature_table(sample[2]), [3, 1])) == want
    assert feature_columns(feature_table(sample[2]), []).columns == ["object_id", "n_actions", "last_ts"]


def test_periodic_snapshots(spark):
    log = spark.createDataFrame([(1, 1, 5, 1, 10, 7), (1, 1, 9, 2, 11, 8), (1, 1, 9, 3, 12, 9), (1, 1, 25, 4, 13, None), (1, 1, 95, 5, 14, 7), (2, 1, -3, 6, 15, 1)],
        "object_id long, key int, ts long, seq long, event_id long, v_int long").selectExpr("*", "null v_float", "null v_bool", "null v_str")
    got = [(r.object_id, r.number, r.v_int) for r in periodic_snapshots(log, 10, 3).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 8), (1, 1, 8), (1, 2, None), (1, 3, None), (1, 4, None), (1, 9, 7), (1, 10, 7), (1, 11, 7), (2, -1, 1), (2, 0, 1), (2, 1, 1)], key=repr)


def test_deltas_repair_only_what_lost_its_latest(spark):
    schema = "event_id long, object_id long, ts long, seq long, action_id int"
    live = spark.createDataFrame([(1, 5, 10, 1, 1), (2, 5, 20, 2, 1), (4, 6, 10, 4, 1)], schema)
    gone = spark.createDataFrame([(3, 5, 30, 3, 1), (5, 6, 5, 5, 1), (6, 8, 5, 6, 1)], schema)
    found = apply_deltas(deltas(live.unionByName(gone), 1), deltas(gone, -1), live)
    assert rows(found.select("object_id", "n", "last.event_id")) == [(5, 2, 2), (6, 1, 4)]


def _updates(e, d):
    """Updates per object and key in path order; values of which any is right."""
    good = {k: v for k, v in samples.cells(d).items() if v[0] != "rejected" and k[1] > 0}
    return {(o, k): [(v, good[v[0], k][1]) for v in path if (v[0], k) in good] for o, path in samples.paths(e).items() for k in (1, 2, 3, 4)}


def test_history(sample, slicing):
    got = attribute_history(*sample[2:5], slicing)
    rows_by = {}
    for r in got.collect():
        rows_by.setdefault((r.object_id, r.key), []).append(r)
    resolved = {(r.event_id, r.key): next((v for v in (r.v_int, r.v_float, r.v_bool, r.v_str) if v is not None), None) for r in cells(sample[3], sample[4]).collect()}
    for (o, k), path in _updates(sample[0], sample[1]).items():
        starts, last = [], object()
        for v, _ in path:
            value = resolved[v[0], k]
            if not starts or value != last:
                starts.append((v[0], v[2]))
            last = value
        found = {r.start_event_id: r for r in rows_by.get((o, k), [])}
        assert set(found) == {s for s, _ in starts}
        for (s, t), nxt in zip(starts, [*starts[1:], (None, None)]):
            assert (found[s].valid_from, found[s].valid_to) == (t, nxt[1])
            assert found[s].change == ("inserted" if s == starts[0][0] else "changed")


def test_known_attributes(sample, slicing):
    want = []
    updates = _updates(sample[0], sample[1])
    for o, path in samples.paths(sample[0]).items():
        for v in path:
            if v[4] != 1:
                continue
            for k in (1, 2, 3, 4):
                known = [u for u, _ in updates[o, k]]
                if any(u[0] == v[0] for u in known):
                    want.append((v[0], k, v[0]))
                elif v[3] is not None:
                    known = [u for u in known if u[2] < v[2] and u[3] is not None and u[3] < v[3]]
                    if known:
                        want.append((v[0], k, known[-1][0]))
    got = known_attributes(sample[2], sample[3], sample[4], [1], slicing, shard_rows=100)
    assert rows(got.select("event_id", "key", "source_event_id")) == sorted(want, key=repr)
    assert len(want) > 50


def test_known_attributes_without_seq(spark):
    """Purchases that set a key whose updates all lack ``seq`` stand at themselves, however long the path."""
    at = lambda i: samples.START + samples.timedelta(minutes=i)
    e, d, p, _ = samples.frames(spark, [(i, 7, at(i), 1 if i % 3 == 0 else 2, at(i), None if i % 4 == 0 else i) for i in range(100)],
        [(i, 0, 1 if i % 4 == 0 else 2, "Int", i, None, None, None) for i in range(100) if i % 4 == 0 or i % 7 == 0])
    slicing = plan_slices(e, 25)
    assert slicing.slices >= 3
    found = [rows(known_attributes(e, d, p, [1], s, shard_rows=100).select("event_id", "key", "source_event_id")) for s in (Slicing(), slicing)]
    own = [(i, 1, i) for i in range(0, 100, 12)]
    other = [(i, 2, max(u for u in range(i + 1) if u % 7 == 0 and u % 4)) for i in range(9, 100, 3) if i % 4]
    assert found[0] == found[1] == sorted(own + other, key=repr)


def test_persistent_tree():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 9, 100):
        ranks = r.permutation(n)
        tree = PersistentTree(ranks)
        version, below = r.integers(-1, n, 200), r.integers(0, n + 1, 200)
        for v, b, got in zip(version, below, tree.before(version, below)):
            known = [(ranks[i], i) for i in range(v + 1) if ranks[i] < b]
            assert got == (max(known)[1] if known else -1)


def test_diff_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None), (None, "n")], "k int, v string")
    assert rows(diff_snapshots(a, b, ["k"], ["v"]).select("k", "change")) == sorted([(1, "same"), (2, "changed"), (3, "deleted"), (4, "inserted"), (None, "same")], key=repr)


def test_snapshot_history(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (1, "b", 5), (3, "b", 5), (3, "c", None)], "no int, k string, v int")
    got = rows(snapshot_history(s, "no", ["k"], ["v"]))
    assert got == sorted([("a", 1, 1, 3), ("a", 2, 3, None), ("b", 5, 1, 2), ("b", 5, 3, None), ("c", None, 3, None)], key=repr)


def test_piled_events(sample, monkeypatch):
    """Events with very many deliveries travel another way to the same results."""
    from trailmill.operators import paths

    e, d, p = sample[2:5]
    e = exactly(e, "event_id", "object_id", "timestamp", "seq", "action_id")
    d = exactly(d, "event_id", "idx", "key", "data_type", "int_value", "float_value", "boolean_value", "string_value")
    times = e.sparkSession.range(0, 32, 1, 1).withColumnRenamed("id", "_n")
    e, d = (x.unionByName(x.where("event_id = 5").coalesce(1).crossJoin(times).drop("_n")).coalesce(4).cache() for x in (e, d))
    compute = lambda: [rows(x) for x in (valid_events(e), feature_table(e), cells(d, p), attribute_history(e, d, p, Slicing()).drop("v_float"))]
    want = compute()
    assert paths.piled_keys(e, "event_id") == []
    monkeypatch.setattr(paths, "PILE_ROWS", 10)
    monkeypatch.setattr(paths, "PILE_LEAST", 8)
    assert 5 in paths.piled_keys(e, "event_id") and 5 in paths.piled_keys(d, "event_id")
    assert compute() == want
    monkeypatch.setattr(paths, "MOST_PILES", 0)
    assert paths.piled_keys(e, "event_id") is None
    assert compute() == want


def test_empty_tables(spark):
    e, d, p, _ = samples.frames(spark, [], [])
    assert sessions(e).count() == feature_table(e).count() == attribute_history(e, d, p).count() == known_attributes(e, d, p, [1]).count() == 0
    wide = wide_rows(d, p)
    assert wide.count() == 0 and len(wide.columns) == 1 + 2 * len(samples.PROPERTIES)
    none = p.where("id is null")
    assert wide_rows(d, none).columns == ["event_id"] and cell_status(wide_rows(d, none), none).count() == 0


def test_slices_are_cut_again(spark, monkeypatch):
    """A path of more slices than one level of cuts gives, with cuts from the driver or from a stored table."""
    from trailmill.operators import paths

    e = spark.range(0, 500, 1, 2).select(F.lit(7).alias("object_id"), (F.col("id") * 10).alias("ts")).unionByName(spark.range(5).select((F.col("id") + 20).alias("object_id"), F.lit(1).alias("ts")))
    e = e.unionByName(spark.range(40).select(F.lit(7).alias("object_id"), F.lit(0).alias("ts")))  # more equal times than a slice has rows
    monkeypatch.setattr(paths, "FAN", 4)
    for most in (20_000, 3):
        monkeypatch.setattr(paths, "small_or_stored", lambda df, most=most: session.small_or_stored(df, most))
        s = plan_slices(e, 20, time="ts")
        got = s.add(e).groupBy("object_id", "slice").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
        parts = sorted((r.slice, r.lo, r.hi, r.n) for r in got if r.object_id == 7)
        assert len(s.levels) > 1 and 25 <= len(parts) <= s.slices
        assert all(n <= 20 or lo <= 0 <= hi and n <= 60 for _, lo, hi, n in parts) and all(a[2] < b[1] for a, b in zip(parts, parts[1:])) and parts[0][0] >= 1
        assert {r.slice for r in got if r.object_id != 7} == {0}


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="seq"):
        valid_events(samples.frames(spark, [], [])[0].drop("seq"))


def test_shares_of_rows(spark, tmp_path):
    at = lambda i: samples.START + samples.timedelta(minutes=i)
    e, *_ = samples.frames(spark, [(1, 7, at(0), 2, at(0), 1), (2, 7, at(3), 2, at(3), 2), (3, 7, at(4), 3, at(4), 3), (4, 7, at(9), 0, at(9), 4), (1, 7, at(8), 2, at(8), 5), (5, 8, at(1), 2, at(1), 6)], [])
    exactly(e, "event_id", "object_id", "timestamp", "seq", "action_id").write.parquet(f"{tmp_path}/sky_event.parquet")
    assert rows(QUERIES["p7_shares"](spark, str(tmp_path))) == [(7, 2, 2, 2 / 3, MINUTE), (7, 3, 1, 1 / 3, 0), (8, 2, 1, 1.0, 0)]
