"""Small dirty tables and what the definitions say about them, in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

EVENT = "event_id long, object_id long, timestamp timestamp_ntz, action_id int, arrived_at timestamp_ntz, seq long"
DATA = "event_id long, idx int, key int, data_type string, int_value long, float_value double, boolean_value boolean, string_value string"
START = datetime(2020, 1, 1)
PROPERTIES = [(1, "object", "Int", "level"), (2, "object", "String", "plan"), (3, "object", "Boolean", "on"), (4, "object", "Float", "score"), (-1, "action", "Int", "n"), (-2, "action", "String", "a.b")]
ACTIONS = [(1, "purchase"), (2, "Sign_In"), (3, "sign-in"), (4, "view"), (6, None), (9, "Purchase")]


def events(n: int = 300, seed: int = 0, hot: float = 0.4, step: int = 8) -> list[tuple]:
    """Rows with ties, repeated deliveries, copies, missing values and one object with many of them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        obj = 7 if r.random() < hot else r.choice([None, 0, -3, 11, 12, 13, 14])
        ts = None if r.random() < 0.04 else START + timedelta(minutes=step * r.randrange(n // 3), microseconds=r.choice([0, 0, 1]))
        seq = None if r.random() < 0.02 else r.randrange(10 * n)
        rows.append([i % (n - n // 10), obj, ts, r.choice([None, 0, 1, 1, 2, 2, 3, 4, 6, 77]), START, seq])
    seqs: set = set()
    for row in rows:  # deliveries have numbers of their own
        while row[5] is not None and row[5] in seqs:
            row[5] += 1
        seqs.add(row[5])
    rows = [tuple(x) for x in rows]
    rows += rows[:10]
    rows.append((None, 11, START, 1, START, 1))
    r.shuffle(rows)
    return rows


def data(n: int = 300, seed: int = 0) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for _ in range(3 * n):
        key = r.choice([1, 2, 3, 4, -1, -2, 55, None])
        value = r.choice([
            (r.randrange(3), None, None, None), (None, float(r.randrange(3)), None, None), (None, r.choice([0.5, math.nan, math.inf, 1e300]), None, None), (None, None, r.random() < 0.5, None),
            (None, None, None, r.choice(["1", " 2\t", "+1", " YES ", "no", "1e1", "x", "", "0", "1.", ".5", "99999999999999999999", "5f", "NaN"])), (None, None, None, None),
        ])
        rows.append((r.choice([None, *range(n)]) if r.random() < 0.03 else r.randrange(n), r.choice([0, 1, 1, 2, None]), key, r.choice(["Int", "Float", "String", "Boolean", "int", None]), *value))
    rows += rows[:15]
    r.shuffle(rows)
    return rows


def frames(spark: SparkSession, rows: list[tuple], attributes: list[tuple]):
    """Tables with further columns whose names clash with those used inside."""
    e = spark.createDataFrame([(*x, 1, 2, "x") for x in rows], EVENT + ", ts long, slice int, Event_Id string")
    d = spark.createDataFrame([(*x, "y", 3) for x in attributes], DATA + ", kind string, KEY int")
    p = spark.createDataFrame([(*x, 0) for x in PROPERTIES], "id int, type string, data_type string, name string, key int")
    a = spark.createDataFrame([(*x, 0) for x in ACTIONS], "id int, name string, action_id int")
    return e, d, p, a


def micros(t: datetime) -> int:
    d = t - datetime(1970, 1, 1)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def least(row: tuple) -> tuple:
    none_last = lambda v: (v is None, v or 0)
    return none_last(row[5]), none_last(row[2] and micros(row[2])), none_last(row[1]), none_last(row[3])


def valid(rows: list[tuple]) -> list[tuple]:
    """``event_id, object_id, ts, seq, action_id``."""
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    best = [min(v, key=least) for v in by.values()]
    return [(r[0], r[1], micros(r[2]), r[5], r[3]) for r in best if r[1] is not None and r[1] > 0 and r[2] is not None]


def paths(rows: list[tuple]) -> dict[int, list[tuple]]:
    by = defaultdict(list)
    for v in valid(rows):
        by[v[1]].append(v)
    return {o: sorted(p, key=lambda v: (v[2], v[3] is None, -(v[3] or 0), v[0])) for o, p in by.items()}


def read(kind: str, row: tuple):
    """The value of an attribute row in a type, or None."""
    i, f, b, s = row[4:8]
    t = s.strip() if s is not None else None
    if kind == "Int":
        if i is not None:
            return i
        if f is not None and math.isfinite(f) and f == int(f) and -(2**63) <= f < 2**63:
            return int(f)
        if t is not None and re.fullmatch(r"[+-]?[0-9]+", t) and -(2**63) <= int(t) < 2**63:
            return int(t)
    elif kind == "Float":
        if f is not None:
            return f if math.isfinite(f) else None
        if i is not None:
            return float(i)
        if t is not None and re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t) and math.isfinite(float(t)):
            return float(t)
    elif kind == "Boolean":
        if b is not None:
            return b
        if i in (0, 1):
            return i == 1
        if t is not None and t.lower() in ("true", "yes", "1", "false", "no", "0"):
            return t.lower() in ("true", "yes", "1")
    else:
        if s is not None:
            return s
        if i is not None:
            return str(i)
        if b is not None:
            return "true" if b else "false"
    return None


COLUMN = {"Int": 4, "Float": 5, "Boolean": 6, "String": 7}


def cells(attributes: list[tuple]) -> dict[tuple[int, int], tuple[str, object]]:
    """``(event, key) -> (status, value)``; among rows of one ``idx`` any is right, so these are all given."""
    kinds = {p[0]: p[2] for p in PROPERTIES}
    by = defaultdict(list)
    for r in attributes:
        if r[0] is not None and r[2] in kinds:
            by[r[0], r[2]].append(r)
    out = {}
    for (event, key), rows in by.items():
        kind = kinds[key]
        good = [r for r in rows if read(kind, r) is not None]
        if not good:
            out[event, key] = ("rejected", {None})
            continue
        top = max(-1 if r[1] is None else r[1] for r in good)
        best = [r for r in good if (-1 if r[1] is None else r[1]) == top]
        plain = [r for r in best if r[3] == kind and r[COLUMN[kind]] is not None]
        out[event, key] = ("ok" if plain else "repaired", {read(kind, r) for r in (plain or best)})
    return out
