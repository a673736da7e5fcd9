"""Thousands of slices, cut on several levels, give what whole paths give."""

import os

import pytest

from trailmill.operators.asof import known_attributes
from trailmill.operators.history import attribute_history
from trailmill.operators.paths import Slicing, plan_slices
from trailmill.operators.sessions import sessions
from trailmill.queries import load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    return [load(spark, DATA, n).cache() for n in ("sky_event", "sky_event_data", "sky_property")]


@pytest.fixture(scope="module")
def slicing(tables):
    s = plan_slices(tables[0], 1)
    assert s.slices > 2_048 and len(s.levels) > 1
    return s


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", ["sessions", "history", "known"])
def test_same_as_whole_paths(tables, slicing, name):
    e, d, p = tables
    run = {"sessions": lambda s: sessions(e, slicing=s), "history": lambda s: attribute_history(e, d, p, s), "known": lambda s: known_attributes(e, d, p, [1, 2, 3], s, shard_rows=50)}[name]
    want = rows(run(Slicing()))
    assert rows(run(slicing)) == want and len(want) > 100
