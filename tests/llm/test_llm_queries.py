"""Registered queries of the subpackage against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_queries import DATA, con, rows  # noqa: E402, F401

from trailmill.llm.patterns import closed_patterns  # noqa: E402
from trailmill.llm.queries import QUERIES  # noqa: E402
from trailmill.llm.runs import collapse_runs  # noqa: E402
from trailmill.llm.sql import SQL  # noqa: E402
from trailmill.operators.paths import Slicing, plan_slices  # noqa: E402
from trailmill.queries import load  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):  # noqa: F811
    got, want = QUERIES[name](spark, DATA), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_thousands_of_slices(spark):
    e, a = load(spark, DATA, "sky_event").cache(), load(spark, DATA, "sky_action")
    slicing = plan_slices(e, 1)
    assert slicing.slices > 2_048
    for run in (lambda s: collapse_runs(e, a, slicing=s), lambda s: closed_patterns(e, at_least=6, slicing=s)):
        want = sorted(map(repr, map(tuple, run(Slicing()).collect())))
        assert sorted(map(repr, map(tuple, run(slicing).collect()))) == want and len(want) > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    QUERIES[name](spark, DATA).count()
