"""Runs and patterns against plain Python."""

from __future__ import annotations

import itertools
from collections import defaultdict

import pytest

import samples
from trailmill.llm.patterns import all_patterns, closed_patterns
from trailmill.llm.runs import collapse_runs
from trailmill.operators.paths import Slicing, plan_slices

MINUTE = 60_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module", params=[0, 1, 2])
def sample(request, spark):
    e = samples.events(seed=request.param)
    return e, *(f.cache() for f in samples.frames(spark, e, []))


@pytest.fixture(params=[0, 12], ids=["whole", "sliced"])
def slicing(request, sample):
    return plan_slices(sample[1], request.param) if request.param else Slicing()


def test_runs(sample, slicing):
    names = {i: "".join(c for c in n.lower() if c.isascii() and c.isalnum()) for i, n in samples.ACTIONS if n}
    first = {i: min(j for j in names if names[j] == names[i]) for i in names}
    want = []
    for o, path in samples.paths(sample[0]).items():
        path = [v for v in path if v[4] and v[4] > 0]
        before = None
        for v in path:
            action = first.get(v[4], v[4])
            if before and before[0] == action and v[2] - before[1] <= 10 * MINUTE:
                last = want[-1]
                want[-1] = (o, action, last[2], v[0], last[4], v[2], last[6] + 1, v[2] - last[4])
            else:
                want.append((o, action, v[0], v[0], v[2], v[2], 1, 0))
            before = (action, v[2])
    assert rows(collapse_runs(sample[1], sample[4], slicing=slicing)) == sorted(want, key=repr)
    assert max(w[6] for w in want) > 2


def brute(paths: dict, gap: int, most: int) -> dict[tuple, int]:
    support = defaultdict(set)
    for o, path in paths.items():
        path = [v for v in path if v[4] and v[4] > 0]
        ends = {(v[4],): set() for v in path}
        for i, v in enumerate(path):
            ends[v[4],].add(i)
        while ends:
            for p in ends:
                support[p].add(o)
            longer = defaultdict(set)
            for p, where in ends.items():
                if len(p) < most:
                    for i, (j, v) in itertools.product(where, enumerate(path)):
                        if j > i and v[2] - path[i][2] <= gap:
                            longer[*p, v[4]].add(j)
            ends = longer
    return {p: len(o) for p, o in support.items()}


@pytest.mark.parametrize("depth", [2, 4])
def test_patterns(sample, slicing, depth):
    gap = 12 * MINUTE
    want = {p: n for p, n in brute(samples.paths(sample[0]), gap, 6).items() if n >= 3}
    closed = closed_patterns(sample[1], gap, share=60, at_least=3, slicing=slicing, depth=depth).cache()
    got = {tuple(r.pattern): r.support for r in closed.collect()}
    for length in (1, 2, 3):
        assert {tuple(r.pattern): r.support for r in all_patterns(closed, length).collect()} == {p: n for p, n in want.items() if len(p) == length}
    for p, n in got.items():
        wider = [m for q, m in want.items() if len(q) == len(p) + 1 and p in (q[1:], q[:-1])]
        assert len(p) > 5 or (want[p] == n and n not in wider)


def test_empty(spark):
    e, _, _, a = samples.frames(spark, [], [])
    assert collapse_runs(e, a).count() == closed_patterns(e).count() == 0
