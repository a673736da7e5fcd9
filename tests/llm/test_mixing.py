"""Mixtures: shares, caps and positions."""

import os
from collections import Counter, defaultdict

import pytest

from trailmill.llm.mixing import VOCABULARY, encoder, integrated, lengths, mix_sources, ramps, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def documents(spark):
    rows = [(i, "big" if i % 3 else "mid", f"text number {i} " * (1 + i % 5)) for i in range(300)] + [(1000 + i, "small", "tiny words here") for i in range(4)]
    rows += [(2000, None, "no source"), (2001, "big", None), (2002, "big", ""), (None, "big", "no id"), (2003, "other", "not a target"), (5, "big", "text number 5 " * 2)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, tokens int, copy string").repartition(4)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "source string, target_share double, max_repeats int, share double")


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "s", "Hello world"), (2, None, None), (3, "s", ""), (4, "s", "é " * 50_000)], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in token_counts(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(encoder(VOCABULARY).encode_ordinary("é " * 50_000))


def test_mixture(spark):
    mixture, report = mix_sources(documents(spark), targets(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("void", 0.05, 4), (None, 0.2, 1)]), total_tokens=2_000)
    rows = mixture.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position < 1 for r in rows)
    shares = {r.source: r for r in report.collect()}
    tokens, copies = Counter(), defaultdict(Counter)
    for r in rows:
        tokens[r.source] += r.tokens
        copies[r.source][r.doc_id, r.copy] += 1
    biggest = max(r.tokens for r in rows)
    assert 1_000 <= tokens["big"] < 1_000 + biggest and 600 <= tokens["mid"] < 600 + biggest
    assert tokens["small"] == 3 * shares["small"].available_tokens < 300  # all of it, as often as allowed
    assert shares["void"].tokens == 0 and shares["void"].share == 0 and set(shares) == {"big", "mid", "small", "void"}
    for s, r in shares.items():
        assert r.tokens == tokens[s] and r.share == pytest.approx(tokens[s] / sum(tokens.values())) and r.most_copies <= r.max_repeats
        assert all(n <= 2 for n in copies[s].values())  # the row that is there twice counts twice
    assert not {r.doc_id for r in rows} & {None, 2000, 2001, 2002, 2003}


def test_positions_follow_the_schedule(spark):
    schedule = {"big": [(0.0, 2.0), (0.5, 0.0), (1.0, 0.0)], "mid": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}
    rows = mix_sources(documents(spark), targets(spark, [("big", 0.5, 1), ("mid", 0.5, 1)]), 1_500, schedule)[0].collect()
    big, mid = ([r for r in rows if r.source == s] for s in ("big", "mid"))
    assert max(r.position for r in big) <= 0.5 <= min(r.position for r in mid if r.position > 0)
    size = sum(r.tokens for r in big)
    early = sum(r.tokens for r in big if r.position < 0.25)
    assert early / size == pytest.approx(0.75, abs=0.05)  # the integral of 2 - 4t up to a quarter, of one half in all


def test_ramps_add_up():
    found = ramps({"a": (0.6, 1), "b": (0.3, 2), "c": (0.1, 4)})
    for k in (0, 1):
        assert sum(knots[k][1] for knots in found.values()) == pytest.approx(1)
    assert integrated(found["c"])[1] == pytest.approx(0.1) and found["c"][0][1] < found["c"][1][1] and found["a"][0][1] > found["a"][1][1]


def test_same_mixture_at_any_partitioning(spark):
    t = targets(spark, [("big", 0.7, 1), ("mid", 0.3, 2)])
    a, b = (sorted(map(tuple, mix_sources(documents(spark).repartition(n), t, 900)[0].collect())) for n in (1, 5))
    assert a == b


def test_default_total_meets_every_target(spark):
    """The source that is used up first bounds the total; a source without documents does not."""
    mixture, report = mix_sources(documents(spark), targets(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("void", 0.1, 4)]))
    shares = {r.source: r for r in report.collect()}
    biggest = max(r.tokens for r in mixture.collect())
    limits = {s: r.max_repeats * r.available_tokens / r.target_share for s, r in shares.items() if r.available_tokens}
    total = shares["big"].largest_total
    assert total == pytest.approx(min(limits.values())) and limits["small"] == min(limits.values())
    assert shares["small"].tokens == 3 * shares["small"].available_tokens and shares["small"].most_copies == 3
    assert all(0 <= r.tokens - r.target_share * total < biggest or s in ("void", "small") for s, r in shares.items())


def test_buckets_do_not_matter(spark):
    t = targets(spark, [("big", 0.7, 1), ("mid", 0.3, 2)])
    a, b = (sorted(map(tuple, mix_sources(documents(spark), t, 900, bucket_rows=n, sizes=lengths)[0].collect())) for n in (5, 1_000))
    assert a == b and len(a) > 10


def test_empty(spark):
    d, t = documents(spark), targets(spark, [("big", 1.0, 1)])
    mixture, report = mix_sources(d.where("false"), t)
    assert mixture.count() == 0 and [(r.source, r.share) for r in report.collect()] == [("big", 0.0)]
    assert mix_sources(d, t.where("false"))[0].count() == 0
