"""Leak search against plain substring search."""

import random
import unicodedata

import numpy as np
import pytest

from trailmill.llm import leaks
from trailmill.llm.text import code_points, letter_codes, letters

WORDS = [w for w in "the a of kiln ledger marked ferry inspector weighed seventy-three nameless slate printer because bell arrived coast borrowed clock über Straße naïve ﬁeld 8978 archive committee".split()]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def noisy(r, text):
    """The same letters with other case, hyphens, soft hyphens, breaks and accents taken apart."""
    out = []
    for c in text:
        if r.random() < 0.05:
            out.append(r.choice(["­", "-\n", " ", "*"]))
        c = c.upper() if r.random() < 0.2 and len(c.upper()) == 1 else c
        out.append(unicodedata.normalize("NFD", c) if r.random() < 0.5 else c)
    return "".join(out)


@pytest.mark.parametrize("text", ["", "ABC déjà ﬁ ß", "x̄ = Σ ² ½ Å", "ｆｕｌｌ　ｗｉｄｔｈ", "áb", "İstanbul", "\U0001d400あｶﾞ", "Ⅷ ① ª", "한국 각"])
def test_letter_codes(text):
    assert letter_codes(text).tobytes().decode("utf-32-le") == letters(text)


def test_hashes():
    codes = code_points("abcdefghijklmnopqrstuvwxyz" * 3)
    h = leaks.shingle_hashes(codes)
    assert len(h) == len(codes) - 15 and h[0] == h[26] != h[1]
    assert len(leaks.shingle_hashes(codes[:15])) == 0 and len(leaks.shingle_hashes(codes[:16])) == 1
    for width in (1, 2, 3, 7, 30):
        assert (leaks.window_minima(h, width) == [h[i : i + width].min() for i in range(len(h) - width + 1)]).all()
    assert len(leaks.window_minima(h[:3], 4)) == 0


@pytest.mark.parametrize("small", [leaks.SMALL_ROWS, 3])
def test_leaks(spark, monkeypatch, small):
    monkeypatch.setattr(leaks, "SMALL_ROWS", small)
    r = random.Random(small)
    items = [(f"i{k}", sentence(r, r.choice([5, 12, 13, 14, 40]))) for k in range(20)] + [("none", None), (None, "x " * 20), ("dots", ". , " * 10), ("ones", "a " * 14)]
    docs = []
    for k in range(60):
        text = sentence(r, r.choice([1, 30, 400]))
        if k % 2:
            words = r.choice(items[:20])[1].split()
            n = r.choice([12, 13, 13, 20])
            at = r.randrange(max(1, len(words) - n + 1))
            text = f"{text} {noisy(r, ' '.join(words[at : at + n]))} {sentence(r, 3)}"
        docs.append((k, text))
    docs += [docs[1], (90, None), (91, ""), (92, "."), (None, docs[1][1]), (93, "z" * 300_000 + docs[3][1]), (94, "a" * 13)]
    passages = [(i, "".join(w[j : j + 13])) for i, t in items if i and t for w in [[letters(x) for x in t.split()]] for j in range(len(w) - 12)]
    want = {(k, i) for k, t in docs if k is not None and t for i, p in passages if p and p in letters(t)}
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    e = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, doc_id int")
    got = list(map(tuple, leaks.leaked_items(d, e).collect()))
    assert set(got) == want and len(got) == len(want) and (94, "ones") in want and len(want) > 8
    assert leaks.leaked_items(d.where("false"), e).count() == leaks.leaked_items(d, e.where("false")).count() == 0


@pytest.mark.parametrize("between", [["a"], ["."], ["a", "", "b"]])
def test_passage_after_short_texts(spark, between):
    """Texts are hashed together; a run of equal MinHashes that began before a short text hides nothing after it."""
    r = random.Random(5)
    items = [(f"i{k}", sentence(r, 13)) for k in range(40)]
    texts = [x for _, t in items for x in (sentence(r, 40), *between, t)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = set(map(tuple, leaks.leaked_items(d, spark.createDataFrame(items, "item_id string, text string")).collect()))
    assert got == {(d, i) for d, t in enumerate(texts) for i, p in items if letters(p) in letters(t)} and len(got) >= 40


def test_passages_within_long_runs(spark):
    """Texts whose windows all have the same least shingle: the passage stands anywhere in the run."""
    word = "ab" * 4
    items = [("i", " ".join([word] * 12 + ["abac"]))]
    docs = [(0, word * 700), (1, word * 700 + "ac" + word * 300), (2, word * 11 + "abac"), (3, "x" * 70_000 + word * 9_000 + "ac"), (4, "ac")]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, leaks.leaked_items(d, e).collect())) == [(1, "i"), (3, "i")]


def test_size_classes():
    assert [leaks.size_class(n) for n in (1, 15, 16, 23, 24, 35, 36, 54)] == [1, 15, 16, 16, 24, 24, 36, 54]
    codes = code_points("abcabcabcabcabcabc")
    for size in (1, 3, 5, 15):
        h = leaks.shingle_hashes(codes, size)
        assert len(h) == 18 - size + 1 and (h[0] == h[3] if len(h) > 3 else True)
