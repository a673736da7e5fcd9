"""The path language: reading, checking, and both ways to run it."""

import random
import warnings

import pytest

from trailmill.operators.state import with_state
from trailmill.operators.paths import plan_slices
from trailmill.plans import ProgramError, check, parse, run
from trailmill.plans.declarative import NotDeclarative, plan
from trailmill.plans.fold import additive, operate, to_int

STICKY, TRANSIENT = {"level": "Int", "score": "Float", "on": "Boolean", "plan": "String"}, {"n": "Int", "w": "Float", "tag": "String", "flag": "Boolean"}
RESULT = '[Hashable("id")] [Serializable] class Result { public Int id; public Int count; public Int total; public Float sum; public Int last; public Boolean b; public String s; }'
LOOP = "Cursor c = path.events(); for each (Event e in c) { %s } return;"


def sample(seed=0, n=120):
    r = random.Random(seed)
    pick = lambda *v: r.choice([None, *v])
    return [
        (r.randrange(1, 6), r.randrange(40), i, r.randrange(4), pick(1, 2, -7), pick(0.5, 2.0, -3.25), pick(True, False), pick("a", "b"), pick(3, -5), pick(1.5, 2.75), pick("x"), pick(True, False))
        for i in range(n)
    ]


SCHEMA = "object_id long, ts long, seq long, action_id int, level long, score double, on boolean, plan string, n long, w double, tag string, flag boolean"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def dirty(spark):
    """Many equal times, objects without id, and in each path at most one event of a time without ``seq``."""
    rows, bare = [], set()
    for r in sample(3, 160):
        at = (r[0], r[1] % 6)
        rows.append((r[0] if r[2] % 40 else None, at[1], None if r[2] % 5 == 0 and at not in bare else r[2], *r[3:]))
        bare |= {at} if rows[-1][2] is None else set()
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def both(events, body):
    """A program run both ways, which must agree; its rows by key."""
    text = RESULT + (LOOP % body if "path.events" not in body else body)
    a = [tuple(r) for r in run(text, events, STICKY, TRANSIENT, "declarative").collect()]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        b = [tuple(r) for r in run(text, events, STICKY, TRANSIENT, "fold").collect()]
    assert [r[:3] + r[4:] for r in a] == [r[:3] + r[4:] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b], nan_ok=True)
    assert [r[0] for r in a] == sorted(r[0] for r in a)
    return a


@pytest.mark.parametrize(
    "body",
    [
        "Result r = data.get(e.actionId); r.count = r.count + 1; r.total = r.total + e.level; r.sum = r.sum + e.w;",
        "Result r = data.get(e.level); r.count = r.count - e.n; r.sum = r.sum - e.score;",
        "if (e.on) { Result r = data.get(e.actionId); r.count = r.count + 1; } else if (e.flag) { Result r = data.get(50 + e.actionId); r.count = r.count + 1; } else { Result r = data.get(99); r.count = r.count + 1; }",
        "Result r = data.get(e.actionId); if (e.level == 1) { r.count = r.count + 1; } r.total = r.total + 1;",
        "Result r = data.get(e.actionId); r.last = e.n; r.s = e.tag; r.b = e.flag;",
        "Result r = data.get(e.actionId); if (e.on) { r.last = e.level; } if (e.flag) { r.last = 7; }",
        "Int x = e.level * 3; x = x + 1; if (e.on == e.flag) { x = 0 - x; } Result r = data.get(x); r.count = r.count + 1;",
        "Result r = data.get(e.actionId); r.total = r.total + (e.level + e.score) * 2; r.sum = r.sum + (e.score + e.level) / 2;",
        "Result r = data.get(e.actionId); r.total = r.total + e.n / e.level; r.sum = r.sum + e.w / e.score;",
        "Result r = data.get(0); r.total = r.total + 9223372036854775807 * e.level + 9223372036854775807;",
        'Result a = data.get(1); a.count = a.count + 1; if (e.plan.equals("a")) { Result b = data.get(1); b.count = b.count + 10; } Result d = data.get(2); d.total = d.total + e.n;',
        "Array<Int> a = [e.n, 5]; Result r = data.get(a.getItemAt(0)); r.total = r.total + a.getItemAt(1);",
        "data.get(e.actionId);",
        "Boolean yes = e.score == 2.0; if (yes) { Result r = data.get(1); r.count = r.count + 1; r.count = r.count + 1; }",
        "for each (Event e in path.events()) { Result r = data.get(e.actionId); r.count = r.count + 1; }",
        LOOP % "String s; Int z; Result r = data.get(z); if (s.equals(e.tag)) { r.count = r.count + 1; }",
        LOOP % "Result r = data.get(e.actionId); r.count = r.count + 1; r.total = r.total + e.level; return;",
        "Int p = 0; Cursor c = path.events(); for each (Event e in c) { Result r = data.get(p); r.count = r.count + 1; p = e.actionId; }",
        "Int p = 7; Int k = 5; String t = \"b\"; for each (Event e in path.events()) { if (t.equals(\"b\")) { Result r = data.get(p + k); r.total = r.total + e.level - p; r.last = p; } if (e.on) { p = e.level * 2; } else { p = e.n; } t = e.plan; }",
        "Float w = 1.5; for each (Event e in path.events()) { Result r = data.get(e.actionId); r.sum = r.sum + w; w = e.score; return; }",
        LOOP % "Result r = data.find(e.actionId); if (r == null) { Result n = data.get(e.actionId); n.count = n.count + 10; } else { r.count = r.count + 1; }",
        LOOP % "if (e.flag) { Int k = e.level * 2; Result r = data.find(k); if (r == null) { Result n = data.get(k); n.total = n.total + e.n; } else { r.total = r.total - e.n; if (e.on) { r.count = r.count + 5; } } }",
    ],
)
def test_both_ways_agree(events, body):
    both(events, body)


def random_program(r):
    """Statements of the declarative kind, nested at random."""
    ints, floats, bools = ["e.level", "e.n", "e.actionId"], ["e.score", "e.w"], ["e.on", "e.flag"]

    def number(depth=2):
        if depth and r.random() < 0.6:
            return f"({number(depth - 1)} {r.choice('+-*/')} {number(depth - 1)})"
        return r.choice([*ints, *floats, str(r.randrange(5)), "1.5"])

    def integer():
        return f"({r.choice(ints)} {r.choice('+-*/')} {number(1)})"

    def truth():
        return r.choice([*bools, f"{integer()} == {r.randrange(4)}", f"{r.choice(floats)} == {number(1)}", f"{r.choice(bools)} == {r.choice(bools)}", 'e.plan.equals("a")'])

    def act(v):
        return r.choice([f"{v}.count = {v}.count + 1;", f"{v}.total = {v}.total {r.choice('+-')} {number()};", f"{v}.sum = {v}.sum + {r.choice(floats)};", f"{v}.last = {integer()};"])

    def block(depth, v):
        out = []
        for _ in range(r.randrange(1, 4)):
            if depth and r.random() < 0.35:
                out.append(f"if ({truth()}) {{ {block(depth - 1, v)} }} else {{ {block(depth - 1, v)} }}")
            elif r.random() < 0.2:
                w = f"v{r.randrange(10**6)}"
                out.append(f"Result {w} = data.get({integer()}); {act(w)}")
            else:
                out.append(act(v))
        return " ".join(out)

    return f"Result r = data.get({r.choice(ints)}); {block(2, 'r')}"


@pytest.mark.parametrize("seed", range(12))
def test_random_programs_agree(events, dirty, seed):
    both(dirty if seed % 2 else events, random_program(random.Random(seed)))


@pytest.mark.parametrize(
    "body",
    [
        "Result r = data.get(e.actionId); r.last = e.level; r.total = r.total + e.level;",
        "Int p = 0; for each (Event e in path.events()) { Result r = data.get(e.actionId); r.total = r.total + p; r.last = p; p = e.n; }",
        "for each (Event e in path.events()) { Result r = data.get(e.level); r.total = r.total + e.n; return; }",
        "Result r = data.find(e.actionId); if (r == null) { Result n = data.get(e.actionId); n.total = n.total + e.n; } else { r.count = r.count + 1; }",
    ],
)
def test_missing_seq_and_equal_times(dirty, body, monkeypatch):
    from trailmill.operators import paths

    want = both(dirty, body)
    monkeypatch.setattr(paths, "SLICE_ROWS", 8)
    assert both(dirty, body) == want


def test_values(events):
    rows = sorted(sample(), key=lambda r: (r[0], r[1], -r[2]))
    want, level, obj = {}, 0, None
    for r in rows:
        level = 0 if r[0] != obj else level
        obj, level = r[0], r[4] if r[4] is not None else level
        c, t, s = want.get(r[3], (0, 0, 0.0))
        want[r[3]] = (c + 1, t + level, s + (r[9] or 0.0))
    got = {r[0]: r[1:4] for r in both(events, "Result r = data.get(e.actionId); r.count = r.count + 1; r.total = r.total + e.level; r.sum = r.sum + e.w;")}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and all(got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_partitions_and_slices_do_not_matter(spark, events):
    text = RESULT + LOOP % "Result r = data.get(e.level); r.count = r.count + 1; r.last = e.n;"
    want = [tuple(r) for r in run(text, events, STICKY, TRANSIENT).collect()]
    for n in (1, 2, 7):
        assert [tuple(r) for r in run(text, events.orderBy("seq").repartition(n), STICKY, TRANSIENT).collect()] == want
    slicing = plan_slices(events, 8, time="ts")
    assert slicing
    for tie in ("lifo", "fifo"):
        a, b = (sorted(map(tuple, with_state(events, STICKY, TRANSIENT, tie, s).collect()), key=repr) for s in (None, slicing))
        assert a == b


FOLD_ONLY = {
    "early return": (LOOP % "Result r = data.get(e.actionId); r.count = r.count + 1; if (true) { return; }", True),
    "local across events": ("Int p = 0; Cursor c = path.events(); for each (Event e in c) { Result r = data.get(p); r.count = r.count + 1; p = p * 0 + e.actionId; }", True),
    "product": (LOOP % "Result r = data.get(e.actionId); r.total = (r.total + 1) * 2;", False),
    "find": (LOOP % "Result r = data.find(e.actionId); if (r == null) { Result n = data.get(e.actionId); n.count = n.count + 10; n.last = 0; } else { r.count = r.count + 1; }", False),
    "event assignment": (LOOP % "e.level = e.level + 1; Result r = data.get(e.actionId); r.total = r.total + e.level;", True),
    "two passes": ("Int k = 0; for each (Event e in path.events()) { k = k + 1; } for each (Event f in path.events()) { Result r = data.get(k); r.count = r.count + 1; }", True),
    "added and overwritten": (LOOP % "Result r = data.get(e.actionId); r.total = r.total + 1; r.total = e.n;", False),
    "while by hand": ("Cursor c = path.events(); Event e; c.next(e); Result r = data.get(e.actionId); r.count = r.count + 1;", True),
}


@pytest.mark.parametrize("name", FOLD_ONLY)
def test_fold(events, name):
    text, sums = FOLD_ONLY[name]
    program = check(parse(RESULT + text), STICKY, TRANSIENT)
    with pytest.raises(NotDeclarative):
        plan(program, events)
    assert additive(program) == sums
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = {r.id: r for r in run(RESULT + text, events, STICKY, TRANSIENT).collect()}
    assert any("order of paths" in str(w.message) for w in said) != sums
    rows, paths = sorted(sample(), key=lambda r: (r[0], r[1], -r[2])), {}
    for r in rows:
        paths.setdefault(r[0], []).append(r)
    if name in ("early return", "while by hand"):
        assert sum(r["count"] for r in got.values()) == len(paths)
    elif name == "find":
        assert {k: r["count"] for k, r in got.items()} == {a: sum(r[3] == a for r in rows) + 9 for a in {r[3] for r in rows}}
    elif name == "local across events":
        want = {}
        for path in paths.values():
            for p in [0, *(r[3] for r in path[:-1])]:
                want[p] = want.get(p, 0) + 1
        assert {k: r["count"] for k, r in got.items()} == want
    elif name == "two passes":
        assert {k: r["count"] for k, r in got.items()} == {n: n * sum(len(p) == n for p in paths.values()) for n in {len(p) for p in paths.values()}}
    elif name == "event assignment":
        want = {}
        for path in paths.values():
            level = 0
            for r in path:
                level = (r[4] if r[4] is not None else level) + 1
                want[r[3]] = want.get(r[3], 0) + level
        assert {k: r["total"] for k, r in got.items()} == want


def test_classes_methods_and_functions(events):
    text = RESULT + """
    class Counter<T> {
      private T last; private Int n;
      public void init() { this.n = 100; return; }
      public Int add(T x) { this.last = x; this.n = this.n + 1; return this.n; }
      public Int apply(Function<Int a, Int b : Int> f) { return f(this.n, 2); }
      public void visit(Function<Int v : void> f) { f(this.n); return; }
      public void destroy() { this.n = 0; return; }
    }
    [Enumerable] class Range { public Int at; public Int to; public Boolean eof() { return this.at == this.to; } public void next(Range r) { r.at = this.at; this.at = this.at + 1; return; } }
    Counter<Int> k;
    Range range; range.to = 3;
    Int seen = 0;
    for each (Range i in range) { seen = seen * 10 + i.at; }
    Int twice = k.apply(function(a, b):Int { return a * b; });
    Int out = 0;
    k.visit(:out = v);
    Array<Int> xs = [1, 2, 3]; xs.setItemAt(9, 1);
    Event e;
    Result r = data.get(1); r.count = r.count + 1; r.total = r.total + k.add(5); r.last = r.last + seen * 1000 + twice + out + xs.getItemAt(1);
    return;"""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        (row,) = run(text, events, STICKY, TRANSIENT).collect()
    assert (row.id, row["count"], row.total, row.last) == (1, 5, 5 * 101, 5 * (12_000 + 200 + 100 + 9))


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("Cursor c = path.events();", "Result"),
        (RESULT, "must use class 'Event'"),
        (RESULT + LOOP % "Int x = e.level + e.on;", "Int and Boolean do not fit"),
        (RESULT + LOOP % "Boolean x = e.plan == e.plan;", "String and String do not fit"),
        (RESULT + LOOP % "Boolean x = e.on + e.on;", "do not fit"),
        (RESULT + LOOP % "Int x = e.score;", "Int and Float do not fit"),
        (RESULT + LOOP % "data.get(1) = 5;", "no place to assign to"),
        (RESULT + LOOP % "Int x = e.nothing;", "Unknown property"),
        (RESULT + LOOP % "Int x = y;", "Unknown variable"),
        (RESULT + LOOP % "if (e.level) { }", "must be a Boolean"),
        (RESULT + LOOP % "Int x = sizeof(Int);", "sizeof"),
        (RESULT + LOOP % "Int x = offsetof(e.level);", "offsetof"),
        (RESULT + LOOP % "Thing x;", "Unknown type"),
        (RESULT + LOOP % "data.get(e.plan);", "do not fit"),
        (RESULT + LOOP % "data.take(1);", "Unknown method"),
        (RESULT + "for each (Event e in 5) { }", "nothing to go through"),
        (RESULT + "for each (Event e in path) { }", "no .Enumerable. class"),
        (RESULT + "Event e; Ref r;", "a Ref stands"),
        (RESULT + "[Dynamic] class A { } Event e;", "Dynamic"),
        (RESULT + "[Enumerable] class A { } Event e;", "eof"),
        (RESULT + "class A { public Int f(); } Event e;", "without statements"),
        (RESULT + 'class A { [External("x")] public Int f(); } Event e;', "External"),
        (RESULT + "class A { public Int init() { return 1; } } Event e;", "Constructor"),
        (RESULT.replace('"id"', '""') + "Event e;", "names no property"),
        (RESULT.replace("[Serializable]", "") + "Event e;", "Serializable"),
        (RESULT + "Int x = 5", "expected ';'"),
        (RESULT + "Int x = 5 % 2;", "unexpected character"),
        (RESULT + "Int x = -5;", "expected"),
        (RESULT + 'String s = "open;', "unexpected character"),
        (RESULT + "if (true) return;", "expected"),
        (RESULT + "1 = 2;", "can be assigned"),
    ],
)
def test_mistakes(text, message):
    with pytest.raises(ProgramError, match=message):
        check(parse(text), STICKY, TRANSIENT)


def test_precedence_and_comments():
    (s,) = parse('Boolean b = 1 + 2 * 3 - 4 == 5 / (6 + 7) ; // "x"\n/* two\nlines */').body
    show = lambda e: f"({show(e.left)}{e.op}{show(e.right)})" if hasattr(e, "op") else str(e.value)
    assert show(s.init) == "(((1+(2*3))-4)==(5/(6+7)))"


def test_numbers():
    top, low = 2**63 - 1, -(2**63)
    assert operate("+", top, 1, "Int") == low and operate("*", top, 2, "Int") == -2 and operate("/", -7, 2, "Int") == -3
    assert operate("/", low, -1, "Int") == low and operate("/", 5, 0, "Int") == 0
    nan, inf = float("nan"), float("inf")
    assert operate("==", nan, nan, "Float") is False and operate("/", 1.0, 0.0, "Float") == inf
    assert [to_int(x) for x in (2.9, -2.9, nan, inf, -inf, 1e300)] == [2, -2, 0, top, low, top]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for strategy in ("declarative", "fold"):
        assert run(RESULT + LOOP % "Result r = data.get(e.level); r.count = r.count + 1;", empty, STICKY, TRANSIENT, strategy).count() == 0
