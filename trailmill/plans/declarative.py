"""Path programs as windows and an aggregation.

A program qualifies if it is one loop over the path's events whose groups are
only added to or overwritten.  Its fields then are sums, or the value written
last in the order of object, time and arrival.  What an event takes from
others must be one of these:

* object properties, the last value along the path;
* a local from before the loop that each event sets to an expression of its
  own: the value of the event before (``lag``);
* a ``return`` at the end of the loop: only the first event counts;
* ``data.find`` of a key whose missing group is then got: only the first event
  of all with that key finds nothing, and ``min_by`` tells it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import binary, cast, wrapping
from ..operators.paths import plan_slices
from ..operators.state import with_previous, with_state
from .check import CURSOR, EVENT, RESULT, Program
from .syntax import ArrayOf, Assign, Binary, Call, Expr, ExprStmt, ForEach, If, Literal, Member, Name, Node, Return, Type, VarDecl

SPARK = {"Int": "long", "Float": "double", "Boolean": "boolean", "String": "string"}


class NotDeclarative(ValueError):
    """The program must be folded in order; the message says why."""


@dataclass
class Site:
    """One ``data.get(key)``: which rows reach it and what is done to the group."""

    guard: Column | None
    key: Column
    sums: dict[str, Column] = field(default_factory=dict)
    writes: dict[str, tuple[Column, Column]] = field(default_factory=dict)  # value, whether written
    first: Site | None = None  # after ``data.find``: what the first event does in place of all this


def added_to(e: Expr) -> tuple[Expr, list[tuple[str, Expr]]]:
    """What a chain of ``+`` and ``-`` starts from, and its further terms in order."""
    terms = []
    while isinstance(e, Binary) and e.op in "+-":
        terms.append((e.op, e.right))
        e = e.left
    return e, terms[::-1]


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


class _Body:
    def __init__(self, program: Program, event: str):
        self.program, self.event, self.sites = program, event, []
        self.forms: dict[str, str] = {}
        self.found: Site | None = None

    def expr(self, e: Expr, env: dict[str, object]) -> Column:
        if isinstance(e, Literal) and e.type.name in SPARK:
            value = e.value
            if e.type.name == "Int":
                value = (value + 2**63) % 2**64 - 2**63
            return F.lit(value).cast(SPARK[e.type.name])
        if isinstance(e, Name) and isinstance(env.get(e.name), Column):
            return env[e.name]
        if isinstance(e, Member) and isinstance(e.base, Name) and env.get(e.base.name) is EVENT:
            return F.col("action_id").cast("long") if e.name == "actionId" else F.col(f"`{e.name}`")
        if isinstance(e, Binary) and e.left.type.name in SPARK and e.right.type.name in SPARK:
            left, right = self.expr(e.left, env), self.expr(e.right, env)
            return binary(e.op, left, cast(right, e.right.type.name, e.left.type.name), e.left.type.name)
        if isinstance(e, Call) and e.base is not None and e.base.type == Type("String") and e.name == "equals":
            return self.expr(e.base, env) == self.expr(e.args[0], env)
        if isinstance(e, Call) and e.name == "getItemAt" and isinstance(e.base, Name) and isinstance(env.get(e.base.name), list):
            items, at = env[e.base.name], e.args[0]
            if isinstance(at, Literal) and 0 <= at.value < len(items):
                return items[at.value]
        raise NotDeclarative(f"line {e.line}: not an expression of the event alone")

    def block(self, body: list[Node], env: dict[str, object], guard: Column | None) -> dict[str, object]:
        """Run statements symbolically; the variables after them."""
        env = dict(env)
        for s in body:
            if isinstance(s, VarDecl):
                env[s.name] = self.declared(s, env, guard)
            elif isinstance(s, Assign):
                self.assigned(s, env, guard)
            elif isinstance(s, If) and self.missing(s, env):
                self.looked_up(s, env, guard)
            elif isinstance(s, If):
                env |= self.branched(s, env, guard)
            elif isinstance(s, ExprStmt) and self.is_get(s.expr):
                self.sites.append(Site(guard, self.expr(s.expr.args[0], env)))
            else:
                raise NotDeclarative(f"line {s.line}: the loop does more than look at its event")
        return env

    def is_get(self, e: Expr | None, name: str = "get") -> bool:
        return isinstance(e, Call) and isinstance(e.base, Name) and e.base.name == "data" and e.name == name

    def missing(self, s: If, env: dict[str, object]) -> bool:
        """Whether it asks only if ``data.find`` found nothing."""
        c = s.branches[0][0]
        return len(s.branches) == 1 and isinstance(c, Binary) and c.right.type.name == "null" and isinstance(c.left, Name) and isinstance(env.get(c.left.name), Site) and env[c.left.name] is self.found

    def looked_up(self, s: If, env: dict[str, object], guard: Column | None) -> None:
        """Both branches of the question; afterwards the group has been made."""
        site, name = self.found, s.branches[0][0].left.name
        if guard is not site.guard or site.first is not None:
            raise NotDeclarative(f"line {s.line}: what was found is asked for elsewhere")
        before = len(self.sites)
        self.block(s.branches[0][1], {k: v for k, v in env.items() if k != name}, guard)
        made = self.sites[before:]
        if len(made) != 1 or made[0].guard is not guard or str(made[0].key) != str(site.key) or made[0].writes:
            raise NotDeclarative(f"line {s.line}: a missing group is not just got and added to")
        self.sites[before:] = []
        site.first = made[0]
        self.block(s.orelse, env, guard)
        if site.writes or len(self.sites) != 1 or any(self.program.fields[n].name != "Int" for n in (*site.sums, *made[0].sums)):
            raise NotDeclarative(f"line {s.line}: groups are also used in another way")
        del env[name]

    def declared(self, s: VarDecl, env: dict[str, object], guard: Column | None) -> object:
        if s.type == RESULT and self.is_get(s.init):
            site = Site(guard, self.expr(s.init.args[0], env))
            self.sites.append(site)
            return site
        if s.type == RESULT and self.is_get(s.init, "find") and not self.sites:
            self.found = Site(guard, self.expr(s.init.args[0], env))
            self.sites.append(self.found)
            return self.found
        if isinstance(s.init, ArrayOf):
            return [self.expr(i, env) for i in s.init.items]
        if s.type.name not in SPARK:
            raise NotDeclarative(f"line {s.line}: a local object")
        if s.init is None:
            return F.lit({"Int": 0, "Float": 0.0, "Boolean": False, "String": ""}[s.type.name]).cast(SPARK[s.type.name])
        return self.expr(s.init, env)

    def branched(self, s: If, env: dict[str, object], guard: Column | None) -> dict[str, object]:
        outcomes, no = [], None
        for condition, inner in s.branches:
            yes = self.expr(condition, env)
            here = yes if no is None else no & yes
            outcomes.append((here, self.block(inner, env, _both(guard, here))))
            no = ~yes if no is None else no & ~yes
        outcomes.append((no, self.block(s.orelse, env, _both(guard, no))))
        merged = {}
        for name, old in env.items():
            if isinstance(old, Column) and any(after[name] is not old for _, after in outcomes):
                value = outcomes[-1][1][name]
                for here, after in reversed(outcomes[:-1]):
                    value = F.when(here, after[name]).otherwise(value)
                merged[name] = value
        return merged

    def assigned(self, s: Assign, env: dict[str, object], guard: Column | None) -> None:
        if isinstance(s.target, Name) and isinstance(env.get(s.target.name), Column):
            env[s.target.name] = self.expr(s.value, env)
            return
        site = env.get(s.target.base.name) if isinstance(s.target, Member) and isinstance(s.target.base, Name) else None
        if not isinstance(site, Site) or s.target.name == self.program.key or site is self.found and site.first is None:
            raise NotDeclarative(f"line {s.line}: an assignment to something else than a group's field")
        name, kind = s.target.name, self.program.fields[s.target.name].name
        if kind not in SPARK:
            raise NotDeclarative(f"line {s.line}: a field of an object type")
        is_self = lambda e: isinstance(e, Member) and isinstance(e.base, Name) and env.get(e.base.name) is site and e.name == name
        start, addends = added_to(s.value)
        if addends and is_self(start):
            form, value = "sum", None
            for op, e in addends:
                term = cast(self.expr(e, env), e.type.name, kind)
                value = (-term if op == "-" else term) if value is None else binary(op, value, term, kind)
            # Within the site's own guard nothing more needs to be tested.
            value = value if guard is site.guard else F.when(guard, value).otherwise(F.lit(0).cast(SPARK[kind]))
            site.sums[name] = site.sums[name] + value if name in site.sums else value
        else:
            form, value = "write", self.expr(s.value, env)
            written = F.lit(True) if guard is site.guard else guard
            if name in site.writes:
                old, was = site.writes[name]
                value, written = F.when(written, value).otherwise(old), written | was
            site.writes[name] = (value, written)
        if self.forms.setdefault(name, form) != form:
            raise NotDeclarative(f"line {s.line}: a field both added to and overwritten")


def _loop(program: Program) -> tuple[list[VarDecl], ForEach]:
    """Locals from before the loop, and the loop."""
    body = list(program.module.body)
    if body and isinstance(body[-1], Return) and body[-1].value is None:
        body.pop()
    is_events = lambda e: isinstance(e, Call) and e.name == "events" and isinstance(e.base, Name) and e.base.name == "path"
    cursors, carried = [], []
    while len(body) > 1 and isinstance(body[0], VarDecl):
        s = body.pop(0)
        if s.type == CURSOR and is_events(s.init) and not cursors:
            cursors.append(s.name)
        elif s.type.name in SPARK:
            carried.append(s)
        else:
            raise NotDeclarative(f"line {s.line}: an object from before the loop")
    if len(body) == 1 and isinstance(body[0], ForEach) and body[0].type == EVENT:
        loop = body[0]
        if is_events(loop.source) and not cursors or isinstance(loop.source, Name) and loop.source.name in cursors:
            return carried, loop
    raise NotDeclarative("the program is not one loop over the path's events")


def plan(program: Program, events: DataFrame) -> DataFrame:
    """The program as a DataFrame; ``NotDeclarative`` if it cannot be proved to be one."""
    carried, loop = _loop(program)
    body = _Body(program, loop.name)
    spark = events.sparkSession
    with wrapping(spark):
        env: dict[str, object] = {}
        for s in carried:
            env[s.name] = body.declared(s, env, None)
        begin = {name: (f"__carried_{i}__", value) for i, (name, value) in enumerate(env.items())}
        statements, guard = list(loop.body), None
        if statements and isinstance(statements[-1], Return) and statements[-1].value is None:
            statements.pop()
            begin["return"] = ("__returned__", F.lit(False))  # no name of a local
            guard = ~F.col("__returned__")
        env = {name: F.col(column) for name, (column, _) in begin.items()} | {loop.name: EVENT}
        after = body.block(statements, env, guard) | ({"return": F.lit(True)} if guard is not None else {})
        if body.found is not None and body.found.first is None:
            raise NotDeclarative("it does not matter whether a group was found")
        constant = {n for n in begin if after[n] is env[n]}
        for name in set(begin) - constant:
            if any(column in str(after[name]) for n, (column, _) in begin.items() if n not in constant):
                raise NotDeclarative(f"{name} depends on more than the event before")
        sticky = {n: t for n, t in program.sticky.items() if n in program.used}
        transient = {n: t for n, t in program.transient.items() if n in program.used}
        rows = events.where(F.col("object_id").isNotNull()).select("object_id", "ts", "seq", F.coalesce("action_id", F.lit(0)).alias("action_id"), *sticky, *transient)
        slicing = plan_slices(rows, time="ts") if sticky or len(constant) < len(begin) else None
        rows = with_state(rows, sticky, transient, slicing=slicing)
        rows = rows.withColumns({begin[n][0]: begin[n][1] for n in begin if n in constant}) if constant else rows
        if moving := [n for n in begin if n not in constant]:
            rows = with_previous(rows, {begin[n][0]: after[n] for n in moving}, slicing=slicing)
            rows = rows.withColumns({begin[n][0]: F.coalesce(begin[n][0], begin[n][1]) for n in moving})

        numbers = {n: SPARK[program.fields[n].name] for n in program.output if n != program.key}
        sums = [n for n in numbers if body.forms.get(n) == "sum"]
        writes = [n for n in numbers if body.forms.get(n) == "write"]

        def columns(i: int, site: Site) -> list[Column]:
            nothing = lambda n: F.lit(None).cast(numbers[n])
            return [
                site.key.alias("_key"),
                *((site.sums[n] if n in site.sums else nothing(n)).alias(f"_s_{n}") for n in sums),
                *((firsts(site, n) if site.first else nothing(n)).alias(f"_f_{n}") for n in sums if body.found),
                *((F.when(site.writes[n][1], site.writes[n][0]) if n in site.writes else nothing(n)).alias(f"_w_{n}") for n in writes),
                *([F.struct("object_id", "ts", F.coalesce(-F.col("seq"), F.lit(2**63 - 1)).alias("no"), F.lit(i).alias("site")).alias("_order")] if writes or body.found else []),
            ]

        def firsts(site: Site, n: str) -> Column:
            """What the first event adds beyond what every event does."""
            zero = F.lit(0).cast(numbers[n])
            return site.first.sums.get(n, zero) - site.sums.get(n, zero)

        if not body.sites:
            rows = rows.select(*columns(0, Site(None, F.lit(0).cast("long")))).where(F.lit(False))
        elif len(body.sites) == 1:
            site = body.sites[0]
            rows = (rows if site.guard is None else rows.where(site.guard)).select(*columns(0, site))
        else:
            reached = [F.struct(*columns(i, s)) if s.guard is None else F.when(s.guard, F.struct(*columns(i, s))) for i, s in enumerate(body.sites)]
            rows = rows.select(F.explode(F.array_compact(F.array(*reached))).alias("_r")).select("_r.*")

        zero = lambda n: F.lit(0).cast(numbers[n])
        total = {n: F.coalesce(F.sum(f"_s_{n}"), zero(n)) for n in sums}
        if body.found:
            total = {n: t + F.min_by(f"_f_{n}", "_order") for n, t in total.items()}
        aggregates = [total[n].alias(n) for n in sums]
        aggregates += [F.coalesce(F.max_by(f"_w_{n}", F.when(F.col(f"_w_{n}").isNotNull(), F.col("_order"))), F.lit(0).cast(numbers[n])).alias(n) for n in writes]
        grouped = rows.groupBy("_key")
        groups = grouped.agg(*aggregates) if aggregates else rows.select("_key").distinct()
        rest = {n: F.lit(0).cast(t).alias(n) for n, t in numbers.items() if n not in body.forms}
        return groups.select(*(F.col("_key").alias(n) if n == program.key else rest.get(n, F.col(n)) for n in program.output)).orderBy(program.key)
