"""Path programs interpreted event by event.

Paths stream through tasks in order, so no path is held in memory unless the
program reads it more than once.  If groups are only added to, tasks fold
their own paths and the partial groups are summed; else all paths pass through
one task by ascending object, since each may see what the others left.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import wrapping
from ..types import ZERO
from .check import EVENT, RESULT, Program
from .declarative import added_to
from .syntax import (
    ArrayOf, Assign, Binary, Call, ClassDef, Expr, ExprStmt, ForEach, If, Lambda, Literal, Member, Name, Node, Return, Type, VarDecl,
)

SPARK = {"Int": "long", "Float": "double"}


def wrap(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def to_int(x: float) -> int:
    """A decimal cut off to an Int, at most the greatest or least one; NaN gives 0."""
    return 0 if x != x else max(-(2**63), min(2**63 - 1, int(x))) if abs(x) != float("inf") else (2**63 - 1 if x > 0 else -(2**63))


def convert(value: object, source: str, target: str) -> object:
    if source == target:
        return value
    if target == "Int":
        return to_int(value) if source == "Float" else int(value)
    if target == "Float":
        return float(value)
    return bool((to_int(value) if source == "Float" else value) & 1)


def operate(op: str, a: object, b: object, kind: str) -> object:
    if op == "==":
        return a == b
    if kind == "Int":
        if op == "/":
            return wrap(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)) if b else 0
        return wrap(a + b if op == "+" else a - b if op == "-" else a * b)
    if op == "/":
        if b:
            return a / b
        return float("nan") if a == 0 or a != a else float("inf") if a > 0 else float("-inf")
    try:
        return a + b if op == "+" else a - b if op == "-" else a * b
    except OverflowError:
        return float("inf")


class Object:
    __slots__ = ("type", "fields")

    def __init__(self, type: Type, fields: dict):
        self.type, self.fields = type, fields


class Groups:
    """The shared map; elements are made on demand with their key set."""

    def __init__(self, program: Program):
        self.program, self.elements = program, {}

    def zero(self) -> Object:
        return Object(RESULT, {n: ZERO.get(t.name) for n, t in self.program.fields.items()})

    def get(self, key: int) -> Object:
        if key not in self.elements:
            element = self.zero()
            element.fields[self.program.key] = key
            self.elements[key] = element
        return self.elements[key]


class Cursor:
    """Forward over events; each event updates the state of its object."""

    def __init__(self, program: Program, rows: Iterator[tuple], columns: list[str]):
        self.program, self.rows, self.columns = program, iter(rows), columns
        self.ahead = next(self.rows, None)

    def eof(self) -> bool:
        return self.ahead is None

    def next(self, event: Object) -> None:
        row, self.ahead = self.ahead, next(self.rows, None)
        for n, t in self.program.transient.items():
            event.fields[n] = ZERO[t]
        if row is not None:
            event.fields["actionId"] = row[0] or 0
            for n, v in zip(self.columns, row[1:]):
                if v is not None:
                    event.fields[n] = v


class _Returned(Exception):
    def __init__(self, value: object):
        self.value = value


class Interpreter:
    def __init__(self, program: Program, columns: list[str], groups: Groups):
        self.program, self.columns, self.groups = program, columns, groups

    def path(self, rows: Iterator[tuple]) -> None:
        """Call the program for one path."""
        try:
            self.block(self.program.module.body, {"path": rows, "data": self.groups})
        except _Returned:
            pass

    # Objects

    def definition(self, t: Type) -> ClassDef | None:
        return self.program.classes.get(str(t)) or self.program.classes.get(t.name)

    def make(self, t: Type) -> object:
        """A variable without value: a zero, or an object whose constructor has run."""
        if t.name in ZERO:
            return ZERO[t.name]
        if t == EVENT:
            return Object(t, {"actionId": 0} | {n: ZERO[k] for n, k in (self.program.sticky | self.program.transient).items()})
        if t.name == "Array":
            return []
        c = self.definition(t)
        if c is None:
            return None
        found = Object(t, {p.name: ZERO.get(p.type.name) for p in c.properties})
        self.method(found, "init", [], optional=True)
        return found

    def method(self, this: Object, name: str, args: list, optional: bool = False) -> object:
        c = self.definition(this.type)
        found = next((m for m in c.methods if m.name == name), None) if c else None
        if found is None:
            if optional:
                return None
            raise RuntimeError(f"{this.type} has no method {name}")
        return self.call(found.body, {"this": this} | {n: v for (_, n), v in zip(found.args, args)})

    def call(self, body: list[Node], scope: dict) -> object:
        try:
            self.block(body, scope)
        except _Returned as r:
            return r.value
        return None

    # Statements

    def block(self, body: list[Node], outer: dict) -> None:
        scope = _Scope(outer)
        made = []
        try:
            for s in body:
                if isinstance(s, VarDecl):
                    value = self.expr(s.init, scope) if s.init is not None else self.make(s.type)
                    scope.declare(s.name, value)
                    if s.init is None and isinstance(value, Object):
                        made.append(value)
                elif isinstance(s, Assign):
                    value = self.expr(s.value, scope)
                    if isinstance(s.target, Name):
                        scope.assign(s.target.name, value)
                    else:
                        self.expr(s.target.base, scope).fields[s.target.name] = value
                elif isinstance(s, If):
                    for condition, inner in s.branches:
                        if self.expr(condition, scope):
                            self.block(inner, scope)
                            break
                    else:
                        self.block(s.orelse, scope)
                elif isinstance(s, ForEach):
                    self.loop(s, scope)
                elif isinstance(s, Return):
                    raise _Returned(self.expr(s.value, scope) if s.value is not None else None)
                elif isinstance(s, ExprStmt):
                    self.expr(s.expr, scope)
        finally:
            for value in reversed(made):
                self.method(value, "destroy", [], optional=True)

    def loop(self, s: ForEach, scope: dict) -> None:
        source = self.expr(s.source, scope)
        item = self.make(s.type)
        inner = _Scope(scope)
        inner.declare(s.name, item)
        while True:
            if isinstance(source, Cursor):
                if source.eof():
                    return
                source.next(item)
            else:
                if self.method(source, "eof", []):
                    return
                self.method(source, "next", [item])
            self.block(s.body, inner)

    # Expressions

    def expr(self, e: Expr, scope: dict) -> object:
        if isinstance(e, Literal):
            return wrap(e.value) if e.type.name == "Int" else e.value
        if isinstance(e, Name):
            return scope[e.name]
        if isinstance(e, Member):
            return self.expr(e.base, scope).fields[e.name]
        if isinstance(e, Binary):
            left = self.expr(e.left, scope)
            if e.right.type.name == "null":
                return left is None
            return operate(e.op, left, convert(self.expr(e.right, scope), e.right.type.name, e.left.type.name), e.left.type.name)
        if isinstance(e, ArrayOf):
            return [self.expr(i, scope) for i in e.items]
        if isinstance(e, Lambda):
            names = [n for _, n in e.args]
            return lambda *args: self.call(e.body, _Scope(scope, dict(zip(names, args))))
        return self.invoke(e, scope)

    def invoke(self, e: Call, scope: dict) -> object:
        args = [self.expr(a, scope) for a in e.args]
        if e.base is None:
            return scope[e.name](*args)
        base = self.expr(e.base, scope)
        if isinstance(base, Object):
            return self.method(base, e.name, args)
        if isinstance(base, Groups):
            return base.get(args[0]) if e.name == "get" else base.elements.get(args[0])
        if isinstance(base, Cursor):
            return base.eof() if e.name == "eof" else base.next(args[0])
        if isinstance(base, str):
            return base == args[0]
        if isinstance(base, list) and e.base.type.name == "Array":
            at = args[-1]
            if e.name == "setItemAt":
                if 0 <= at < len(base):
                    base[at] = args[0]
                return None
            return base[at] if 0 <= at < len(base) else ZERO.get(e.type.name)
        return Cursor(self.program, base() if callable(base) else base, self.columns)  # path.events()


class _Scope(dict):
    """Variables of a block; those of the blocks around it are reached and assigned through it."""

    def __init__(self, outer: dict, own: dict | None = None):
        super().__init__(own or {})
        self.outer = outer

    def __missing__(self, name: str) -> object:
        return self.outer[name]

    def declare(self, name: str, value: object) -> None:
        self[name] = value

    def assign(self, name: str, value: object) -> None:
        if name in self or not isinstance(self.outer, _Scope):
            (self if name in self else self.outer)[name] = value
        else:
            self.outer.assign(name, value)


def nodes(x: object) -> Iterator[Node]:
    """All nodes of a tree."""
    if isinstance(x, (list, tuple)):
        for i in x:
            yield from nodes(i)
    elif isinstance(x, (Node, ClassDef)):
        yield x
        for v in vars(x).values():
            if isinstance(v, (list, tuple, Node)):
                yield from nodes(v)


def additive(program: Program) -> bool:
    """Whether groups are only got and added to, so that partial groups can be summed."""
    allowed: set[int] = set()
    every = list(nodes([*program.module.classes, *program.module.body]))
    for s in every:
        if isinstance(s, VarDecl) and s.type == RESULT and isinstance(s.init, Call) and isinstance(s.init.base, Name) and s.init.base.name == "data" and s.init.name == "get":
            allowed |= {id(s.init.base), id(s.init)}
        if isinstance(s, Assign) and isinstance(s.target, Member) and s.target.base.type == RESULT:
            own, (left, terms) = s.target, added_to(s.value)
            same = isinstance(left, Member) and isinstance(own.base, Name) and isinstance(left.base, Name) and own.base.name == left.base.name and own.name == left.name
            if terms and same and own.name != program.key:
                allowed |= {id(own), id(own.base), id(left), id(left.base)}
    for e in every:
        touches = isinstance(e, Expr) and (e.type == RESULT or e.type.name == "Map" or isinstance(e, Member) and e.base.type == RESULT)
        if touches and id(e) not in allowed:
            return False
    return True


def fold(program: Program, events: DataFrame) -> DataFrame:
    """Groups of the program, by ascending key."""
    spark = events.sparkSession
    columns = [n for n in (program.sticky | program.transient) if n in program.used]
    output = [(n, program.fields[n].name) for n in program.output]
    sites = sum(isinstance(e, Call) and e.name == "events" for e in nodes([*program.module.classes, *program.module.body]))
    buffered = sites > 1 or any(isinstance(n, ForEach) and any(isinstance(e, Call) and e.name == "events" for e in nodes(n.body)) for n in nodes(program.module.body))
    parallel = additive(program)
    rows = events.select("object_id", "ts", "seq", F.coalesce("action_id", F.lit(0)).alias("action_id"), *columns).where(F.col("object_id").isNotNull())
    if parallel:
        rows = rows.repartition("object_id")
    else:
        warnings.warn("this program depends on the order of paths: one task folds them all", stacklevel=3)
        rows = rows.repartition(1)
    rows = rows.sortWithinPartitions("object_id", "ts", F.col("seq").desc_nulls_last()).select("object_id", "action_id", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(program)
        interpreter = Interpreter(program, columns, groups)
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        ahead = next(stream, None)

        def one_path(object_id: int) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == object_id:
                row, ahead = ahead, next(stream, None)
                yield row[1:]

        while ahead is not None:
            object_id = ahead[0]
            path = one_path(object_id)
            if buffered:
                kept = list(path)
                interpreter.path(lambda kept=kept: iter(kept))
            else:
                interpreter.path(path)
                for _ in path:  # what an early return left
                    pass
        arrays = [pa.array([g.fields[n] for g in groups.elements.values()], pa.int64() if t == "Int" else pa.float64()) for n, t in output]
        yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in output])

    folded = rows.mapInArrow(run, ", ".join(f"`{n}` {SPARK[t]}" for n, t in output))
    if parallel:
        with wrapping(spark):
            sums = [F.sum(n).alias(n) for n, _ in output if n != program.key]
            folded = folded.groupBy(program.key).agg(*sums) if sums else folded.distinct()
            folded = folded.select(*(n for n, _ in output))
    return folded.orderBy(program.key)
