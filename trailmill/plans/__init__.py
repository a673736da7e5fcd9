"""The path language: programs that are called once per path and fold into groups.

A program declares a class ``Result`` (its key named by ``[Hashable("key")]``,
marked ``[Serializable]``) and runs statements with ``path`` and ``data``
(``Map<Int,Result>``) in reach::

    [Hashable("id")]
    [Serializable]
    class Result { public Int id; public Int count; }
    Cursor cursor = path.events();
    for each (Event e in cursor) {
      Result r = data.get(e.actionId);
      r.count = r.count + 1;
    }
    return;

``run`` parses and checks a program and, where it can prove that the order of
paths and events does not matter, turns it into a window and an aggregation
(``declarative``); the rest is interpreted path by path (``fold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .check import Program, ProgramError, check
from .declarative import NotDeclarative, plan
from .fold import fold
from .parser import parse

__all__ = ["Program", "ProgramError", "check", "parse", "plan", "run"]


def run(text: str, events: DataFrame, sticky: dict[str, str], transient: dict[str, str], strategy: str = "auto") -> DataFrame:
    """Groups of a program over all paths, by ascending key: the ``Int`` and ``Float`` fields of ``Result`` as declared.

    ``events`` have ``object_id, ts, seq, action_id`` and the property columns
    (``sticky`` object, ``transient`` action properties with data types).
    ``strategy``: ``declarative`` (an error if that cannot be proved),
    ``fold`` or ``auto``.
    """
    program = check(parse(text), sticky, transient)
    if strategy != "fold":
        try:
            return plan(program, events)
        except NotDeclarative:
            if strategy == "declarative":
                raise
    return fold(program, events)
