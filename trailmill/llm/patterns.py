"""Closed frequent subsequences of actions across many paths.

A path supports a pattern if events with its actions stand in path order, each
at most ``gap`` after the step before; other events may lie between.  Leaving
out an inner step can break the gap, so what a pattern implies are its
contiguous parts, and a pattern is *closed* if neither a step before it nor a
step after it keeps its support.  The supports of all frequent patterns follow
from the closed ones: a part's support is the greatest among the closed
patterns that contain it.

Paths are packed once into arrays, one row per path or per slice of a long
one, and written to the shared folder.  Tasks grow prefixes over pseudo-projections:
the projection of a prefix is the array of positions where it ends, made from
that of the prefix one step shorter, one first item after the other, and
nothing is copied.  With it goes, for each end, the set of items that could
stand one step before the whole prefix there.  From both come the checks in
both directions: the items after the ends give the supports of the forward
extensions, the sets give those of the backward extensions, and an item in the
sets of all ends ends the growth of the prefix (backscan).  As support is
counted over all paths, prefixes of one length are grown in one pass and only
counts leave a task; which prefixes are closed and which grow on is known
when the pass ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paths import Slicing, plan_slices, valid_events
from ..session import collect_small, stored

MINUTE = 60_000_000
COUNTS = "pattern long, object_id long, objects long, ends long"
#: Counts that may come to the driver of one pass: frequent extensions of the prefixes that still grow.
MOST_PATTERNS = 1_000_000
#: Events of one object that are packed into one row, and of all rows that a task looks at together.
SLICE_EVENTS, BLOCK_EVENTS = 100_000, 1_000_000
FORWARD, BACKWARD, BACKSCAN = 0, 1, 2


def packed_paths(events: DataFrame, span: int, slicing: Slicing) -> DataFrame:
    """Paths of events with action as arrays: ``object_id, sliced, n_context, ts, action``.

    Slices of long paths begin with the events of the ``span`` before them
    (``n_context`` many), so that every occurrence that ends in a slice lies
    wholly in its arrays.
    """
    e = valid_events(events).where(F.col("action_id") > 0)
    if slicing:
        e = slicing.add(slicing.add(e).withColumn("_until_ts", F.col("ts") + span), "_until_ts", "_until")
        e = e.withColumn("at", F.explode(F.sequence("slice", "_until"))).withColumn("context", F.col("at") > F.col("slice"))
        e = e.select("object_id", (F.col("slice") > 0).alias("sliced"), F.col("at").alias("slice"), "context", "ts", "seq", "event_id", "action_id")
    else:
        e = e.select("object_id", F.lit(False).alias("sliced"), F.lit(0).alias("slice"), F.lit(False).alias("context"), "ts", "seq", "event_id", "action_id")
    row = F.struct("ts", F.coalesce(-F.col("seq"), F.lit(2**63 - 1)).alias("no"), "event_id", "action_id")
    return (
        e.groupBy("object_id", "sliced", "slice")
        .agg(F.sort_array(F.collect_list(row)).alias("r"), F.count_if("context").alias("n_context"))
        .where(F.size("r") > F.col("n_context"))
        .select("object_id", "sliced", "n_context", F.col("r.ts").alias("ts"), F.col("r.action_id").alias("action"))
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``BLOCK_EVENTS`` events, which bounds the arrays of a task."""
    for batch in batches:
        offsets, begin = batch.column("ts").offsets.to_numpy(), 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_EVENTS, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _range_or(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bitwise or of ``rows[low:high]`` for each pair, from tables of doubled width."""
    out = np.zeros((len(low), rows.shape[1]), rows.dtype)
    width, reach = high - low, 1
    while True:
        here = np.flatnonzero((width >= reach) & (width < 2 * reach))
        out[here] = rows[low[here]] | rows[high[here] - reach]
        if not (width >= 2 * reach).any():
            return out
        rows, reach = rows[:-reach] | rows[reach:], 2 * reach


def _items_of(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


class _Block:
    """Paths flattened and cut down to the given items, on one clock on which different paths are far apart."""

    def __init__(self, batch: pa.RecordBatch, items: np.ndarray | None, gap: int):
        lists = batch.column("ts")
        length = np.diff(lists.offsets.to_numpy())
        ts, action = lists.flatten().to_numpy(zero_copy_only=False), batch.column("action").flatten().to_numpy(zero_copy_only=False)
        path = np.repeat(np.arange(len(length)), length)
        begin = np.repeat(np.cumsum(length) - length, length)
        counts = np.arange(len(ts)) - begin >= np.repeat(batch.column("n_context").to_numpy(zero_copy_only=False), length)
        if items is not None:
            code = np.minimum(np.searchsorted(items, action), len(items) - 1)
            keep = items[code] == action
            ts, path, counts, action = ts[keep], path[keep], counts[keep], code[keep]
        self.path, self.counts, self.item = path, counts, action
        self.object_id = batch.column("object_id").to_numpy(zero_copy_only=False)
        self.sliced = batch.column("sliced").to_numpy(zero_copy_only=False)
        new = np.r_[True, path[1:] != path[:-1]] if len(path) else np.empty(0, bool)
        pause = np.r_[0, np.diff(ts)] if len(ts) else ts
        clock = np.cumsum(np.where(new | (pause > gap), gap + 1, pause))
        self.after = np.searchsorted(clock, clock + gap, "right")  # first place beyond the gap
        self.before = np.searchsorted(clock, clock - gap, "left")  # first place within the gap

    def tally(self, codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """``pattern, object_id (-1: none), objects, ends`` for occurrences of ``codes`` that end at positions ``at``."""
        own = self.counts[at]
        codes, path = codes[own], self.path[at[own]]
        order = np.lexsort((path, codes))
        codes, path = codes[order], path[order]
        new = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.empty(0, bool)
        first = new | np.r_[True, path[1:] != path[:-1]] if len(codes) else new
        starts = np.flatnonzero(new)
        ends = np.diff(np.r_[starts, len(codes)])
        whole = first & ~self.sliced[path]
        objects = np.add.reduceat(whole, starts) if len(starts) else starts
        parts = np.flatnonzero(first & self.sliced[path])
        none = np.full(len(starts), -1)
        return [
            np.r_[codes[starts], codes[parts]], np.r_[none, self.object_id[path[parts]]],
            np.r_[objects, np.zeros(len(parts), np.int64)], np.r_[ends, np.zeros(len(parts), np.int64)],
        ]

    def following(self, ends: np.ndarray) -> np.ndarray:
        """Positions at most a gap after the latest of ``ends`` before them: a position further from it is further from the others."""
        stop = np.minimum(self.after[ends], np.r_[ends[1:] + 1, len(self.item)])
        n = stop - ends - 1
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends + 1, n)

    def backward(self, ends: np.ndarray, sets: np.ndarray, code: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[list[np.ndarray]]:
        """Counts of backward extensions: those of all whole paths here, of each slice, and those at all ends."""
        own = self.counts[ends]
        ends, sets = ends[own], sets[own]
        if not len(ends):
            return
        path = self.path[ends]
        starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        of_path = np.bitwise_or.reduceat(sets, starts, axis=0)
        sliced = self.sliced[path[starts]]
        row = lambda kind, items, object_id, objects, n: [code(kind, items), *(np.full(len(items), v) for v in (object_id, objects, n))]
        if not sliced.all():
            yield row(BACKWARD, _items_of(np.bitwise_and.reduce(of_path[~sliced], axis=0)), -1, int((~sliced).sum()), 0)
        for at in np.flatnonzero(sliced):
            yield row(BACKWARD, _items_of(of_path[at]), self.object_id[path[starts[at]]], 0, 0)
        yield row(BACKSCAN, _items_of(np.bitwise_and.reduce(sets, axis=0)), -1, 0, len(ends))


def _send(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
    ids = pa.array(columns[1], mask=columns[1] < 0)
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), ids, pa.array(columns[2]), pa.array(columns[3])], ["pattern", "object_id", "objects", "ends"])


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        b = _Block(batch, None, 0)
        yield _send([b.tally(b.item.astype(np.int64), np.arange(len(b.item)))])


def _extend(items: np.ndarray, prefixes: list[tuple[int, ...]], gap: int):
    """Counts of the extensions of prefixes; ``pattern`` is ``(prefix * 3 + kind) * items + item``."""
    trie: dict = {}
    for number, prefix in enumerate(prefixes):
        node = trie
        for step in prefix[:-1]:
            node = node.setdefault(step, {})
        node[prefix[-1]] = number
    lanes = -(-len(items) // 64)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            b, found = _Block(batch, items, gap), []
            if not len(b.item):
                continue

            def by_item(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = at[np.argsort(b.item[at], kind="stable")]
                return at, np.searchsorted(b.item[at], np.arange(len(items) + 1))

            def grow(node: dict, at: np.ndarray, bounds: np.ndarray, before: np.ndarray | None, sets: np.ndarray) -> None:
                """Children of a prefix that ends at ``before`` with ``sets``; ``at`` are the places after it by item."""
                for step, below in node.items():
                    ends = at[bounds[step] : bounds[step + 1]]
                    if not len(ends):
                        continue
                    low, high = (b.before[ends], ends) if before is None else (np.searchsorted(before, b.before[ends]), np.searchsorted(before, ends))
                    own = _range_or(sets, low, high)
                    after, edges = by_item(b.following(ends))
                    if isinstance(below, dict):
                        grow(below, after, edges, ends, own)
                    else:
                        code = lambda kind, item, below=below: (below * 3 + kind) * len(items) + item
                        found.append(b.tally(code(FORWARD, b.item[after].astype(np.int64)), after))
                        found.extend(b.backward(ends, own, code))

            single = np.zeros((len(b.item), lanes), np.uint64)
            single[np.arange(len(b.item)), b.item // 64] = np.uint64(1) << (b.item % 64).astype(np.uint64)
            grow(trie, *by_item(np.arange(len(b.item))), None, single)
            yield _send(found)

    return extend


def _totals(paths: DataFrame, worker, least: int) -> dict[int, tuple[int, int]]:
    """Support and number of ends of the patterns of which either reaches ``least``."""
    counts = paths.mapInArrow(worker, COUNTS).groupBy("pattern").agg((F.sum("objects") + F.countDistinct("object_id")).alias("support"), F.sum("ends").alias("ends"))
    return {r[0]: (r[1], r[2]) for r in collect_small(counts.where(F.greatest("support", "ends") >= least), MOST_PATTERNS)}


def _mine(paths: DataFrame, least: int, gap: int, depth: int) -> dict[tuple, int] | None:
    """Supports of closed patterns by actions; None if patterns of ``depth`` steps may still grow."""
    singles = {a: v for a, v in _totals(paths, _count_items, least).items() if v[0] >= least}
    items = np.array(sorted(singles), np.int64)
    level = {(i,): singles[a] for i, a in enumerate(items)}
    closed = {}
    for length in range(1, depth + 1):
        if not level:
            return {tuple(int(items[i]) for i in p): n for p, n in closed.items()}
        if length == depth:
            return None
        prefixes = sorted(level)
        whole, longer, stopped = set(), {}, set()
        for code, (support, ends) in _totals(paths, _extend(items, prefixes, gap), least).items():
            rest, item = divmod(code, len(items))
            number, kind = divmod(rest, 3)
            prefix = prefixes[number]
            if kind == FORWARD and support >= least:
                longer[*prefix, item] = support, ends
            if kind != BACKSCAN and support == level[prefix][0]:
                whole.add(prefix)  # an extension stands wherever the prefix does
            if kind == BACKSCAN and ends == level[prefix][1]:
                stopped.add(prefix)
        closed |= {p: v[0] for p, v in level.items() if p not in whole}
        level = {p: v for p, v in longer.items() if p[:-1] not in stopped}
    return None


def closed_patterns(
    events: DataFrame, gap: int = 30 * MINUTE, share: int = 60, at_least: int = 3, slicing: Slicing | None = None, depth: int = 8
) -> DataFrame:
    """Closed patterns of actions in at least one of ``share`` paths, and in at least ``at_least``.

    Paths count that have a valid event with an action.  A step may repeat the
    action before it.  ``depth`` is only a first guess of how long patterns
    get; if longer ones are frequent, the paths are packed anew.

    A prefix is closed if none of its one-step extensions, forward or backward,
    has its support.  A prefix with the same item a step before it at all its
    ends is not grown (backscan): whatever grows from it also grows, with the
    same support, from the longer one.

    Repeated deliveries and events without object, time or action never count;
    equal times follow path order; an empty table gives no pattern.

    Result: ``pattern`` (array of action ids), ``support``.
    """
    spark = events.sparkSession
    slicing = plan_slices(events, SLICE_EVENTS) if slicing is None else slicing
    while True:
        paths, _ = stored(packed_paths(events, (depth - 1) * gap, slicing))
        n = paths.select("object_id").distinct().count() if slicing else paths.count()
        closed = _mine(paths, max(at_least, -(-n // share)), gap, depth)
        if closed is not None:
            break
        depth *= 2
    return spark.createDataFrame([([*p], n) for p, n in sorted(closed.items())], "pattern array<int>, support long")


def all_patterns(closed: DataFrame, length: int) -> DataFrame:
    """Frequent patterns of one length with their supports, recovered from the closed ones."""
    starts = F.sequence(F.lit(1), F.size("pattern") - length + 1)
    parts = closed.where(F.size("pattern") >= length).select(F.explode(F.transform(starts, lambda i: F.slice("pattern", i, length))).alias("pattern"), "support")
    return parts.groupBy("pattern").agg(F.max("support").alias("support"))
