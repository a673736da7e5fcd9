"""Attributes as they stood and were known at an event.

Each shard builds one persistent search tree over its updates.  Updates are
inserted in order of arrival; every insertion copies the path from the root
to its leaf and shares the rest, so each insertion's root is the tree as it
was known then.  An event takes the root of its arrival and searches it for
the last update of valid time before its own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .cells import MOST_PROPERTIES, readable_cells
from .paths import Slicing, plan_slices, valid_events

#: Events of one tree.
SHARD_ROWS = 100_000
RESULT = "event_id long, key int, source_event_id long, source_ts long, source_seq long"


class PersistentTree:
    """All versions of a binary tree over ranks 0..n-1, inserted in a given order.

    ``ranks[i]`` is the leaf of insertion ``i`` and must be a permutation.
    Node ``(i, level)`` is the copy that insertion ``i`` made at ``level``; its
    children are named by the insertion that made them, -1 for none.  Copies of
    one level are found together: insertions that share a node's prefix stand
    side by side in arrival order, and the child off the path is the last one
    among them that turned the other way.
    """

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.depth = max(1, int(n - 1).bit_length()) if n > 1 else 1
        self.children = []
        order = np.arange(n)
        start = np.zeros(n, np.int64)  # where each row's prefix begins
        at = np.arange(n)
        for level in range(self.depth):
            bit = (ranks[order] >> (self.depth - level - 1)) & 1
            lasts = []
            for side in (0, 1):
                last = np.maximum.accumulate(np.where(bit == side, at, -1))
                lasts.append(np.where(last >= start, order[np.maximum(last, 0)], -1))
            pair = np.empty((n, 2), np.int64)
            pair[order, 0], pair[order, 1] = lasts
            self.children.append(pair)
            zeros = np.cumsum(bit == 0)
            before = np.where(start > 0, zeros[np.maximum(start - 1, 0)], 0)
            first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if n else at
            size = np.diff(np.r_[first, n])
            in_group = np.repeat(zeros[first + size - 1] - before[first], size) if n else zeros
            zero_rank = zeros - before
            to = np.where(bit == 0, start + zero_rank - 1, start + in_group + (at - start) - zero_rank)
            split = np.empty(n, np.int64)
            split[to] = np.where(bit == 0, start, start + in_group)
            moved = np.empty(n, np.int64)
            moved[to] = order
            order, start = moved, split

    def before(self, version: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The insertion of the greatest rank below ``rank`` among insertions 0..``version``; -1 for none."""
        node = np.where((version >= 0) & (rank > 0), version, -1)
        target = np.maximum(rank - 1, 0)
        aside, aside_level = np.full(len(node), -1), np.zeros(len(node), np.int64)
        for level, pair in enumerate(self.children):
            bit = (target >> (self.depth - level - 1)) & 1
            both = pair[np.maximum(node, 0)]
            left = np.where((node >= 0) & (bit == 1), both[:, 0], -1)
            aside, aside_level = np.where(left >= 0, left, aside), np.where(left >= 0, level + 1, aside_level)
            node = np.where(node >= 0, both[np.arange(len(node)), bit], -1)
        best = aside
        for level, pair in enumerate(self.children):
            both = pair[np.maximum(best, 0)]
            best = np.where((best >= 0) & (aside_level <= level), np.where(both[:, 1] >= 0, both[:, 1], both[:, 0]), best)
        return np.where(node >= 0, node, best)


def _dense(*arrays: np.ndarray) -> tuple[list[np.ndarray], int]:
    found, codes = np.unique(np.concatenate(arrays), return_inverse=True)
    return np.split(codes, np.cumsum([len(a) for a in arrays])[:-1]), len(found)


def search_shard(table: pa.Table) -> pa.Table:
    """Sources of one shard's queries; see ``known_attributes``."""
    column = lambda c: table.column(c).combine_chunks()
    is_query = column("is_query").to_numpy(zero_copy_only=False)
    no_seq = column("seq").is_null().to_numpy(zero_copy_only=False)
    no_key = column("key").is_null().to_numpy(zero_copy_only=False)
    obj, ts, seq, event, key = (column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("object_id", "ts", "seq", "event_id", "key"))
    q = np.flatnonzero(is_query)
    u = np.flatnonzero(~is_query)
    u = u[np.isin(obj[u], obj[q])]
    out = {c: np.empty(0, np.int64) for c in ("event_id", "key", "source_event_id", "source_ts", "source_seq")}
    if len(q) and len(u):
        # Updates by object, key, valid time and path order among equal times.
        u = u[np.lexsort((event[u], -seq[u], ts[u], key[u], obj[u]))]
        edge = np.r_[True, (obj[u][1:] != obj[u][:-1]) | (key[u][1:] != key[u][:-1])]
        group = np.cumsum(edge) - 1
        g_obj, g_key = obj[u][edge], key[u][edge]
        # A query asks every key of its object, or the one it names.
        low, high = np.searchsorted(g_obj, obj[q], "left"), np.searchsorted(g_obj, obj[q], "right")
        each = np.repeat(np.arange(len(q)), high - low)
        g = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        wanted = no_key[q][each] | (key[q][each] == g_key[g])
        each, g = q[each[wanted]], g[wanted]
        # An update by the event itself.
        (eu, eq), many = _dense(event[u], event[each])
        own_code = group * many + eu
        by_own = np.argsort(own_code, kind="stable")
        place = np.searchsorted(own_code[by_own], g * many + eq)
        own = np.where(place < len(u), by_own[np.minimum(place, len(u) - 1)], 0)
        is_own = (own_code[own] == g * many + eq)
        # The others: the tree over updates whose arrival is known.
        known = np.flatnonzero(~no_seq[u])
        source = np.where(is_own, own, -1)
        if len(known):
            arrival = known[np.argsort(seq[u][known], kind="stable")]
            rank = np.full(len(u), -1)
            rank[known] = np.arange(len(known))
            tree = PersistentTree(rank[arrival])
            (tu, tq), many = _dense(ts[u][known], ts[each])
            below = np.searchsorted(group[known] * many + tu, g * many + tq, "left")
            version = np.searchsorted(seq[u][arrival], seq[each], "left") - 1
            version[no_seq[each]] = -1
            found = tree.before(version, below)
            hit = np.where(found >= 0, arrival[np.maximum(found, 0)], 0)
            good = (found >= 0) & (group[hit] == g)
            source = np.where(is_own, own, np.where(good, hit, -1))
        ok = source >= 0
        at = u[source[ok]]
        out = {"event_id": event[each[ok]], "key": g_key[g[ok]], "source_event_id": event[at], "source_ts": ts[at], "source_seq": seq[at]}
    return pa.table({"event_id": out["event_id"], "key": out["key"].astype(np.int32), "source_event_id": out["source_event_id"], "source_ts": out["source_ts"], "source_seq": out["source_seq"]})


def _earlier_slices(shard_rows: int):
    """For one object and key: which earlier slices the events of each slice may have to ask.

    Of two slices the later one is asked first, so an earlier one matters only
    if its first arrival is before the later one's; these form a chain, which
    ends at the first slice that every asking event knows.  ``shards`` parts the
    events that may ask a slice so that ``shard_rows`` of them meet its updates.
    """

    def chains(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        asked_by, open_, found = defaultdict(int), [], []
        slices, least, asked, events = (table.column(c).to_pylist() for c in ("slice", "least", "asked", "events"))
        for s, first, earliest, n in zip(slices, least, asked, events):
            chain = []
            if n:
                asked_by[s] += n
                for t, arrived in reversed(open_ if earliest is not None else []):
                    chain.append((t, arrived))
                    asked_by[t] += n
                    if arrived < earliest:
                        break
            found.append(chain)
            if first is not None:
                while open_ and open_[-1][1] >= first:
                    open_.pop()
                open_.append((s, first))
        shards = {s: max(1, -(-n // shard_rows)) for s, n in asked_by.items()}
        earlier = [[{"slice": t, "least": a, "shards": shards[t]} for t, a in chain] for chain in found]
        return pa.table({
            "object_id": table.column("object_id"), "key": table.column("key"), "slice": table.column("slice"), "shards": pa.array([shards.get(s, 1) for s in slices], pa.int64()),
            "earlier": pa.array(earlier, pa.list_(pa.struct([("slice", pa.int64()), ("least", pa.int64()), ("shards", pa.int64())]))),
        })

    return chains


def known_attributes(
    events: DataFrame, event_data: DataFrame, properties: DataFrame, action_ids: list[int], slicing: Slicing | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """For valid events of the given actions, each object property with the update it stood at.

    The source is the event itself if it updates the key; else, of the updates
    of the same object and key with smaller time and smaller ``seq``, the last
    in path order.  Keys without source have no row.  An update whose ``seq``
    is missing was never known to other events, and an event without ``seq``
    knows only itself.

    Objects are hashed to shards of about ``shard_rows`` events, one tree each.
    An object with more rows is spread over shards per key and slice of time:
    an event asks the slice of its own time and the last earlier slice that
    has anything it could know, which is all that can hold its answer.  A slice
    that very many events ask is searched by several shards, each with the
    slice's updates and a part of the events.

    Empty tables, or no such action, give no row.

    Result: ``event_id, key, source_event_id, source_ts, source_seq``.
    """
    slicing = plan_slices(events, shard_rows) if slicing is None else slicing
    shards = max(1, -(-events.count() // shard_rows))
    keys = readable_cells(event_data, properties).groupBy("event_id").agg(F.collect_list("key").alias("keys"))
    wanted = F.coalesce(F.col("action_id").isin(action_ids) if action_ids else F.lit(False), F.lit(False))
    found = valid_events(events).withColumn("wanted", wanted).join(keys, "event_id", "left").where(F.col("wanted") | F.col("keys").isNotNull())
    if slicing:
        found, _ = stored(slicing.add(found))
    kinds = F.concat(
        F.transform(F.coalesce("keys", F.array().cast("array<int>")), lambda k: F.struct(F.lit(False).alias("is_query"), k.alias("key"))),
        F.when(F.col("wanted"), F.array(F.struct(F.lit(True).alias("is_query"), F.lit(None).cast("int").alias("key")))).otherwise(F.array().cast("array<struct<is_query:boolean,key:int>>")),
    )

    def rows_of(df: DataFrame, *more: str) -> DataFrame:
        kept = ["event_id", "object_id", "ts", "seq", *more]
        return df.select(*kept, F.explode(kinds).alias("k")).select(*kept, "k.is_query", "k.key")

    def search(df: DataFrame) -> DataFrame:
        return df.select("shard", "is_query", "object_id", "key", "ts", "seq", "event_id").groupBy("shard").applyInArrow(search_shard, RESULT)

    short = rows_of(found.where(F.col("slice") == 0) if slicing else found).withColumn("shard", F.pmod(F.hash("object_id"), F.lit(shards)))
    if not slicing:
        return search(short)

    spread = rows_of(found.where(F.col("slice") > 0), "slice")
    updates, queries = spread.where(~F.col("is_query")), spread.where("is_query").drop("key")
    known = updates.groupBy("object_id", "key", "slice").agg(F.lit(True).alias("own"), F.min("seq").alias("least"))  # null if no other event could know one
    asked = queries.groupBy("object_id", "slice").agg(F.min("seq").alias("asked"), F.count("*").alias("events"))
    every = asked.join(known.select("object_id", "key").distinct(), "object_id")
    summary = every.join(known, ["object_id", "key", "slice"], "full_outer").select("object_id", "key", "slice", "least", "asked", F.coalesce("events", F.lit(0)).alias("events"))
    plan, _ = stored(summary.groupBy("object_id", "key").applyInArrow(_earlier_slices(shard_rows), "object_id long, key int, slice long, shards long, earlier array<struct<slice:long,least:long,shards:long>>"))
    plan = slicing.bounded(plan, MOST_PROPERTIES)

    part = lambda n: F.pmod(F.hash("event_id"), n)
    before = F.get(F.filter("earlier", lambda x: x["least"] < F.col("seq")), 0)
    ask = queries.join(plan, ["object_id", "slice"])
    ask = ask.withColumn("a", F.explode(F.array_compact(F.array(F.struct("slice", "shards"), F.when(before.isNotNull(), F.struct(before["slice"].alias("slice"), before["shards"].alias("shards")))))))
    ask = ask.select("event_id", "object_id", "ts", "seq", "is_query", "key", F.col("a.slice").alias("slice"), part(F.col("a.shards")).alias("part"))
    told = updates.join(plan, ["object_id", "key", "slice"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    both = told.select(*ask.columns).unionByName(ask).withColumn("shard", F.xxhash64("object_id", "key", "slice", "part"))
    last = Window.partitionBy("event_id", "key").orderBy(F.col("source_ts").desc(), F.col("source_seq"))
    spread_found = search(both).withColumn("_before", F.lag(F.lit(1)).over(last)).where(F.col("_before").isNull()).drop("_before")
    return search(short).unionByName(spread_found)
