"""Entity–attribute–value rows to one wide row per entity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import collect_small, exactly
from ..types import DATA_TYPES
from .cells import MOST_PROPERTIES, cells

#: Cells joined at a time in a task.
BLOCK_CELLS = 1 << 16
COLUMN = {"Int": "v_int", "Float": "v_float", "Boolean": "v_bool", "String": "v_str"}


def column_name(key: int, name: str | None) -> str:
    """Column of a property: its key keeps equal names apart, and only letters, digits and ``_`` of the name are kept."""
    return f"{'o' if key > 0 else 'a'}{abs(key)}_{re.sub(r'[^A-Za-z0-9]', '_', name or '')}"


def _registry(properties: DataFrame) -> list:
    p = exactly(properties, "id", "data_type", "name").where(F.col("id").isNotNull())
    return sorted(map(tuple, collect_small(p.groupBy("id").agg(F.min("data_type").alias("kind"), F.min("name").alias("name")), MOST_PROPERTIES)))


def outer_join(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Full outer join of two tables ``(entities, rows)`` on the entity.

    Entities ascend and are unique; ``rows`` has one line per attribute, with
    the place of the entity's cell in the narrow table, or -1.
    """
    entities = np.union1d(a[0], b[0])
    rows = np.full((len(a[1]) + len(b[1]), len(entities)), -1, np.int32)
    rows[: len(a[1]), np.searchsorted(entities, a[0])] = a[1]
    rows[len(a[1]) :, np.searchsorted(entities, b[0])] = b[1]
    return entities, rows


def outer_join_all(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All tables joined as a balanced tree, so that no row passes through more than log2(n) joins."""
    while len(tables) > 1:
        joined = [outer_join(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = joined + (tables[-1:] if len(tables) % 2 else [])
    return tables[0]


def _combine(block: pa.Table, registry: list, names: list[str]) -> pa.RecordBatch:
    """The wide rows of a block that holds all cells of its events."""
    events, key = (block.column(c).combine_chunks().to_numpy() for c in ("event_id", "key"))
    order = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key = key[order]
    narrow, columns = [], []
    for k, kind, _ in registry:  # typed narrow tables, each by event
        own = order[np.searchsorted(sorted_key, k, "left") : np.searchsorted(sorted_key, k, "right")]
        narrow.append((events[own], np.arange(len(own), dtype=np.int32)[None]))
        value = block.column(COLUMN[kind]).take(own) if kind in COLUMN else pa.chunked_array([pa.nulls(len(own), pa.string())])
        columns.append((value.combine_chunks(), block.column("status").take(own).combine_chunks()))
    entities, rows = outer_join_all(narrow)
    out = [pa.array(entities)]
    for (value, status), at in zip(columns, rows):
        at = pa.array(at, mask=at < 0)
        out += [value.take(at), status.take(at)]
    return pa.RecordBatch.from_arrays(out, names)


def _join_blocks(registry: list, names: list[str]):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_CELLS:
                block = pa.Table.from_batches(held)
                events = block.column("event_id").combine_chunks().to_numpy()
                whole = int(np.searchsorted(events, events[-1]))  # the last event may go on
                if whole:
                    yield _combine(block.slice(0, whole), registry, names)
                held = block.slice(whole).combine_chunks().to_batches()
                size -= whole
        if size:
            yield _combine(pa.Table.from_batches(held), registry, names)

    return join


def wide_rows(event_data: DataFrame, properties: DataFrame) -> DataFrame:
    """One row per event with a typed column per registered property.

    Cells are resolved (see ``cells``) in one shuffle by event, which also
    co-partitions all attributes by entity.  Within a task the cells stream by
    event in blocks of ``BLOCK_CELLS``; each block is split by attribute into
    narrow tables of the attribute's own type, and these are combined by a
    balanced tree of full outer joins.  Spark's own full outer join gives up
    its partitioning, so the same tree of joins would shuffle at every level.
    An event has at most one cell per registered property, so blocks are bounded.

    Columns: ``event_id``; per property ``<o|a><id>_<name>`` (``o`` object,
    ``a`` action property) and the same with ``__cell``: ``ok``, ``repaired``,
    ``rejected`` (no readable row, value null) or null (no cell).  Events whose
    every key is unregistered have no row.  An empty table gives no row but all
    columns; an empty registry only ``event_id`` and no row.
    """
    registry = _registry(properties)
    if not registry:
        return exactly(event_data, "event_id").where(F.lit(False))
    schema = T.StructType([T.StructField("event_id", T.LongType())])
    for key, kind, name in registry:
        column = column_name(key, name)
        schema = schema.add(column, DATA_TYPES.get(kind, T.StringType())).add(f"{column}__cell", T.StringType())
    found = cells(event_data, properties).select("event_id", "key", *COLUMN.values(), "status").sortWithinPartitions("event_id", "key")
    return found.mapInArrow(_join_blocks(registry, schema.names), schema)


def cell_status(wide: DataFrame, properties: DataFrame) -> DataFrame:
    """``event_id, key, cell`` of the cells in a wide table that are not ``ok``."""
    registry = _registry(properties)
    if not registry:
        return wide.select("event_id", F.lit(None).cast("int").alias("key"), F.lit(None).cast("string").alias("cell")).where(F.lit(False))
    bad = [(k, F.col(f"{column_name(k, n)}__cell").isin("rejected", "repaired"), F.col(f"{column_name(k, n)}__cell")) for k, _, n in registry]
    found = [F.when(is_bad, F.struct(F.lit(k).cast("int").alias("key"), cell.alias("cell"))) for k, is_bad, cell in bad]
    some = reduce(Column.__or__, (F.coalesce(is_bad, F.lit(False)) for _, is_bad, _ in bad))  # few rows have one, so most need no array
    return wide.where(some).select("event_id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("event_id", "c.key", "c.cell")
