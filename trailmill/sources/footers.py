"""Ranges of values in Parquet files, from their footers alone."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import file_system

#: Tasks that footers are spread over.
MOST_TASKS = 512


def _whole(value: object) -> int | None:
    """Integers as they are, times as microseconds since 1970."""
    if isinstance(value, datetime):
        zone = timezone.utc if value.tzinfo else None
        return (value - datetime(1970, 1, 1, tzinfo=zone)) // timedelta(microseconds=1)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _footer(uri: str, columns: list[str]) -> list[int | None]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = f"file://{uri[5:]}"
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
    out: list[int | None] = [meta.num_rows]
    groups = [meta.row_group(i) for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
    for column in columns:
        found = []
        for g in groups:
            chunk = next((g.column(i) for i in range(g.num_columns) if g.column(i).path_in_schema == column), None)
            stats = chunk.statistics if chunk is not None and chunk.is_stats_set else None
            if stats is not None and stats.has_min_max:
                found.append((_whole(stats.min), _whole(stats.max)))
            elif stats is None or stats.null_count != g.num_rows:
                found = [(None, None)]  # a row group that says nothing may hold anything
                break
        known = found and all(v is not None for pair in found for v in pair)
        out += [min(lo for lo, _ in found), max(hi for _, hi in found)] if known else [None, None]
    return out


def footer_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``file, rows, min_<column>, max_<column>`` of every Parquet file under a path, for columns of integers and times.

    No row is read: tasks open the files' footers.  A range is null if the
    footer does not give it, if the column is missing, or if it holds only nulls.
    """
    system, p = file_system(spark, path)
    listed, files = system.listFiles(p, True), []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(".parquet"):
            files.append((name,))
    names = ["file", "rows", *(f"{end}_{c}" for c in columns for end in ("min", "max"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = batch.column("file").to_pylist()
            rows = [_footer(uri, columns) for uri in uris]
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names) - 1))], names)

    spread = spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), MOST_TASKS)))
    return spread.mapInArrow(read, ", ".join(f"`{n}` {'string' if n == 'file' else 'long'}" for n in names))
