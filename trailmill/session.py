"""Session settings the engine relies on, and where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows a table handed to the driver or to every executor may have.
SMALL_ROWS = 200_000
#: Tables written by ``stored`` and not yet removed.
_stored: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: timestamps without zone are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a session on this machine alone (master ``local``) may name none; a
    folder of the machine is then taken.  On a cluster that is an error, as
    each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"trailmill-{os.getuid()}-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def own_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder; it is removed when the application ends, or by ``drop_stored``."""
    path = f"{shared_dir(spark)}/trailmill/{kind}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _stored.append(path)
    return path


def drop_stored(spark: SparkSession, since: int = 0) -> None:
    """Remove intermediate tables; results that are computed from them must have been taken."""
    while len(_stored) > since:
        fs, p = file_system(spark, _stored.pop())
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are removed at the end: write or collect results inside, too."""
    since = len(_stored)
    try:
        yield
    finally:
        drop_stored(spark, since)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table into the shared folder; the table read again, and its path.

    This cuts the lineage: a lost executor costs the rows of its tasks, not
    the work before the table.
    """
    spark = df.sparkSession
    path = own_path(spark)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_or_stored(df: DataFrame, most: int = 20_000) -> tuple[DataFrame, bool]:
    """``df`` computed once, and whether it is small: handed over by the driver with up to ``most`` rows, else written to the shared folder."""
    rows = df.limit(most + 1).collect()
    if len(rows) <= most:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return stored(df)[0], False


def collect_small(df: DataFrame, most: int = SMALL_ROWS) -> list:
    """``df.collect()`` behind a check that at most ``most`` rows arrive."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table meant to be small has more than {most} rows")
    return rows


def exactly(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, whatever else the table has.

    Further columns whose names differ in case only would otherwise make a
    reference ambiguous.
    """
    found = df.columns
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"missing columns: {missing}")
    lower = [n.lower() for n in found]
    if all(lower.count(n.lower()) == 1 for n in names):
        return df.select(*names)  # new names would keep Spark from seeing that two shuffles are the same
    return df.toDF(*(n if n in names else f"_other_{i}" for i, n in enumerate(found))).select(*names)
