"""Registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import load
from .leaks import leaked_items
from .mixing import lengths, mix_sources
from .patterns import all_patterns, closed_patterns
from .residue import residue_coverage, without_residue
from .runs import collapse_runs
from .text import ascii_letters


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(load(spark, d, "sky_event"), load(spark, d, "sky_action"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_runs(spark, d).where(F.col("n_events") > 1).select("object_id", "first_event_id", "last_event_id")


def p4_closed(spark: SparkSession, d: str) -> DataFrame:
    return closed_patterns(load(spark, d, "sky_event")).select(F.array_join("pattern", " ").alias("actions"), F.size("pattern").alias("steps"), "support")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = all_patterns(closed_patterns(load(spark, d, "sky_event")), 3)
    return found.select(*(F.col("pattern")[i].alias(f"action_{i + 1}") for i in range(3)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_item"))


def p8_ascii(spark: SparkSession, d: str) -> DataFrame:
    """The search with texts brought to ASCII letters and digits only."""
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_item"), plain=ascii_letters)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(load(spark, d, "documents"))[1]


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return residue_coverage(load(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"))[1]


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by numbers of characters."""
    found = mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"), sizes=lengths)[0]
    return found.select("source", "doc_id", "copy", "tokens", F.round("position", 9).alias("position"))


def p9_length_shares(spark: SparkSession, d: str) -> DataFrame:
    found = mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"), sizes=lengths)[1]
    return found.withColumns({c: F.round(c, 9) for c in ("target_share", "share")}).withColumn("largest_total", F.round("largest_total", 3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_runs, p4_found, p4_closed, p8_found, p8_ascii, p9_mix, p9_shares, p9_lengths, p9_length_shares, p10_found, p10_coverage)}
