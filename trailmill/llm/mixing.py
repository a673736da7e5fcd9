"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over training time.  The integral of its
schedule is the demand for its tokens up to each time; a document that stands
at some offset in its source's stream is wanted when the demand reaches that
offset, so its training position is the inverse of the integral there.
Sorting all copies by position gives the mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_small, exactly, small_or_stored, stored

#: A public byte-level vocabulary as ranks; any file of that format can be named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources a mixture may have; their table is sent to all tasks.
MOST_SOURCES = 10_000
#: Documents in whose running sum one task looks at a time, and bits of the hash that orders them.
BUCKET_ROWS, HASH_BITS = 100_000, 60
_ENCODERS: dict = {}


def encoder(path: str, split: str = SPLIT):
    """The tokenizer of a vocabulary file, built once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def order_hash(column: str, seed: int) -> Column:
    """The first 60 bits of the MD5 of seed and id, which any system computes alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), F.col(column).cast("string")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of every document; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if (t := text.as_py()) else 0 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, tokens long")


def lengths(documents: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` with the number of characters in place of tokens."""
    return documents.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))


def ramps(targets: dict[str, tuple[float, int]], steepness: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """The default schedule: sources that may be repeated more gain weight towards the end.

    Weights are linear in time, add up to one at any time and average to the
    target share over the whole.
    """
    mean = sum(share * repeats for share, repeats in targets.values())
    most = max((abs(repeats - mean) for _, repeats in targets.values()), default=0) or 1.0
    slope = {s: steepness * (repeats - mean) / most for s, (_, repeats) in targets.items()}
    return {s: [(0.0, share * (1 - slope[s])), (1.0, share * (1 + slope[s]))] for s, (share, _) in targets.items()}


def integrated(knots: list[tuple[float, float]]) -> tuple[list[tuple[float, float, float, float]], float]:
    """Segments ``(time, weight, slope, integral before)`` of a piecewise linear schedule, and its whole integral."""
    segments, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            segments.append((t0, w0, (w1 - w0) / (t1 - t0), total))
            total += (w0 + w1) / 2 * (t1 - t0)
    return segments, total


def mix_sources(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: dict[str, list[tuple[float, float]]] | None = None,
    vocabulary: str = VOCABULARY, seed: int = 0, sizes: Callable[[DataFrame], DataFrame] | None = None, bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(mixture, report)`` of documents drawn from sources by target share.

    A source is given ``target_share`` of ``total_tokens``, but no document more
    than ``max_repeats`` times.  By default the total is the largest with which
    every source that has documents reaches its target; the source that is
    used up first bounds it.  With a greater total, what a short source cannot
    give is not made up by others and shows in the report.  Shares are taken
    relative to their sum; a source named twice adds up its shares and takes
    the greater limit; missing values count as 0.

    Each source's documents stand in the order of a hash of ``doc_id``.
    Offsets come from sums per bucket of the hash and running sums inside the
    buckets of about ``bucket_rows`` documents, so a source with a third of all
    rows is spread over as many tasks as it needs.  The stream is repeated as
    often as the demand asks.  ``sizes`` gives documents' sizes by other means
    than the tokenizer, such as ``lengths``.

    ``schedule`` gives each source's weight by time in [0, 1] as piecewise
    linear knots (default ``ramps``); it decides when, not how much.

    Documents without id, source or tokens, or of other sources, are left out;
    a document row that occurs twice counts as two.  Empty tables give an empty
    mixture, and the report still names every target.

    ``mixture``: ``position`` in [0, 1), ``source, doc_id, copy, tokens``,
    range-sorted by position.  ``report``: ``source, target_share,
    available_tokens, max_repeats, documents, most_copies, tokens, share,
    largest_total`` (with which all stocked sources reach their targets).
    """
    spark = documents.sparkSession
    rows = collect_small(
        exactly(targets, "source", "target_share", "max_repeats").where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.coalesce(F.max("max_repeats"), F.lit(0))), MOST_SOURCES
    )
    whole = sum(max(0.0, r[1]) for r in rows) or 1.0
    wanted = {r[0]: (max(0.0, r[1]) / whole, max(0, r[2])) for r in rows}
    schedule = schedule or ramps(wanted)

    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    chosen = exactly(documents, "doc_id", "source", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(names), "source")
    measured = (sizes(chosen) if sizes else token_counts(chosen, vocabulary)).where(F.col("tokens") > 0)
    sized, _ = stored(measured.withColumn("h", order_hash("doc_id", seed)))
    bits = (sized.count() // bucket_rows).bit_length()
    sized = sized.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    sums, small = small_or_stored(sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")))
    available = dict.fromkeys(wanted, 0) | {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("tokens")).collect()}
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    largest = min((repeats * available[s] / share for s, (share, repeats) in wanted.items() if share * repeats * available[s] > 0), default=0.0)
    total = largest if total_tokens is None else total_tokens
    demand = {s: min(share * total, float(repeats * available[s])) for s, (share, repeats) in wanted.items()}

    plan = []
    for s in wanted:
        segments, integral = integrated(schedule[s])
        plan.append((s, available[s], demand[s], segments or [(0.0, 1.0, 0.0, 0.0)], integral if segments and integral > 0 else 1.0))
    plan = spark.createDataFrame(plan, "source string, all_tokens long, demand double, segments array<struct<t:double,w:double,s:double,c:double>>, integral double")

    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("offset", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(F.broadcast(offsets) if small else offsets, ["source", "bucket"])  # a bucket has about bucket_rows rows
        .join(F.broadcast(plan), "source")
        .withColumn("offset", F.col("offset") + F.col("before"))
        .where(F.col("offset") < F.col("demand"))
    )
    copies = F.ceil((F.col("demand") - F.col("offset")) / F.col("all_tokens")).cast("int")
    drawn = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    reached = (F.col("copy") * F.col("all_tokens") + F.col("offset")) / F.col("demand") * F.col("integral")
    drawn = drawn.withColumn("reached", reached).withColumn("seg", F.element_at(F.filter("segments", lambda x: x["c"] <= F.col("reached")), -1))
    q = F.col("reached") - F.col("seg.c")
    root = F.sqrt(F.greatest(F.col("seg.w") * F.col("seg.w") + 2 * F.col("seg.s") * q, F.lit(0.0)))
    position = F.col("seg.t") + F.when(q <= 0, F.lit(0.0)).otherwise(2 * q / (F.col("seg.w") + root))
    mixture = drawn.select(position.alias("position"), "source", "doc_id", "copy", "tokens").orderBy("position", "source", "doc_id", "copy")

    taken = drawn.groupBy("source").agg(F.count_if(F.col("copy") == 0).alias("documents"), (F.max("copy") + 1).alias("most_copies"), F.sum("tokens").alias("tokens"))
    goals = spark.createDataFrame([(s, share, available[s], repeats, float(largest)) for s, (share, repeats) in wanted.items()], "source string, target_share double, available_tokens long, max_repeats int, largest_total double")
    every = Window.partitionBy()
    report = (
        goals.join(F.broadcast(taken), "source", "left")
        .fillna(0, ["documents", "most_copies", "tokens"])
        .withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
        .select("source", "target_share", "available_tokens", "max_repeats", "documents", "most_copies", "tokens", "share", "largest_total")
    )
    return mixture, report
