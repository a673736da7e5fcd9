"""Passages of test items inside documents.

Containment is searched by MinHash over windows.  A passage is a number of
consecutive words of an item, brought to letters and digits; passages are
partitioned by size, the power of ``STEP`` at or below their length, and stand
by their first window of that size.  A window's MinHash is the least hash of
its shingles.  Each document is hashed once for all sizes, and of each size it
has the MinHash of every window of its text: a document that contains a
passage contains its window, so their MinHashes agree, and no candidate is
lost.  A Bloom filter of the passages' MinHashes goes to all tasks; what passes
it meets the passages in a join on size and MinHash, with the piece of text in
which the passage must stand, and is verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SMALL_ROWS, exactly, stored
from .text import code_points, letter_codes, letters

#: Characters of a shingle; of shorter passages the passage itself is the shingle.
SHINGLE = 16
#: Ratio of neighbouring window sizes.
STEP = 1.5
#: Characters hashed at a time, so that the arrays stay in the processor's cache.
CHUNK = 1 << 16
#: Bits of each half of the filter of one size: at least, and at most (8 MB).
LEAST_BITS, MOST_BITS = 18, 26
_PRIME = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of ``size`` characters in order; powers of two are doubled up to."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    h = codes.astype(np.uint64)
    if size & (size - 1):
        parts = [h[i : len(h) - size + 1 + i] for i in range(size)]
        h = parts[0]
        for part in parts[1:]:
            h = h * np.uint64(_PRIME) + part
        return _mixed(h)
    power, width = _PRIME, 1
    while width < size:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, width * 2
    return _mixed(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive hashes."""
    if len(h) < width:
        return np.empty(0, h.dtype)
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def size_class(n: int) -> int:
    """Window size of a passage of ``n`` characters."""
    size = min(n, SHINGLE)
    while SHINGLE <= int(size * STEP) <= n:
        size = int(size * STEP)
    return size


def passages(items: DataFrame, words: int, plain: Callable[[str], str] = letters) -> DataFrame:
    """``size, hash, item_id, passage`` of all runs of ``words`` words of the items, each once per item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                split = [plain(w) for w in text.split()]
                found |= {(item, p) for i in range(len(split) - words + 1) if (p := "".join(split[i : i + words]))}
            rows = [(size_class(len(p)), item, p) for item, p in sorted(found)]
            hashes = np.array([shingle_hashes(code_points(p[:size]), min(size, SHINGLE)).min() for size, _, p in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(hashes), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["size", "hash", "item_id", "passage"])

    return items.mapInArrow(cut, "size int, hash long, item_id string, passage string")


def passage_filter(known: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per size a Bloom filter of two halves, each of its own bits of the hash: ``(bits, words of 64 bits)``.

    Set in groups of 64 bits by aggregation; bounded by ``MOST_BITS`` however many passages there are.
    """
    filters = {}
    for size, n in known.groupBy("size").count().collect():
        bits = max(LEAST_BITS, min(MOST_BITS, (1024 * n).bit_length()))
        mask = F.lit((1 << bits) - 1)
        halves = F.array(*(F.struct(F.lit(i).alias("half"), F.shiftrightunsigned("hash", 64 - (i + 1) * bits).bitwiseAND(mask).alias("bit")) for i in (0, 1)))
        of = known.where(F.col("size") == size).select(F.explode(halves).alias("h")).select("h.half", "h.bit")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
        table = of.groupBy("half", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("set")).toArrow()
        words = np.zeros((2, 1 << (bits - 6)), np.uint64)
        half, word, on = (table.column(c).to_numpy() for c in ("half", "word", "set"))
        words[half, word] = on.view(np.uint64)
        filters[size] = bits, words
    return filters


def _passes(filter_: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    bits, words = filter_
    at = np.arange(len(h))
    for i in (0, 1):
        bit = (h[at] >> np.uint64(64 - (i + 1) * bits)) & np.uint64((1 << bits) - 1)
        at = at[(words[i][bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def candidates(filters: dict, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """MinHashes that may be known, of the windows of texts that begin at ``starts``: hashes, places, size.

    Of a run of equal ones in a text there is the first, and one more for every
    ``size - SHINGLE + 1`` windows that it goes on.
    """
    overlap = max(filters, default=SHINGLE) - 1
    for begin in range(0, max(1, len(codes) - overlap), CHUNK):
        piece = codes[begin : begin + CHUNK + overlap]
        h = shingle_hashes(piece)
        for size, filter_ in filters.items():
            width = max(1, size - SHINGLE + 1)
            m = window_minima(h, width) if size >= SHINGLE else shingle_hashes(piece, size)
            if not len(m):
                continue
            new = np.r_[True, m[1:] != m[:-1]]  # neighbouring windows mostly share their least shingle
            new[starts[(starts >= begin) & (starts < begin + len(m))] - begin] = True
            at = np.flatnonzero(new)
            at = at[_passes(filter_, m[at])]
            ends = np.flatnonzero(np.r_[new[1:], True])
            ends = ends[np.searchsorted(ends, at)]  # last place of each run
            more = (ends - at) // width
            if len(at):
                places = np.repeat(at, more + 1) + width * (np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
                yield m[places], begin + places, size


def _search(shared, plain: Callable[[str], str]):
    codes_of = letter_codes if plain is letters else lambda text: code_points(plain(text))
    columns = ["doc_id", "size", "hash", "piece"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            found: dict[tuple, None] = {}
            gather, owner, length = [], [], 0

            def flush() -> None:
                """Short texts are hashed together; a piece ends with its text."""
                nonlocal gather, owner, length
                if not length:
                    gather, owner = [], []
                    return
                bounds = np.cumsum([len(c) for c in gather])
                codes = np.concatenate(gather)
                for hashes, places, size in candidates(filters, codes, np.r_[0, bounds[:-1]][np.diff(np.r_[0, bounds]) > 0]):
                    doc = np.searchsorted(bounds, places, "right")
                    reach = max(0, size - SHINGLE) + int(size * STEP) + 2
                    for h, at, d in zip(hashes.view(np.int64).tolist(), places.tolist(), doc.tolist()):
                        piece = codes[at : min(at + reach, bounds[d])].tobytes().decode("utf-32-le", "surrogatepass")
                        found[owner[d], size, h, piece] = None
                gather, owner, length = [], [], 0

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                gather.append(codes_of(text.as_py()))
                owner.append(doc_id)
                length += len(gather[-1])
                if length >= CHUNK:
                    flush()
            flush()
            rows = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.string()))], columns)

    return search


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 13, plain: Callable[[str], str] = letters) -> DataFrame:
    """Documents that hold ``words`` consecutive words of a test item, and which.

    Words are what blanks separate.  Both sides are brought to Unicode form
    NFKC, without case, and everything but letters and digits is removed, so
    line breaks, hyphens and blanks inside a document's words do not hide a
    passage; ``plain`` may bring them to another form.  Whole texts are
    searched, once for all items.

    Passages are written to the shared folder.  What goes to all tasks is their
    filter, whose size is bounded; the passages themselves are joined to the
    few pieces of text that pass it, by a broadcast if they are at most
    ``SMALL_ROWS``, else by a shuffle on their hash.

    Items with fewer words, null texts and null ids hold nothing; repeated
    document rows give one result row; an empty table gives none.

    Result: ``doc_id, item_id``.
    """
    spark = documents.sparkSession
    docs = exactly(documents, "doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    wanted = exactly(items, "item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    known, _ = stored(passages(wanted, words, plain))
    filters = passage_filter(known)
    if known.count() <= SMALL_ROWS:  # answered from Parquet footers
        known = F.broadcast(known)
    pieces = docs.mapInArrow(_search(spark.sparkContext.broadcast(filters), plain), "doc_id long, size int, hash long, piece string")
    return pieces.join(known, ["size", "hash"]).where(F.contains("piece", "passage")).select("doc_id", "item_id").distinct()
