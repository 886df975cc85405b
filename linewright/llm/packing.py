"""Packing of tokenised documents into sequences by exact complements, then best fit.

The plan needs only the number of pieces of each length, a table of at most
``max_len`` rows whatever the size of the corpus.  On it, sums of one, two
and three lengths are looked up by their exact complement; a combination
that fills a sequence is used as often as its lengths are available, which
uses up at least one length, so there are at most ``max_len`` of them.  What
is left goes in decreasing order to the open sequence with the least
space that still holds it, many equal pieces at a time.  Pieces then find their
slot by their rank among the pieces of their length.  The ranks are dealt by a
salt, so that no task holds a whole length.

Defined results: null text counts as empty; an empty text still has its end id
and is one piece of length 1; repeated doc_ids are packed as rows of their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import stored
from .token_ids import END_ID, encoder, public_path

MAX_LEN = 2048
#: Pieces of one length that share a salt.
RANK_GROUP = 250_000
#: Parts of a length's ranks by which pieces find their slots.
RANK_PARTS = 32

Pattern = tuple[tuple[int, ...], int]


def exact_complements(counts: np.ndarray) -> list[Pattern]:
    """Uses up counts (by length) in combinations that fill a sequence exactly."""
    size = len(counts) - 1
    out: list[Pattern] = []

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // n for x, n in need.items())
        if times:
            out.append((lengths, times))
            for x, n in need.items():
                counts[x] -= n * times

    take(size)
    for a in range(size - 1, (size - 1) // 2, -1):
        take(a, size - a)
    for a in range(size - 2, 0, -1):
        if not counts[a]:
            continue
        rest = size - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        for x in b[(counts[b] > 0) & (counts[rest - b] > 0)].tolist():
            if not counts[a]:
                break
            take(a, x, rest - x)
    return out


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Places what counts holds, longest first, each into the fullest sequence that has room."""
    size = len(counts) - 1
    groups: list[list[list]] = [[] for _ in range(size + 1)]  # by space left: [lengths, times]
    free = np.zeros(size + 1, dtype=np.int64)
    for length in range(size, 0, -1):
        left = int(counts[length])
        counts[length] = 0
        while left:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = size // length
                full, rest = divmod(left, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        groups[size - n * length].append([(length,) * n, times])
                        free[size - n * length] += times
                break
            space = length + int(fits[0])
            group = groups[space][-1]
            times = min(left, group[1])
            if times == group[1]:
                groups[space].pop()
            else:
                group[1] -= times
            free[space] -= times
            groups[space - length].append([group[0] + (length,), times])
            free[space - length] += times
            left -= times
    return [(tuple(lengths), times) for own in groups for lengths, times in own]


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[Pattern]:
    """Combinations of lengths, and how many sequences each makes."""
    counts = np.zeros(max_len + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    exact = exact_complements(counts)
    return exact + best_fit(counts)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset)."""
    out, rank, base = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            r = rank.get(x, 0)
            out.append((x, r, r + times, base, offset))
            rank[x] = r + times
            offset += x
        base += times
    return out


def by_rank(found: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Slots under each part of their length's ranks that they reach into: (length, part, ...).

    At most RANK_PARTS rows a length more than there are slots, and a part holds few of them.
    """
    out = []
    for length, low, high, sequence, offset in found:
        size = _part_size(counts[length])
        out += [(length, part, low, high, sequence, offset) for part in range(low // size, (high - 1) // size + 1)]
    return out


def _part_size(count: int) -> int:
    return -(-count // RANK_PARTS)


def _cutter(path: str, max_len: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        raw_of = ids_of.whole
        end = END_ID.to_bytes(4, "little")
        for batch in K.slices(batches):
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc, text in zip(ids, batch.column(1)):
                raw = raw_of(text.as_py() or "") + end
                n = len(raw) // 4
                first = n % max_len or max_len
                for piece, start in enumerate([0, *range(first, n, max_len)]):
                    length = first if not piece else max_len
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids_of.trim()

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(K.releasing(_cutter(tokenizer or public_path(), max_len)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer, max_len), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    salts = max(16, max(histogram.values(), default=0) // RANK_GROUP)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(own)).join(starts, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    table = spark.createDataFrame(by_rank(slots(plan(histogram, max_len)), histogram), "length long, part long, low long, high long, sequence long, offset long")
    sizes = spark.createDataFrame([(x, _part_size(n)) for x, n in histogram.items()], "length long, size long")
    parted = ranked.join(F.broadcast(sizes), "length").withColumn("part", F.floor(F.col("rank") / F.col("size")))
    # The plan's size is bounded by max_len.
    placed = parted.join(F.broadcast(table), ["length", "part"]).filter("rank >= low and rank < high")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
