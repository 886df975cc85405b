"""Quality rules by cross-document line frequency.

Lines are normalised (words joined by one space, A-Z lower-cased, digits as
0) and hashed.  For each host and line the distinct documents that hold it are
counted; documents with equal texts count once.  A line found in more documents of a host than
the limit is boilerplate: it is removed from all of them but the first (by
doc_id, those without one last), so that of a large group of near copies one stays whole.  A document
that loses most of its words is depleted and rejected.

Defined results: null and empty texts have no words and fail the base rule; a
null host is a host of its own; other columns are ignored; an empty table
gives an empty result.  A row is known by its doc_id, host and text: rows equal in those are
one document and get one answer, rows that share only the doc_id (or have none) are documents of their own.
Texts of any length are read whole, one at a time where they are long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import sent_if_small, stored


@dataclass(frozen=True)
class LineLimits:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: A line may be in this many documents of its host, at every size of the host.
    max_documents: int = 20
    #: If above 0, a line may also be in this share of its host's documents, which lets more pass as a host grows.
    max_share: float = 0.0
    #: A document that keeps a smaller share of its words, or fewer than min_words, is depleted.
    min_left_share: float = 0.3


# The symbols that the base counts.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_CHARACTER = np.ones(256, dtype=bool)  # else a continuation byte
_IS_CHARACTER[0x80:0xC0] = False

_SCHEMA = "row_key long, text_key long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<long>"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row, the words in windows of five words that the row holds twice or more."""
    hashed, at = K.shingles(words, row)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    cut = np.searchsorted(row[at], np.arange(n + 1))
    for k in range(n):
        own = hashed[cut[k] : cut[k + 1]]
        if len(own) < 2:
            continue
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            place = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            hit = at[cut[k] : cut[k + 1]][twice[place] == own]
            np.add.at(covered, hit, 1)
            np.add.at(covered, np.minimum(hit + 5, len(words)), -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.bincount(row[inside], minlength=n)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the \\n-split lines, and the row of each."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    # A break that ends a row starts an (empty) line of that row, which stands before the next row's first line.
    ends_at = np.concatenate((breaks, offsets[1:]))
    rows = np.concatenate((np.searchsorted(offsets[1:], breaks, side="right"), np.arange(len(offsets) - 1)))
    order = np.lexsort((ends_at, rows))
    return starts, ends_at[order], rows[order]


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the base rules and the normalised lines of each document."""
    for batch in batches:
        keys_, texts_, ids, hosts = (batch.column(k) for k in range(4))
        for first, end, data, offsets in K.chunks(batch, "text"):
            n = end - first
            starts, ends, row = K.word_spans(data, offsets)
            word_bytes = K.IS_WORD[data]
            exact = K.range_hashes(K.EXACT[data], starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
            loose = K.range_hashes(K.LINE[data], starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
            line_start, line_end, line_row = _lines(data, offsets)
            a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
            full = b > a
            line_row, a, b = line_row[full], a[full], b[full]
            whole = K.range_hashes(K.EXACT[data], line_start[full], line_end[full]) if len(a) else np.zeros(0, dtype=np.uint64)
            keys = K.range_hashes(loose, a, b) if len(a) else np.zeros(0, dtype=np.uint64)
            dup = np.zeros(n, dtype=np.int64)
            out_keys, out_words, sizes = [], [], np.zeros(n + 1, dtype=np.int32)
            cut = np.searchsorted(line_row, np.arange(n + 1))
            for k in range(n):
                s, e = cut[k], cut[k + 1]
                if s == e:
                    continue
                dup[k] = e - s - len(np.unique(whole[s:e]))
                own, back = np.unique(keys[s:e], return_inverse=True)
                out_keys.append(own)
                out_words.append(np.bincount(back, weights=(b - a)[s:e]).astype(np.int64))
                sizes[k + 1] = len(own)
            at = np.cumsum(sizes, dtype=np.int32)
            pack = lambda parts: pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)))
            columns = [
                keys_.slice(first, n), texts_.slice(first, n), ids.slice(first, n), hosts.slice(first, n), np.bincount(row, minlength=n), _per_row(word_bytes & _IS_CHARACTER[data], offsets),
                _per_row(_IS_SYMBOL[data], offsets), dup, _repeated_words(exact, row, n), pack(out_keys), pack(out_words),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _keyed(docs: DataFrame, host: str) -> tuple[Column, Column, Column, Column]:
    """(row key, text key, doc_id, host) of the rows of docs."""
    doc, own, text = F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("\0")), F.col("text").cast("string")
    return F.xxhash64(doc, own, text).alias("row_key"), F.xxhash64(text).alias("text_key"), doc.alias("doc_id"), own.alias("host")


def _described(docs: DataFrame, limits: LineLimits, host: str) -> tuple[DataFrame, DataFrame]:
    """(one verdict per row with its row_key, the lines to remove as row_key and line_key)."""
    seen = stored(docs.select(*_keyed(docs, host), F.col("text").cast("string")).mapInArrow(K.releasing(describe), _SCHEMA), "lines")
    lines = seen.select("row_key", "doc_id", "host", "text_key", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("row_key", "doc_id", "host", "text_key", F.col("l.line_keys").alias("line_key"), F.col("l.line_words").alias("words"))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "row_key")
    common = (
        lines.groupBy("host", "line_key", "text_key").agg(F.min(place).alias("place"))
        .groupBy("host", "line_key").agg(F.count("*").alias("docs"), F.min("place").alias("first"))
        .filter(F.col("docs") > limits.max_documents)
    )
    if limits.max_share > 0:
        size = seen.groupBy("host").agg(F.countDistinct("text_key").alias("host_docs"))
        common = common.join(size, "host").filter(F.col("docs") > F.col("host_docs") * limits.max_share)
    common = common.select("host", "line_key", F.col("first.row_key").alias("first_row"))
    removed = stored(lines.join(common, ["host", "line_key"]).filter("row_key <> first_row").select("row_key", "line_key", "words").distinct(), "removed-lines")
    lost = removed.groupBy("row_key").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce(F.col("lost"), F.lit(0))
    base_failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    depleted = (left < F.col("n_words") * limits.min_left_share) | (left < limits.min_words)
    verdicts = (
        seen.drop("line_keys", "line_words", "text_key", "host").join(lost, "row_key", "left")
        .select("row_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"), (F.col("n_words") - left).alias("n_removed_words"))
    )
    return verdicts, removed.select("row_key", "line_key")


def line_verdicts(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """One verdict per row of docs (doc_id, text, host)."""
    return _described(docs, limits, host)[0].drop("row_key")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        texts, gone = batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("_gone")).to_pylist()
        for k, keys in enumerate(gone):
            if keys and texts[k]:
                lines = texts[k].split("\n")
                raw = [x.encode() for x in lines]
                data, at = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
                starts, ends, row = K.word_spans(data, at)
                words = K.range_hashes(K.LINE[data], starts, ends)
                cut = np.searchsorted(row, np.arange(len(lines) + 1))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                own = dict(zip(full.tolist(), K.range_hashes(words, cut[:-1][full], cut[1:][full]).view(np.int64).tolist()))
                drop = set(keys)
                texts[k] = "\n".join(x for j, x in enumerate(lines) if own.get(j) not in drop)
        fields = [f for f in batch.schema if f.name != "_gone"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "text" else batch.column(batch.schema.get_field_index(f.name)) for f in fields], schema=pa.schema(fields))


def clean_lines(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """The kept documents without the removed lines, with all columns of docs."""
    verdicts, removed = _described(docs, limits, host)
    gone = removed.groupBy("row_key").agg(F.collect_set("line_key").alias("_gone"))
    rejected = verdicts.filter("not kept").select("row_key").distinct()
    # A row that is rejected needs no lines; null lines reject.
    changes = stored(gone.join(rejected, "row_key", "left_anti").unionByName(rejected.withColumn("_gone", F.lit(None).cast("array<long>"))).withColumnRenamed("row_key", "_changed"), "changed-rows")
    elements = changes.agg(F.sum(F.coalesce(F.size("_gone"), F.lit(0)) + 4)).first()[0] or 0
    joined = docs.join(sent_if_small(changes, elements), _keyed(docs, host)[0] == F.col("_changed"), "left")
    return joined.filter("_changed is null or _gone is not null").drop("_changed").mapInArrow(K.releasing(_without), docs.schema)
