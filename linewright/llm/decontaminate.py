"""Benchmark decontamination by the CGK embedding, bit sampling and exact edit checks.

Edit distance is counted in words, which are lower-cased and rid of
punctuation.  The CGK random walk reads a window of words: at step j it
emits the word under it, and a random bit of (j, word) says whether it moves
on.  Windows at a small edit distance thus emit streams at a small Hamming
distance.  Each table samples some steps of one walk; a window whose samples
equal those of a window of an item is a candidate.

Windows start at every word of a document and at every word of an item from
which the walk ends inside the item and samples at least ``MIN_COVER`` places (fewer
would meet every common phrase).  A walk of ``STEPS`` steps covers about half as
many words, so an item has many windows, each with ``WALKS * SAMPLES`` tables.

The walks may miss an item, and short items may have no window at all.  So a second
table holds every run of ``GRAM`` words of every item: an edit breaks at most ``GRAM``
of them, so an item of n words within e edits shares n - GRAM + 1 - GRAM * e runs with
the document, on diagonals at most e apart.  Places with that many are candidates
too; with ``MAX_EDITS`` the bound is at least 2 for any item of ``MIN_WORDS`` words or more, so
that none within ``max_edits`` goes unseen.  Candidates
are aligned exactly with the document around them (any start, any end), and count
within ``max_edits`` edits a word of the item.

Items go to every task in blocks of about ``BLOCK_WORDS`` words (one longer item is a block of its own); each block is
one pass over the documents, so the memory of a pass is bounded, and a worker builds a block's index once.

Defined results: null and empty texts and items match nothing; items shorter than
``MIN_WORDS`` words match only as a whole and exactly, and only if they have ``min_letters`` bytes (by default
``MIN_LETTERS``: shorter ones are phrases that any text may hold; 1 looks for all of them); repeated doc_ids are judged row by
row; repeated item_ids are items of their own; null ids stay null; texts and items of any length are read whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import without_ids

STEPS = 16
WALKS = 2
SAMPLES = 2
SAMPLED = 7
MIN_COVER = 5
GRAM = 3
MIN_WORDS = 8
MIN_LETTERS = 12
MAX_EDITS = 0.2
BLOCK_WORDS = 1_000_000

_KEEP = np.zeros(256, dtype=bool)  # letters, digits and everything beyond ASCII
_KEEP[48:58] = _KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True
_rng = np.random.default_rng(20240229)
_CHOSEN = [[np.sort(_rng.choice(STEPS, size=SAMPLED, replace=False)).tolist() for _ in range(SAMPLES)] for _ in range(WALKS)]
_SALTS = [np.uint64(x) for x in _rng.integers(1, 2**63, size=WALKS)]


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each normalised word, its row, and its index among the words of its row.

    Words without a letter or digit are left out.
    """
    starts, ends, row = K.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), row, row
    keep = _KEEP[data]
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    a, b = at[starts], at[ends]
    ids = K.range_hashes(K.LOWER[data[keep]], a, b)
    full = np.flatnonzero(b > a)
    own = np.arange(len(row)) - np.searchsorted(row, row)
    return ids[full], row[full], own[full]


def walk_keys(ids: np.ndarray, full: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(table, key of the window at each word): the walks of all windows at once.

    The walk's bit for a word at step j is bit j of a hash of the word.
    Windows that run over the end read padding.  With full, also the last word
    that each window sampled and how many different places it sampled.
    """
    n = len(ids)
    padded = np.concatenate((ids, np.zeros(STEPS + 1, dtype=np.uint64)))
    here, first = np.empty(n, dtype=np.uint32), np.arange(n)
    for walk in range(WALKS):
        bits = (K.mix(padded ^ _SALTS[walk]) >> np.uint64(32)).astype(np.uint32)
        keys = [np.zeros(n, dtype=np.uint32) for _ in range(SAMPLES)]
        last: list = [first if full else None] * SAMPLES
        cover = [np.ones(n, dtype=np.int64) for _ in range(SAMPLES)] if full else [None] * SAMPLES
        at = first.copy()
        for j in range(STEPS):
            np.take(bits, at, out=here, mode="clip")
            for k, chosen in enumerate(_CHOSEN[walk]):
                if j in chosen:
                    keys[k] *= np.uint32(0x9E3779B1)
                    keys[k] ^= here
                    if full:
                        if j != chosen[0]:
                            cover[k] += at != last[k]
                        last[k] = at.copy()
            here >>= np.uint32(j)
            here &= np.uint32(1)
            np.add(at, here, out=at, casting="unsafe")
        for k in range(SAMPLES):
            key = keys[k]
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x85EBCA6B)
            key ^= key >> np.uint32(13)
            yield walk * SAMPLES + k, key, last[k], cover[k]


def gram_keys(ids: np.ndarray) -> np.ndarray:
    """The key of the GRAM words from each word on, as far as they are inside."""
    key = np.zeros(max(0, len(ids) - GRAM + 1), dtype=np.uint64)
    for j in range(GRAM):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= ids[j : j + len(key)]
    return (K.mix(key) >> np.uint64(32)).astype(np.uint32)


_FILTER_BITS = np.uint32(32 - 20)


class ItemIndex:
    """The keys of one block of items: per table the sorted keys, with the item and the place of each."""

    def __init__(self, items: list[tuple[int | None, str]], max_edits: float = MAX_EDITS, min_letters: int = MIN_LETTERS):
        self.names = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        parts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[(np.zeros(0, dtype=np.uint32),) + (np.zeros(0, dtype=np.int64),) * 2] for _ in range(WALKS * SAMPLES)]
        grams = [(np.zeros(0, dtype=np.uint32),) + (np.zeros(0, dtype=np.int64),) * 2]
        first: list[tuple[int, int]] = []
        for k, (_, text) in enumerate(items):
            raw = (text or "").encode()
            ids, _, _ = word_ids(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
            self.words.append(ids)
            if len(ids) >= MIN_WORDS:
                runs = gram_keys(ids)
                grams.append((runs, np.full(len(runs), k), np.arange(len(runs))))
                for table, keys, last, cover in walk_keys(ids, full=True):
                    inside = np.flatnonzero((last < len(ids)) & (cover >= min(MIN_COVER, len(ids) - 3)))
                    parts[table].append((keys[inside], np.full(len(inside), k), inside))
            elif len(ids) and len(raw) >= min_letters:
                first.append((int(ids[0] >> np.uint64(32)), k))
        self.sets = [np.unique(w) for w in self.words]
        self.tables = []
        for own in parts:
            self.tables.append(self._sorted(*(np.concatenate(x) for x in zip(*own))))
        self.grams = self._sorted(*(np.concatenate(x) for x in zip(*grams)))
        # How far apart the diagonals of an item's shared runs may be, and how many runs it shares at least.
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.apart = (size * max_edits).astype(np.int64)
        self.shared = np.maximum(size - GRAM + 1 - GRAM * self.apart, 1)
        # Short items are looked up by their first word.
        self.short = self._sorted(np.array([w for w, _ in first], dtype=np.uint32), np.array([k for _, k in first], dtype=np.int64), np.zeros(len(first), dtype=np.int64))

    @staticmethod
    def _sorted(keys: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(keys, kind="stable")
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[keys >> _FILTER_BITS] = True
        return maybe, keys[order], owner[order], place[order]

    def present(self, k: int, words: np.ndarray) -> int:
        """How many of words are words of item k."""
        own = self.sets[k]
        return int((own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words).sum())

    @staticmethod
    def _found(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, the item that would start there) for each equal key."""
        maybe, known, owner, place = table
        at = np.flatnonzero(maybe[keys >> _FILTER_BITS])
        low, high = np.searchsorted(known, keys[at]), np.searchsorted(known, keys[at], side="right")
        full = high > low
        at, low, size = at[full], low[full], (high - low)[full]
        source = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(at) else np.zeros(0, dtype=np.int64)
        return np.repeat(at, size) - place[source], owner[source]

    def _by_runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts from which as many shared runs lie on near diagonals as an item within its edits must have."""
        starts, owners = self._found(self.grams, gram_keys(ids))
        order = np.lexsort((starts, owners))
        starts, owners = starts[order], owners[order]
        last = np.arange(len(starts)) + self.shared[owners] - 1
        inside = np.minimum(last, max(len(starts) - 1, 0))
        enough = (last < len(starts)) & (owners[inside] == owners) & (starts[inside] - starts <= self.apart[owners])
        return starts[enough], owners[enough]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, the item that would start there), each pair once."""
        parts = [self._found(table, keys) for table, keys in [*((self.tables[t], k) for t, k, _, _ in walk_keys(ids)), (self.short, (ids >> np.uint64(32)).astype(np.uint32))] if len(table[1])]
        if len(self.grams[1]):
            parts.append(self._by_runs(ids))
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = np.unique(np.stack((np.concatenate([o for _, o in parts]), np.concatenate([s for s, _ in parts]))), axis=1)
        return both[1], both[0]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of a part of words that is nearest to item."""
    n = len(words)
    cost, start, steps = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, w in enumerate(item):
        diagonal, above = cost[:-1] + (words != w), cost[1:] + 1
        new = np.concatenate(([k + 1], np.minimum(diagonal, above)))
        came = np.concatenate(([0], np.where(diagonal <= above, start[:-1], start[1:])))
        # From the left: the least of new[i] + j - i over i <= j, and where it came from.
        level = new - steps
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, steps, 0))
        cost, start = best + steps, came[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def leaks_in(ids: np.ndarray, found: list[tuple[int, int]], index: ItemIndex, max_edits: float = MAX_EDITS) -> list[tuple[int, int, int, int]]:
    """(item, edits, first word, word after the last) of the nearest place of each item of found (item, start) that is near enough."""
    best: dict[int, tuple[int, int, int]] = {}
    covered: dict[int, int] = {}
    for k, p in sorted(found):
        item = index.words[k]
        limit = int(len(item) * max_edits) if len(item) >= MIN_WORDS else 0
        reach = 2 * limit + 1
        if k in covered and p < covered[k] or k in best and best[k][0] == 0:
            continue
        covered[k] = p + limit + 1  # a start so near is inside the part that is aligned now
        low, high = max(0, p - reach), min(len(ids), p + len(item) + reach + limit)
        # All but limit of the item's words must be there: a cheap exact test before the alignment.
        if high - low >= len(item) - limit and index.present(k, ids[low:high]) >= len(item) - limit:
            edits, a, b = align(item, ids[low:high])
            if edits <= limit and (k not in best or edits < best[k][0]):
                best[k] = edits, low + a, low + b
    return [(k, *v) for k, v in sorted(best.items())]


_SCHEMA = "doc_id long, item_id long, edits int, item_words int, first_word long, end_word long"


@functools.lru_cache(maxsize=2)
def _index(items: tuple[tuple[int | None, str], ...], max_edits: float, min_letters: int) -> ItemIndex:
    """The index of a block, once a worker."""
    return ItemIndex(list(items), max_edits, min_letters)


def _search(items: tuple[tuple[int | None, str], ...], max_edits: float, min_letters: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, max_edits, min_letters)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for first, end, data, offsets in K.chunks(batch, "text", 1 << 17):
                ids, row, word = word_ids(data, offsets)
                if not len(ids):
                    continue
                # Padding between the rows, so that no window reads on into the next.
                gap = STEPS + 1
                spread = np.zeros(len(ids) + gap * (end - first), dtype=np.uint64)
                spread[np.arange(len(ids)) + row * gap] = ids
                starts, owners = index.hits(spread)
                if not len(starts):
                    continue
                cut = np.searchsorted(row, np.arange(end - first + 1))
                by_row: dict[int, list[tuple[int, int]]] = {}
                base = cut[:-1] + np.arange(end - first) * gap  # where each row begins in spread
                # A start may lie before its row, where an item's beginning is cut off: it belongs to the row of the words after it.
                for p, k in zip(starts.tolist(), owners.tolist()):
                    inside = min(p + len(index.words[k]) // 2, len(spread) - 1)
                    for r in {int(np.searchsorted(base, max(x, 0), side="right")) - 1 for x in (p, inside, p + len(index.words[k]) - 1)}:
                        if cut[r] < cut[r + 1]:
                            by_row.setdefault(r, []).append((k, p - int(base[r])))
                for r in sorted(by_row):
                    own, at = ids[cut[r] : cut[r + 1]], word[cut[r] : cut[r + 1]]
                    for k, edits, a, b in leaks_in(own, by_row[r], index, max_edits):
                        values = batch.column(0)[first + r].as_py(), index.names[k], edits, len(index.words[k]), int(at[a]), int(at[b - 1]) + 1
                        for column, value in zip(out, values):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return search


def find_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, block_words: int = BLOCK_WORDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """The nearest place of each item (item_id, text) in each document that holds it, in words of the document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") > 0)
    words = wanted.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    out = None
    for b in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = tuple(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))  # about block_words
        found = rows.mapInArrow(K.releasing(_search(block, max_edits, min_letters)), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents that hold no item, with all columns of docs."""
    return without_ids(docs, find_leaks(docs, items, max_edits), "leaky")
