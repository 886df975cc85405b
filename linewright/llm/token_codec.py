"""Token ids in compressed blocks: an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK`` ids.  Each block starts with an empty
model and ends with a checksum, so any block can be read alone.  For each
id, the model predicts one id from the last two (order 2), one from the
last one (order 1), and a distribution over 64 classes of ids (order 0).  The orders are mixed
in the logistic domain with learned weights: that the order-2 id comes has the evidence of orders 2 and 1, with weights
of their own where the two agree; that the order-1 id comes has the evidence of orders 1 and 0.  One range-coder event says which
prediction holds; an id that neither predicts is coded by the order-0
distribution, and its place in the class.
All arithmetic is on integers.  numpy runs many blocks in step, one in each lane.

A block in bytes (little-endian): ``LWB1``, number of ids (u32), index of its first id in
its part (u64), number of document entries (u32), number of words (u32), the entries
(document's ordinal in the part u64, doc_id i64, ids in this block u32, flags u32: 1 if the document starts here, 2 if it has no doc_id), the coder's words (u32
each), crc32 of all before (u32).  Blocks are rows of a Parquet table, which is what makes writing them
atomic when executors are lost.

Defined results: null text counts as empty; an empty text has its end id
alone; repeated doc_ids are documents of their own, in any order; a null doc_id comes first and stays null; other
columns are ignored; an empty table gives no rows.  Ids must be below 2**17.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import stored
from .token_ids import END_ID, encoder, public_path

BLOCK = 4096
LANES = 1024
_SLOTS = 4096
_U = np.uint64
_HEAD, _ENTRY = struct.Struct("<4sIQII"), struct.Struct("<QqII")


def _tables():
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.rint(np.log(p / (1 - p)) * 256).astype(np.int64)
    x = np.arange(-2048, 2048) / 256
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x))), 48, 4048).astype(np.int64)
    ids = np.arange(1 << 17)
    e = np.zeros(1 << 17, dtype=np.int64)
    for k in range(17):
        e[1 << k :] = k + 1
    extra = np.where(ids < 8, 0, e - 3)
    kind = np.where(ids < 8, ids, 8 + (e - 4) * 4 + ((ids >> np.maximum(e - 3, 0)) & 3))
    first = np.zeros(64, dtype=np.int64)
    bits = np.zeros(64, dtype=np.int64)
    for c in range(64):
        own = np.flatnonzero(kind == c)
        first[c], bits[c] = own[0], extra[own[0]]
    return stretch, squash, kind, first, bits


_STRETCH, _SQUASH, _KIND, _FIRST, _BITS = _tables()
#: A row of eight counts times this has their running sums; counts stay below 2**15, so that floats hold them exactly.
_RUNNING = np.triu(np.ones((8, 8), dtype=np.float32))


def _squashed(x: np.ndarray) -> np.ndarray:
    return _SQUASH.take(x + 2048, mode="clip")


class _Model:
    """The adaptive state of n lanes."""

    def __init__(self, n: int):
        self.lane = np.arange(n)
        #: The id that a slot predicts, above three bits of how sure it is.
        self.slots = np.zeros((2, n * _SLOTS), dtype=np.uint32)
        self.by_sure = np.full((2, n * 8), 1 << 13, dtype=np.int64)
        #: Weights of the two inputs of the first event, apart (first n) and in agreement, and of the second event.
        self.first = np.full((2, 2 * n), 1 << 15, dtype=np.int64)
        self.second = np.full((2, n), 1 << 15, dtype=np.int64)
        self.last = np.zeros((2, n), dtype=np.int64)
        #: Counts of the classes in eight groups of eight, and sums of the groups and of all.
        self.freq = np.ones(n * 64, dtype=np.float32)
        self.groups = np.full(n * 8, 8, dtype=np.float32)
        self.total = np.full(n, 64, dtype=np.int64)
        self.lanes = n

    def predict(self, n: int):
        """Ids of order 2 and 1 for the first n lanes, and the limits of their parts of 2**16."""
        one, two, lane = self.last[0, :n], self.last[1, :n], self.lane[:n]
        hashed = ((one * 0x9E3779B1 + two * 0x85EBCA77) & 0xFFFFFFFF) >> 20, ((one * 0x9E3779B1) & 0xFFFFFFFF) >> 20
        self.at = [lane * _SLOTS + h for h in hashed]
        self.held = [self.slots[k].take(self.at[k]) for k in (0, 1)]
        guess = self.held[0] >> 3, self.held[1] >> 3
        self.known = [h & 7 for h in self.held]
        self.place = [lane * 8 + k for k in self.known]
        s2, s1 = (_STRETCH.take(self.by_sure[k].take(self.place[k]) >> 4) for k in (0, 1))
        s0 = _STRETCH.take(np.minimum((self.freq.take(lane * 64 + _KIND.take(guess[1])).astype(np.int64) << 12) // self.total[:n], 4095))
        self.agree = guess[0] == guess[1]
        self.row = lane + self.agree * self.lanes
        p = _squashed((self.first[0].take(self.row) * s2 + self.first[1].take(self.row) * s1) >> 16)
        q = _squashed((self.second[0, :n] * s1 + self.second[1, :n] * s0) >> 16)
        self.inputs = s2, s1, s0, p, q
        first = p << 4
        second = np.where(self.agree, 0, ((65536 - first) * q) >> 12)
        return guess, first, first + second

    def learn(self, n: int, guess, ids: np.ndarray) -> None:
        s2, s1, s0, p, q = self.inputs
        hits = [guess[k] == ids for k in (0, 1)]
        err = (hits[0].astype(np.int64) << 12) - p
        self.first[0][self.row] += (s2 * err) >> 10
        self.first[1][self.row] += (s1 * err) >> 10
        # The second event only took place where the first did not, between different ids.
        err = np.where(hits[0] | self.agree, 0, (hits[1].astype(np.int64) << 12) - q)
        self.second[0, :n] += (s1 * err) >> 10
        self.second[1, :n] += (s0 * err) >> 10
        fresh = ids.astype(np.uint32) << 3
        for k in (0, 1):
            hit, known, held, place = hits[k], self.known[k], self.held[k], self.place[k]
            old = self.by_sure[k].take(place)
            self.by_sure[k][place] = old + (((hit.astype(np.int64) << 16) - hit - old) >> 5)
            missed = np.where(known > 0, held - ((known + 1) >> 1), fresh)
            self.slots[k][self.at[k]] = np.where(hit, held + (known < 7), missed)
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids

    def learn_class(self, lanes: np.ndarray, kind: np.ndarray) -> None:
        self.freq[lanes * 64 + kind] += 24
        self.groups[lanes * 8 + (kind >> 3)] += 24
        total = self.total.take(lanes) + 24
        self.total[lanes] = total
        full = lanes[total > 1 << 14]
        if len(full):
            half = np.floor((self.freq.reshape(-1, 8, 8)[full] + 1) / 2)
            self.freq.reshape(-1, 8, 8)[full] = half
            self.groups.reshape(-1, 8)[full] = half.sum(axis=2)
            self.total[full] = half.sum(axis=(1, 2)).astype(np.int64)

    def class_part(self, lanes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all classes before each lane's class, and of that class."""
        row, group, place = np.arange(len(lanes)) * 8, kind >> 3, kind & 7
        own = self.freq.take(lanes * 64 + kind)
        before = (self.groups.reshape(-1, 8).take(lanes, axis=0) @ _RUNNING).take(row + group) - self.groups.take(lanes * 8 + group)
        inside = (self.freq.reshape(-1, 8).take(lanes * 8 + group, axis=0) @ _RUNNING).take(row + place) - own
        return (before + inside).astype(_U), own.astype(_U)

    def class_at(self, lanes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class in whose part of the counts each lane's value is, and what ``class_part`` says of it."""
        row, value = np.arange(len(lanes)) * 8, value.astype(np.float32)
        sums = self.groups.reshape(-1, 8).take(lanes, axis=0) @ _RUNNING
        group = (sums <= value[:, None]).sum(axis=1)
        before = sums.take(row + group) - self.groups.take(lanes * 8 + group)
        sums = self.freq.reshape(-1, 8).take(lanes * 8 + group, axis=0) @ _RUNNING
        place = (sums <= (value - before)[:, None]).sum(axis=1)
        kind = group * 8 + place
        own = self.freq.take(lanes * 64 + kind)
        return kind, (before + sums.take(row + place) - own).astype(_U), own.astype(_U)


def _encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The coder's words of each block; blocks come longest first."""
    n = len(blocks)
    sizes = np.array([len(b) for b in blocks])
    data = np.zeros((int(sizes[0]), n), dtype=np.int64)
    for k, b in enumerate(blocks):
        data[: len(b), k] = b
    model = _Model(n)
    low, span = np.zeros(n, dtype=_U), np.full(n, (1 << 64) - 1, dtype=_U)
    out = np.zeros((n, 2 * int(sizes[0]) + 8), dtype=np.uint32)
    ptr = np.zeros(n, dtype=np.int64)
    full = _U(0xFFFFFFFF)

    def code(lanes, cum, freq, unit) -> None:
        """unit: the share of the span that stands for 1."""
        new_low, new_span = low[lanes] + cum * unit, freq * unit
        low[lanes], span[lanes] = new_low, new_span
        small = np.flatnonzero(new_span <= full)
        if len(small):
            own = small if isinstance(lanes, slice) else lanes[small]
            a, r = new_low[small], new_span[small]
            # The span may reach over a boundary of the word that goes out: then it ends there.
            r = np.where((a ^ (a + r)) >> _U(32) != 0, (~a & full) + _U(1), r)
            out[own, ptr[own]] = (a >> _U(32)).astype(np.uint32)
            ptr[own] += 1
            low[own], span[own] = a << _U(32), np.minimum(r, full) << _U(32)

    for t in range(int(sizes[0])):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        ids = data[t, :k]
        guess, a, b = model.predict(k)
        is_two, is_one = guess[0] == ids, guess[1] == ids
        cum = np.where(is_two, 0, np.where(is_one, a, b))
        freq = np.where(is_two, a, np.where(is_one, b - a, 65536 - b))
        code(slice(0, k), cum.astype(_U), freq.astype(_U), span[:k] >> _U(16))
        miss = np.flatnonzero(~is_two & ~is_one)
        if len(miss):
            kind = _KIND[ids[miss]]
            code(miss, *model.class_part(miss, kind), span[miss] // model.total.take(miss).astype(_U))
            model.learn_class(miss, kind)
            more = np.flatnonzero(_BITS[kind])
            if len(more):
                lanes = miss[more]
                code(lanes, (ids[lanes] - _FIRST[kind[more]]).astype(_U), np.ones(len(more), dtype=_U), span[lanes] >> _BITS[kind[more]].astype(_U))
        model.learn(k, guess, ids)
    for word in (low >> _U(32), low & full):
        out[np.arange(n), ptr] = word.astype(np.uint32)
        ptr += 1
    return [out[k, : ptr[k]] for k in range(n)]


def _decode(words: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Ids by step and lane of blocks with these sizes, longest first."""
    n = len(words)
    steps = int(sizes[0])
    source = np.zeros((n, max(map(len, words)) + 2), dtype=_U)
    for k, w in enumerate(words):
        source[k, : len(w)] = w
    model = _Model(n)
    # rest: how far the code stands above the low end of the span.
    low, span = np.zeros(n, dtype=_U), np.full(n, (1 << 64) - 1, dtype=_U)
    code = (source[:, 0] << _U(32)) | source[:, 1]
    ptr = np.full(n, 2, dtype=np.int64)
    data = np.zeros((steps, n), dtype=np.int64)
    full = _U(0xFFFFFFFF)

    def advance(lanes, cum, freq, unit) -> None:
        new_low, new_span = low[lanes] + cum * unit, freq * unit
        low[lanes], span[lanes] = new_low, new_span
        small = np.flatnonzero(new_span <= full)
        if len(small):
            own = small if isinstance(lanes, slice) else lanes[small]
            a, r = new_low[small], new_span[small]
            r = np.where((a ^ (a + r)) >> _U(32) != 0, (~a & full) + _U(1), r)
            low[own], span[own] = a << _U(32), np.minimum(r, full) << _U(32)
            code[own] = (code[own] << _U(32)) | source[own, np.minimum(ptr[own], source.shape[1] - 1)]
            ptr[own] += 1

    for t in range(steps):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        guess, a, b = model.predict(k)
        unit = span[:k] >> _U(16)
        value = np.minimum((code[:k] - low[:k]) // unit, _U(65535)).astype(np.int64)
        is_two, is_one = value < a, (value >= a) & (value < b)
        cum = np.where(is_two, 0, np.where(is_one, a, b))
        freq = np.where(is_two, a, np.where(is_one, b - a, 65536 - b))
        advance(slice(0, k), cum.astype(_U), freq.astype(_U), unit)
        ids = np.where(is_two, guess[0], guess[1]).astype(np.int64)
        miss = np.flatnonzero(~is_two & ~is_one)
        if len(miss):
            total = model.total.take(miss).astype(_U)
            unit = span[miss] // total
            kind, cum, freq = model.class_at(miss, np.minimum((code[miss] - low[miss]) // unit, total - _U(1)))
            advance(miss, cum, freq, unit)
            model.learn_class(miss, kind)
            found = _FIRST[kind]
            more = np.flatnonzero(_BITS[kind])
            if len(more):
                lanes, bits = miss[more], _BITS[kind[more]]
                unit = span[lanes] >> bits.astype(_U)
                value = np.minimum((code[lanes] - low[lanes]) // unit, ((1 << bits) - 1).astype(_U))
                advance(lanes, value, np.ones(len(more), dtype=_U), unit)
                found[more] += value.astype(np.int64)
            ids[miss] = found
        data[t, :k] = ids
        model.learn(k, guess, ids)
    return data


def encode_blocks(ids: np.ndarray, entries: list[tuple[int, int | None, int]], first_index: int, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """Blocks of the ids of documents (ordinal, doc_id, number of ids) that follow one another.

    The first document may have begun before: its ordinal then occurs in earlier blocks too,
    and it is the caller who says so by a negative number of ids, of which the rest is here.
    """
    if len(ids) and int(ids.max()) >= 1 << 17:
        raise ValueError("ids must be below 2**17")
    parts = [ids[k : k + block] for k in range(0, len(ids), block)]
    words: list[np.ndarray] = []
    for k in range(0, len(parts), lanes):
        words += _encode(parts[k : k + lanes])
    out, queue, open_ = [], iter(entries), None
    for k, (part, w) in enumerate(zip(parts, words)):
        need, table = len(part), []
        while need:
            if open_ is None:
                ordinal, doc, n = next(queue)
                open_ = [ordinal, doc, abs(n), int(n > 0)]
            take = min(need, open_[2])
            table.append(_ENTRY.pack(open_[0], open_[1] or 0, take, open_[3] | (2 if open_[1] is None else 0)))
            open_[2] -= take
            open_[3] = 0
            need -= take
            if not open_[2]:
                open_ = None
        raw = _HEAD.pack(b"LWB1", len(part), first_index + k * block, len(table), len(w)) + b"".join(table) + w.astype("<u4").tobytes()
        out.append(raw + zlib.crc32(raw).to_bytes(4, "little"))
    return out


def decode_blocks(blocks: list[bytes], lanes: int = LANES) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int, int]]]]:
    """(index of the first id, ids, entries) of each block, in any order; a damaged block raises ValueError."""
    parsed = []
    for raw in blocks:
        if len(raw) < _HEAD.size + 4 or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
            raise ValueError("damaged block")
        magic, n, first, entries, words = _HEAD.unpack_from(raw)
        if magic != b"LWB1":
            raise ValueError("not a block")
        at = _HEAD.size + _ENTRY.size * entries
        parsed.append((n, first, list(_ENTRY.iter_unpack(raw[_HEAD.size : at])), np.frombuffer(raw, dtype="<u4", count=words, offset=at)))
    parsed.sort(key=lambda x: -x[0])
    for k in range(0, len(parsed), lanes):
        some = parsed[k : k + lanes]
        data = _decode([x[3] for x in some], np.array([x[0] for x in some]))
        for j, (n, first, entries, _) in enumerate(some):
            yield first, data[:n, j].astype("<u4"), entries


# crc32 of A followed by B, from those of A and B.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of polynomials mod the crc's, bits reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


_SHIFTS = [0x00800000]  # x**8
for _ in range(63):
    _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    shift, k = 0x80000000, 0
    while second_bytes:
        if second_bytes & 1:
            shift = _times(_SHIFTS[k], shift)
        second_bytes >>= 1
        k += 1
    return _times(shift, first) ^ second


_BLOCKS = "part int, block long, data binary"


def _writer(path: str, block: int, lanes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, end = encoder(path), END_ID.to_bytes(4, "little")
        raw_of = ids_of.whole
        waiting, entries, size, done, ordinal = [], [], 0, 0, 0

        def flush(whole: bool) -> pa.RecordBatch:
            nonlocal waiting, entries, size, done
            ids = np.frombuffer(b"".join(waiting), dtype="<u4")
            use = size if whole else size - size % block
            made = encode_blocks(ids[:use], entries, done, block, lanes)
            numbers = [done // block + k for k in range(len(made))]
            rest = size - use
            done += use
            waiting, size = [ids[use:].tobytes()] if rest else [], rest
            # What is left belongs to the last documents; the first of them may have begun.
            left, here = [], rest
            for o, d, n in reversed(entries):
                if not here:
                    break
                left.append((o, d, n if abs(n) <= here else -here))
                here -= min(abs(n), here)
            entries = left[::-1]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), pa.array(numbers, pa.int64()), pa.array(made, pa.binary())], names=["part", "block", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = raw_of(text.as_py() or "") + end
                doc = doc.as_py()
                waiting.append(raw)
                entries.append((ordinal, doc, len(raw) // 4))
                ordinal += 1
                size += len(raw) // 4
                if size >= block * lanes:
                    yield flush(False)
        ids_of.trim()
        if size:
            yield flush(True)

    return write


def write_ids(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """Writes the ids of docs in ascending doc_id order; the table of blocks as read back."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(K.releasing(_writer(tokenizer or public_path(), block, lanes)), _BLOCKS), "token-blocks")


_SEGMENTS = "part int, ordinal long, doc_id long, start long, n long, crc long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column(0).to_pylist()
        for part in sorted(set(parts)):
            blocks = [b.as_py() for p, b in zip(parts, batch.column(1)) if p == part]
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for first, ids, entries in decode_blocks(blocks):
                at = 0
                for ordinal, doc, n, flags in entries:
                    values = part, ordinal, None if flags & 2 else doc, first + at, n, zlib.crc32(ids[at : at + n].tobytes())
                    for column, value in zip(out, values):
                        column.append(value)
                    at += n
            kinds = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for segments in batch.column(batch.schema.get_field_index("segments")).to_pylist():
            crc = segments[0]["crc"]
            for s in segments[1:]:
                crc = crc32_joined(crc, s["crc"], 4 * s["n"])
            crcs.append(crc)
        names = ["part", "doc_id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"])


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from decoded blocks."""
    segments = stored(blocks.select("part", "data").mapInArrow(K.releasing(_reader), _SEGMENTS), "segments")
    docs = segments.groupBy("part", "ordinal").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("segments"))
    joined = docs.drop("ordinal").mapInArrow(K.releasing(_join_segments), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    totals = segments.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each written file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return joined.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
