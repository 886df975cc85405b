"""Exact n-gram Jaccard join over a metric space of documents.

Jaccard distance is a metric, so for a pivot p two documents within r of each
other differ by at most r in their distances to p.

1. Documents with equal shingle sets are one point, known by a 64-bit key of its set.
2. Points that cannot link leave.  A point links only if at least t of its
   shingles are held by another point, so one with more than 1 - t of them lonely
   goes.  That is counted twice: first on the shingles of a hash range (which can only
   show too few lonely ones), then on all shingles of the points that are left.  Counting
   moves packed arrays of (hash, key), at most one entry a shingle and ``HELD_ENTRIES`` in the first count, so no shingle is hot there;
   what each bucket of hashes finds goes back packed by buckets of points.
   What remains of a point is its shared shingles, the rarest first, and the number of lonely ones.
3. Voronoi levels.  Some points become pivots.  Every active point measures its exact
   distance to all pivots and has the nearest as its home; a cell is what is within r of its
   home.  Points within r of a pivot link to it, which contracts components.  If x is in the cell of p
   and y within r of x, then d(y, p) <= d(x, p) + r <= 2 r: so each point within 2 r
   of a pivot is replicated to its region, and cells join with their regions where triangle window,
   sizes and sketches leave room for a link between different components.  All
   links of points in cells are then known, up to contraction (see ``_contracted``).  The others stay active and
   recur with new pivots, for as long as a level's cells hold ``MIN_CELL`` points a pivot.
4. In the last level every active point is a pivot, and its region the ball of radius r.  Points meet there by the
   prefixes of their shingles (h - ceil(t n) + 1 of the shared ones, rarest first; two points that
   link share one).  Regions contract to stars first; regions that still hold several components
   join, under the same bounds and contraction.

Sketches are parities of the shingles by hash: each differing shingle flips one bit, so the
bits that differ bound the symmetric difference from below.  Pairs that all bounds
leave are counted on their whole sets.

Only pivots (at most ``PIVOTS``, of at most ``PIVOT_SHINGLES`` shingles together), counts and flags
reach the driver.  Defined results: null, empty and blank texts
have an empty set and link with nothing; texts of fewer words than the
shingle width have their whole sequence as their only shingle; rows of a repeated
doc_id are one document (the sets of all of them link, and all carry one component); rows without a doc_id
are documents of their own that lend no id to a component (null if there is none); equal rows get equal
answers; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import connected
from .scratch import BROADCAST_ROWS, sent_if_small, stored, without_ids

PERCENT = 80
#: The first count takes shingles whose lowest byte is below this, about 0.3 of them.
FIRST_COUNT = 77
#: Entries that one task of the counts holds at a time, and a mapper before it sends them.
BUCKET_ENTRIES = 500_000
HELD_ENTRIES = 500_000
#: Pivots of a level, what they hold together, and the points a pivot that make another level worth its while.
PIVOTS = 64
PIVOT_SHINGLES = 2_000_000
MIN_CELL = 4
#: Points of a cell that others are held against first, and by how much each further round takes more.
FIRST_MET = 16
#: Bits of the largest sketch.
SKETCH_BITS = 4096

_SIGNS = "doc_id long, n long, m long, key long"
_ENTRIES = "bucket long, kind int, hashes binary, keys binary"


def point_key(own: np.ndarray) -> int:
    """The key of a set of shingle hashes; 0 only for the empty one."""
    return int((K.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() | np.uint64(1)).view(np.int64)) if len(own) else 0


def _in_first_count(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(0xFF)) < np.uint64(FIRST_COUNT)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in K.chunks(batch, "text"):
                sets = list(K.shingle_sets(data, offsets, width))
                counted = [int(_in_first_count(s).sum()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(counted, pa.int64()), pa.array([point_key(s) for s in sets], pa.int64())], names=["doc_id", "n", "m", "key"])

    return sign


def _entries(width: int, bits: int, first: bool):
    """Packed entries by bucket, which the highest bits of a shingle's hash name.

    The first count needs one entry a shingle: its point's key, or 0 if several points here hold it; how many such
    shingles each of those points has is known here and goes along under the points' buckets (kind 2).
    The second has an entry for each shingle and point (kind 1), and how many of them there are here (kind 0, which comes first).
    """

    def pack(hashes: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        h, k = np.concatenate(hashes), np.repeat(np.array(keys, dtype=np.int64), [len(x) for x in hashes])
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
        h, k = h[new], k[new]
        if first:
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(starts, len(h)))
            together = k[np.repeat(size, size) > 1]
            h, k = h[starts], np.where(size == 1, k[starts], 0)
        columns: tuple[list, ...] = ([], [], [], [])

        def put(kind: int, h: np.ndarray, values: np.ndarray) -> None:
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            low = (h >> np.uint64(32 - bits)).astype(np.uint32) if first else h
            for x, y in zip(cuts, np.append(cuts[1:], len(h))):
                for column, value in zip(columns, (int(bucket[x]), kind, low[x:y].tobytes(), values[x:y].tobytes())):
                    column.append(value)

        if not first:
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            put(0, h[starts], np.diff(np.append(starts, len(h))))
        put(1, h, k)
        if first:
            packed = _by_point(bits, *_counted(together))
            for bucket, own, n in zip(*(c.to_pylist() for c in packed.columns)):
                for column, value in zip(columns, (bucket, 2, own, n)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "hashes", "keys"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, held = [], [], 0
        for batch in batches:
            wanted = None if first else batch.column(1).to_pylist()
            for row, _, data, offsets in K.chunks(batch, "text"):
                for j, own in enumerate(K.shingle_sets(data, offsets, width)):
                    if not len(own):
                        continue
                    key = point_key(own)
                    if first:
                        own = own[_in_first_count(own)]
                    elif wanted[row + j] is not None and wanted[row + j] != key:
                        continue
                    hashes.append(own)
                    keys.append(key)
                    held += len(own)
                    if held >= HELD_ENTRIES:
                        yield pack(hashes, keys)
                        hashes, keys, held = [], [], 0
        if held:
            yield pack(hashes, keys)

    return collect


def _buckets(batches: Iterator[pa.RecordBatch], *kinds) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from batches sorted by bucket."""
    now, parts = None, [[] for _ in kinds]
    for batch in batches:
        for row, bucket in enumerate(batch.column(0).to_pylist()):
            if bucket != now and parts[0]:
                yield [np.concatenate(p) for p in parts]
                parts = [[] for _ in kinds]
            now = bucket
            for k, kind in enumerate(kinds):
                parts[k].append(np.frombuffer(batch.column(batch.num_columns - len(kinds) + k)[row].as_buffer(), dtype=kind))
    if parts[0]:
        yield [np.concatenate(p) for p in parts]


def _by_point(bits: int, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns packed by buckets of points, which the highest bits of a point's key name."""
    bucket = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.append(cuts[1:], len(bucket))
    packed = [pa.array([c[order[a:b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for c in (keys, *columns)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), *packed], names=["bucket", "keys", "a", "b"][: 2 + len(columns)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found, n.astype(np.int32)


def _held(bits: int):
    """How many shingles of a bucket each point holds beside others.  Equal rows may count anew, which can only show too few lonely shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column(1).to_numpy()
                for row in np.flatnonzero(kinds == 2).tolist():
                    passed.append((batch.column(0)[row].as_py(), batch.column(2)[row].as_py(), batch.column(3)[row].as_py()))
                yield batch.filter(pa.array(kinds == 1))

        passed: list[tuple[int, bytes, bytes]] = []
        names = ["bucket", "keys", "a"]
        for h, k in _buckets(entries(), np.uint32, np.int64):
            order = np.argsort(h, kind="stable")
            h, k = h[order], k[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)
            own = k[np.repeat(several, np.diff(np.append(starts, len(h))))]
            yield _by_point(bits, *_counted(own[own != 0]))
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*passed), (pa.int64(), pa.binary(), pa.binary()))], names=names)
                passed.clear()
        if passed:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*passed), (pa.int64(), pa.binary(), pa.binary()))], names=names)

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, n in _buckets(batches, np.int64, np.int32):
        known, back = np.unique(keys, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.bincount(back, weights=n).astype(np.int64))], names=["key", "held"])


def _shared(bits: int):
    """The shingles of a bucket that several points hold, with each of the points and their number.

    The counts of a bucket are read first; its entries then pass through, however many a shingle has.
    Equal rows count anew each time, which can only show too few lonely shingles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, known, sums, held, size = None, [], None, None, [], 0

        def flush() -> pa.RecordBatch:
            h, k = (np.concatenate(x) for x in zip(*held))
            df = sums[np.searchsorted(known, h)]
            return _by_point(bits, k[df > 1], h[df > 1], np.minimum(df[df > 1], (1 << 32) - 1).astype(np.uint32))

        for batch in batches:
            for row, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h, v = np.frombuffer(batch.column(2)[row].as_buffer(), dtype=np.uint64), np.frombuffer(batch.column(3)[row].as_buffer(), dtype=np.int64)
                if bucket != now:
                    if held:
                        yield flush()
                    now, told, known, held, size = bucket, [], None, [], 0
                if not kind:
                    told.append((h, v))
                    continue
                if known is None:
                    hashes, counts = (np.concatenate(x) for x in zip(*told))
                    known, back = np.unique(hashes, return_inverse=True)
                    sums = np.bincount(back, weights=counts).astype(np.int64)
                held.append((h, v))
                size += len(h)
                if size >= BUCKET_ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def _sketch(own: np.ndarray) -> np.ndarray:
    """Parities of a set by hash: a power of two of bits, at least twice the set's size up to the most."""
    m = min(SKETCH_BITS, 1 << max(6, (2 * len(own) - 1).bit_length()))
    bits = (np.bincount(((own >> np.uint64(20)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point's shared shingles, the rarest first, equally rare ones by hash, with their number and sketch."""
    for k, h, df in _buckets(batches, np.int64, np.uint64, np.uint32):
        order = np.lexsort((h, df, k))
        k, h = k[order], h[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])))  # equal rows
        k, h = k[new], h[new]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
        for a in range(0, len(starts), 2_000):  # rows a batch
            some = np.append(starts[a : a + 2_000], starts[a + 2_000] if a + 2_000 < len(starts) else len(k))
            sketches = [_sketch(h[x:y]) for x, y in zip(some[:-1], some[1:])]
            lists = pa.ListArray.from_arrays((some - some[0]).astype(np.int32), pa.array(h[some[0] : some[-1]].view(np.int64)))
            folded = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sketches)], dtype=np.int32), pa.array(np.concatenate(sketches)))
            yield pa.RecordBatch.from_arrays([pa.array(k[some[:-1]], pa.int64()), pa.array(np.diff(some), pa.int64()), lists, folded], names=["key", "h", "s", "sk"])


def _dealt(entries: DataFrame, bits: int) -> DataFrame:
    return entries.repartition(1 << bits, "bucket").sortWithinPartitions(*[c for c in ("bucket", "kind") if c in entries.columns])


def _bits_for(entries: int) -> int:
    return min(31, max(0, (max(1, entries) // BUCKET_ENTRIES).bit_length()))


def linkable_points(rows: DataFrame, signs: DataFrame, percent: int, width: int) -> DataFrame:
    """key, n, h, s (shared shingles, rarest first) and sk of the points that may link."""
    classes = stored(signs.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("m").alias("m")), "classes")
    bits = _bits_for((classes.agg(F.sum("n")).first()[0] or 0) * FIRST_COUNT // 256)
    entries = _dealt(rows.select("doc_id", "text").mapInArrow(K.releasing(_entries(width, bits, True)), _ENTRIES), bits)
    held = _dealt(entries.mapInArrow(K.releasing(_held(bits)), "bucket long, keys binary, a binary"), bits).mapInArrow(K.releasing(_summed), "key long, held long")
    # A point has m shingles in this count; those that it does not hold beside others are lonely.
    lonely = F.col("m") - F.least(F.coalesce("held", F.lit(0)), F.col("m"))
    left = stored(classes.join(held, "key", "left").filter(100 * (F.col("n") - lonely) >= percent * F.col("n")).select("key", "rep", "n"), "left")
    size = left.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    # Rows without a doc_id cannot be looked up: all of them take part.
    wanted = sent_if_small(left.filter("rep is not null").select(F.col("rep").alias("doc_id"), F.col("key").alias("want")), size["rows"])
    chosen = rows.join(wanted, "doc_id").select("text", "want").unionByName(rows.filter("doc_id is null").select("text", F.lit(None).cast("long").alias("want")))
    bits = _bits_for(size["shingles"])
    entries = _dealt(chosen.mapInArrow(K.releasing(_entries(width, bits, False)), _ENTRIES), bits)
    whole = _dealt(entries.mapInArrow(K.releasing(_shared(bits)), "bucket long, keys binary, a binary, b binary"), bits).mapInArrow(K.releasing(_sets), "key long, h long, s array<long>, sk array<long>")
    return stored(whole.join(left.select("key", "n"), "key").filter(100 * F.col("h") >= percent * F.col("n")).select("key", "n", "h", "s", "sk"), "points")


def _bounded(percent: int) -> Column:
    """Whether a pair with n, h and sk of a and b may link: by the sizes, the lonely shingles and the sketches."""
    both = F.col("n_a") + F.col("n_b")
    most = F.least("h_a", "h_b")
    # The larger sketch folds to the size of the other; the sizes of sets that may link differ so little that once is enough.
    half = lambda v: f"cast(size(sk_{v}) / 2 as int)"
    fold = lambda v: f"zip_with(slice(sk_{v}, 1, {half(v)}), slice(sk_{v}, {half(v)} + 1, {half(v)}), (p, q) -> p ^ q)"
    flips = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    differ = F.expr(f"case when size(sk_a) = size(sk_b) then {flips('sk_a', 'sk_b')} when size(sk_a) = 2 * size(sk_b) then {flips(fold('a'), 'sk_b')} when 2 * size(sk_a) = size(sk_b) then {flips('sk_a', fold('b'))} else 0 end")
    lonely = both - F.col("h_a") - F.col("h_b")
    sizes = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    return sizes & (100 * most >= percent * (both - most)) & ((100 + percent) * (lonely + differ) <= (100 - percent) * both)


def _side(rows: DataFrame, v: str, id_: str = "key", extra: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(F.col(id_).alias(v), *(F.col(c).alias(f"{c}_{v}") for c in ("n", "h", "sk", *extra)))


def _linked(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs (a, b, ...), which are stored, that link, by their whole sets.

    Sets are most of what there is to move, so only those that a pair names leave their place while
    the pairs are few enough to go to every task.
    """
    left, right = (points.select(F.col("key").alias(v), F.col("s").alias(f"s_{v}"), F.col("n").alias(f"n_{v}")) for v in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    if pairs.count() <= BROADCAST_ROWS:
        both = left.join(F.broadcast(pairs), "a").join(right.join(F.broadcast(pairs.select("a", "b")), "b"), ["a", "b"])
    else:
        both = pairs.join(right, "b").join(left, "a")
    return both.filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select(*pairs.columns)


def _contracted(one: DataFrame, two: DataFrame, on: str, largest: int, close: Column, once: Column, points: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels that stand for all links of points of one (a, label_a, size, on, ...) with points of two (b, label_b, on, ...).

    Near copies have links in the square of their number, and one between two labels is enough.  So
    points meet about ``FIRST_MET`` of a cell's ``size`` points first, drawn by the hash of their keys.  Labels that
    link are one label in the next round, which takes ``FIRST_MET`` times as many, up to the
    last one, where all points meet.  Of a point that links to a share x of a cell, m drawn ones leave
    with (1 - x)**m, so the links that a round expects of a point and cell have a bound, whatever the cell's size.
    once: what the last round asks of a and b so that a pair meets once.
    """
    found, take = None, FIRST_MET
    while True:
        sides = [one, two]
        if found is not None:
            now = connected(found)
            named = now.count()
            for k, v in enumerate("ab"):
                renamed = sent_if_small(now.select(F.col("id").alias(f"label_{v}"), F.col("label").alias("_now")), named)
                sides[k] = sides[k].join(renamed, f"label_{v}", "left").withColumn(f"label_{v}", F.coalesce("_now", f"label_{v}")).drop("_now")
        last = take >= largest
        drawn = sides[0] if last else sides[0].filter(F.pmod(F.xxhash64("a"), F.lit(1 << 20)) * F.col("size") < take * (1 << 20))
        met = drawn.join(sides[1], on).filter((F.col("label_a") != F.col("label_b")) & close & (once if last else F.lit(True)))
        met = met.select(*(f(x + "a", x + "b").alias(x + v) for x in ("", "label_") for f, v in ((F.least, "a"), (F.greatest, "b")))).distinct()
        links = stored(_linked(stored(met, "met"), points, percent).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "label-links")
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        take *= FIRST_MET


def _measure(pivots: list[tuple[int, int, np.ndarray]], percent: int):
    """Each point's nearest pivot, and all pivots within 2 r, with the numbers of common shingles."""
    hashes = np.concatenate([s for _, _, s in pivots]).view(np.uint64)
    owner = np.repeat(np.arange(len(pivots)), [len(s) for _, _, s in pivots])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    known, starts, sizes = np.unique(hashes, return_index=True, return_counts=True)
    names, n_of = np.array([k for k, _, _ in pivots], dtype=np.int64), np.array([n for _, n, _ in pivots], dtype=np.int64)
    far = max(0, 2 * percent - 100)  # the least similarity, in percent, of points at distance 2 r

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy().view(np.uint64)
            n = batch.column(1).to_numpy()
            homes, near = [], []
            for k in range(len(n)):
                own = values[offsets[k] : offsets[k + 1]]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at = at[known[at] == own]
                size = sizes[at]
                hit = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(at) else np.zeros(0, dtype=np.int64)
                common = np.bincount(owner[hit], minlength=len(pivots))
                whole = n[k] + n_of - common
                # Ties of the distance go to the smallest key; pivots come by key.
                best = int(np.argmax(common / whole))
                close = np.flatnonzero((100 * common >= far * whole) & (common > 0))
                homes.append(int(names[best]) if 100 * common[best] >= percent * whole[best] else None)
                near.append([{"p": int(names[j]), "common": int(common[j]), "whole": int(whole[j])} for j in close])
            kind = pa.list_(pa.struct([("p", pa.int64()), ("common", pa.int64()), ("whole", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(homes, pa.int64()), pa.array(near, kind)], names=["key", "n", "h", "sk", "home", "near"])

    return measure


def _pivots(active: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """The active points with the smallest keys, which are as good as random: at most PIVOTS, and PIVOT_SHINGLES shingles."""
    heads, room = [], PIVOT_SHINGLES
    for r in active.filter(F.col("h") <= PIVOT_SHINGLES // 16).select("key", "h").orderBy("key").limit(PIVOTS).collect():
        room -= r["h"]
        if room >= 0:
            heads.append(r["key"])
    if not heads:
        return []
    rows = active.filter(F.col("key").isin(heads)).select("key", "n", "s").collect()
    return sorted((r["key"], r["n"], np.array(r["s"], dtype=np.int64)) for r in rows)


def _joined_pivots(linked: list[tuple[int, int]], pivots: list[int]) -> dict[int, int]:
    """The smallest pivot of each pivot's component, from pairs that one point links."""
    label = {p: p for p in pivots}
    for _ in pivots:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def voronoi_level(active: DataFrame, points: DataFrame, pivots: list[tuple[int, int, np.ndarray]], percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(links, the points outside all cells, how many points are in cells) of one level."""
    spark = points.sparkSession
    r = 1 - percent / 100 + 1e-9
    seen = stored(active.select("key", "n", "h", "sk", "s").mapInArrow(K.releasing(_measure(pivots, percent)), "key long, n long, h long, sk array<long>, home long, near array<struct<p:long,common:long,whole:long>>"), "measured")
    close = F.filter("near", lambda x: 100 * x["common"] >= percent * x["whole"])
    stars = seen.filter("home is not null").select("home", F.explode(F.transform(close, lambda x: x["p"])).alias("p")).filter("home <> p").distinct().collect()  # at most PIVOTS squared
    label = _joined_pivots([tuple(x) for x in stars], [k for k, _, _ in pivots])
    labels = spark.createDataFrame(sorted(label.items()), "home long, label long")
    known = seen.join(F.broadcast(labels), "home", "left").withColumn("label", F.coalesce("label", "key"))
    links = known.filter("home is not null and key <> label").select(F.col("key").alias("a"), F.col("label").alias("b"))
    regions = known.select("key", "n", "h", "sk", "home", "label", F.explode("near").alias("x")).select("key", "n", "h", "sk", "home", "label", F.col("x.p").alias("p"), (1 - F.col("x.common") / F.col("x.whole")).alias("d"))
    sizes = {h: n for h, n in seen.filter("home is not null").groupBy("home").count().collect()}  # at most PIVOTS
    counted = spark.createDataFrame(sorted(sizes.items()), "p long, size long")
    cells = _side(regions.filter("home = p"), "a", "key", ("label", "d", "p")).withColumnRenamed("p_a", "p").join(F.broadcast(counted), "p")
    around = _side(regions, "b", "key", ("label", "d", "p")).withColumnRenamed("p_b", "p")
    # A pair of points in two cells may meet in both regions.
    crossing = _contracted(cells, around, "p", max(sizes.values(), default=0), (F.abs(F.col("d_a") - F.col("d_b")) <= r) & _bounded(percent), F.lit(True), points, percent)
    rest = stored(active.join(seen.filter("home is null").select("key"), "key", "left_semi"), "active")
    return stored(links.unionByName(crossing), "level-links"), rest, sum(sizes.values())


def _last_level(active: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """All links between different components of the active points, or chains that stand for them."""
    needed = F.col("h") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    prefixes = active.select("key", F.explode(F.slice("s", F.lit(1), needed.cast("int"))).alias("g"))
    heads = prefixes.groupBy("g").agg(F.min("key").alias("pivot"), F.max("key").alias("top")).filter("pivot <> top").select("g", "pivot")
    regions = stored(prefixes.join(heads, "g"), "regions")
    facts = active.select("key", "n", "h", "sk")
    stars = regions.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    met = stars.join(_side(facts, "b"), "b").join(_side(facts, "a"), "a").filter(_bounded(percent)).select("a", "b")
    links = stored(_linked(stored(met, "stars"), points, percent), "star-links")
    labels = connected(links)
    known = stored(regions.select("g", "key").join(labels.select(F.col("id").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key")), "labelled")
    # A region whose points are one component is done.
    open_ = known.groupBy("g").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size")).filter("l <> h").select("g", "size")
    rest = stored(known.join(open_, "g").join(facts, "key"), "open-regions")
    one, two = _side(rest, "a", "key", ("label", "g", "size")).withColumnsRenamed({"g_a": "g", "size_a": "size"}), _side(rest, "b", "key", ("label", "g")).withColumnRenamed("g_b", "g")
    largest = rest.agg(F.max("size")).first()[0] or 0
    left = _contracted(one, two, "g", largest, _bounded(percent), F.col("a") < F.col("b"), points, percent)
    return labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(left)


def point_links(points: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between points whose components are those of all links."""
    active, found = points, []
    # Up to a similarity of one half, 2 r reaches all points, and regions would say nothing.
    while percent > 50 and (pivots := _pivots(active)):
        links, active, covered = voronoi_level(active, points, pivots, percent)
        found.append(links)
        if covered < MIN_CELL * len(pivots):
            break
    found.append(_last_level(active, points, percent))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of each document of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signs = stored(rows.select("doc_id", "text").mapInArrow(K.releasing(_signer(width)), _SIGNS), "signs")
    links = point_links(linkable_points(rows, signs, percent, width), percent)
    # Different sets under one doc_id belong to one document.
    several = signs.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("top")).filter("a <> top").select("doc_id", "a")
    same = signs.filter("n > 0").join(several, "doc_id").filter("a <> key").select("a", F.col("key").alias("b"))
    labels = connected(links.unionByName(same))
    classes = signs.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    labelled = stored(classes.join(labels.select(F.col("id").alias("key"), "label"), "key", "left").withColumn("linked", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "key")), "labelled-classes")
    heads = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    # A class of one row without links is its own component.
    own = stored(labelled.filter("linked or rows > 1").join(heads, "label").select("key", "component_id"), "components")
    out = signs.join(sent_if_small(own, own.count()), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    # Rows without a set, under a doc_id that has one elsewhere.
    blank = signs.filter("n = 0 and doc_id is not null").select("doc_id").distinct()
    other = stored(signs.filter("n > 0").select("doc_id", "key").join(blank, "doc_id", "left_semi").join(own, "key").groupBy(F.col("doc_id").alias("_blank_id")).agg(F.min("component_id").alias("_component")), "blank-rows")
    out = out.join(sent_if_small(other, other.count()), (F.col("n_shingles") == 0) & (F.col("doc_id") == F.col("_blank_id")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "component_id").alias("component_id"))


def keep_first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest doc_id of each component, with all columns of docs.

    Of rows with the same doc_id the first by text stays; rows without a doc_id stay.
    """
    found = stored(jaccard_components(docs, percent), "found")
    kept = without_ids(docs, found.filter("component_id <> doc_id"), "copies")
    again = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again_id")), "repeated-ids")
    many = again.count()
    if not many:
        return kept
    hit = kept["doc_id"] == F.col("_again_id")
    side = sent_if_small(again, many)
    order = F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")), F.xxhash64(*[F.col(c) for c, t in kept.dtypes if not t.startswith("map")]))
    firsts = kept.join(side, hit, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*kept.columns), order).alias("row")).select("row.*")
    return kept.join(side, hit, "left_anti").unionByName(firsts)
