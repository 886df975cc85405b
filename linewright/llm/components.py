"""Connected components of a graph that lives in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import BROADCAST_ROWS, stored

#: Edges that one task labels by itself, some 16 MB.
FEW_EDGES = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all edges, sorted, and the smallest end of the component of each."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[u], label[v])
        hooked = label.copy()
        np.minimum.at(hooked, label[u], least)
        np.minimum.at(hooked, label[v], least)
        while not np.array_equal(hooked, up := hooked[hooked]):
            hooked = up
        if np.array_equal(hooked, label):
            return ids, ids[label]
        label = hooked


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if edges:
        ids, label = least_labels(*map(np.concatenate, zip(*edges)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int64())], names=["id", "label"])


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of every end of links (a, b); label is the smallest id that its component holds.

    Up to ``FEW_EDGES`` edges are labelled by one task.  More of them take rounds of large-star and
    small-star contraction until no edge changes, of which there is a logarithmic number.  Hubs are summed before the
    shuffle.  What a node's neighbours sum to goes to every task while there are few edges, so that
    a hub's edges need not meet in one; beyond that the joins back to the edges can be split where a hub is hot.
    """
    edges = stored(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u <> v"), "edges")
    if edges.count() <= FEW_EDGES:
        return stored(edges.repartition(1).mapInArrow(K.releasing(_labelled), "id long, label long"), "labels")
    edges = stored(edges.distinct(), "edges")
    count, mark = edges.count(), None
    while True:
        # One row a node, of which there are at most two an edge.
        side = F.broadcast if 2 * count <= BROADCAST_ROWS else (lambda rows: rows)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(down), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stored(small, "edges")
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        count, mark = new[0], new
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(heads)
