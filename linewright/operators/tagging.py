"""Tags of the characters of lines by a scorer: vocabulary, padding, scores, labels.

A scorer is any callable from padded ids and a mask (two integer arrays, lines by places) to
scores (lines by places by labels).  ``LinearTagger`` is one in numpy whose weights come from a
file; a service is another.  Workers load what a scorer needs once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a line at most, the two ends among them, and lines that are scored together.
MOST, BATCH = 512, 16


def encoded(line: str, vocabulary: dict[str, int], most: int = MOST) -> tuple[list[int], list[int]]:
    """(ids with both ends, the character that each inner place stands for); characters that the vocabulary lacks are left out."""
    places = [k for k, ch in enumerate(line) if ch in vocabulary][: most - 2]
    return [vocabulary["[CLS]"], *(vocabulary[line[k]] for k in places), vocabulary["[SEP]"]], places


def padded(rows: Sequence[Sequence[int]], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids as one array as wide as the longest, and where it holds ids."""
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad, dtype=np.int64), np.zeros((len(rows), width), dtype=np.int64)
    for k, r in enumerate(rows):
        ids[k, : len(r)], mask[k, : len(r)] = r, 1
    return ids, mask


def best_labels(scores: np.ndarray, labels: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the likeliest label, its softmax) of each place; the first of equal ones."""
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    best = scores.argmax(axis=-1)
    return np.array(labels, dtype=object)[best], np.take_along_axis(e, best[..., None], -1)[..., 0] / e.sum(axis=-1)


@dataclass(frozen=True)
class LinearTagger:
    """Scores by the character and its two neighbours: a stand-in with a real model's shape.

    The file is JSON: vocabulary (character to id), labels, and weights by place (-1, 0, 1) of ids by labels.
    """

    path: str

    @functools.cached_property
    def parts(self) -> tuple[dict[str, int], list[str], np.ndarray]:
        try:
            raw = json.load(open(self.path))
        except FileNotFoundError:
            raw = json.load(open(SparkFiles.get(self.path.rpartition("/")[2])))
        return raw["vocabulary"], raw["labels"], np.array(raw["weights"], dtype=np.float64)

    @property
    def vocabulary(self) -> dict[str, int]:
        return self.parts[0]

    @property
    def labels(self) -> list[str]:
        return self.parts[1]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        weights = self.parts[2]
        own = np.where(mask > 0, ids, 0)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[:, 1:], after[:, :-1] = own[:, :-1], own[:, 1:]
        return weights[0][before] + weights[1][own] + weights[2][after]


def load_tagger(spark, path: str) -> LinearTagger:
    """Sends a tagger's file to the workers; each reads it once."""
    spark.sparkContext.addFile(path)
    return _tagger(path)


@functools.cache
def _tagger(path: str) -> LinearTagger:
    return LinearTagger(path)


def tagged(lines: Sequence[str], scorer, batch: int = BATCH) -> list[list[tuple[int, str, str, float, int, int]]]:
    """(place, character, label, score, start, end) of the known characters of each line; a single line and many give the same."""
    out = []
    for k in range(0, len(lines), batch):
        some = [encoded(x, scorer.vocabulary) for x in lines[k : k + batch]]
        ids, mask = padded([i for i, _ in some])
        labels, score = best_labels(scorer(ids, mask), scorer.labels)
        for row, (line, (_, places)) in enumerate(zip(lines[k : k + batch], some)):
            out.append([(n, line[at], labels[row, n + 1], float(score[row, n + 1]), at, at + 1) for n, at in enumerate(places)])
    return out


def tag_lines(lines: DataFrame, scorer: Callable, key: str = "doc_id") -> DataFrame:
    """key, line_no, pos, token, label, score, start and end: one Arrow pass, no shuffle."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string()), ("label", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [f.name for f in kind.value_type]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tagged([x or "" for x in batch.column(2).to_pylist()], scorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[dict(zip(names, t)) for t in row] for row in found], kind)], names=[key, "line_no", "t"])

    rows = lines.select(key, "line_no", "line")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, line_no {rows.schema['line_no'].dataType.simpleString()}, t array<struct<pos:int,token:string,label:string,score:double,start:int,end:int>>"
    return rows.mapInArrow(tag, schema).select(key, "line_no", F.explode("t").alias("t")).select(key, "line_no", "t.*")
