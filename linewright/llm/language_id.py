"""Language identification by a hierarchy of linear support vector machines.

Features are hashed byte trigrams of the lower-cased text with everything but letters as
space, as shares of the text's trigrams.  One-versus-one machines
choose the language family; others, one for each pair of languages of a
family, then separate its languages.  Each score is a mean of weights over the
text, so a text of any length is read once and whole.

Training reads about ``PER_LANGUAGE`` labelled documents of each language, at any size of the table,
and ``MAX_DOCUMENTS`` of all, chosen by a hash of doc_id; each also trains as a short excerpt, so that
short texts are in the training data.  Executors count their trigrams; at most ``BUCKETS`` counts a document reach
the driver, however long its text.

Defined results: an empty table gives no rows; null texts and texts without a letter are ``und`` with score
0; without any labelled document every text is ``und``; with one language every text with a
letter has that; other columns are ignored; repeated rows get the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

BUCKETS = 1 << 14
PER_LANGUAGE = 500
MAX_DOCUMENTS = 1_500
EXCERPT_BYTES = 60

# Language families by ISO 639-1 code; other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk ky uz tk".split(),
    "indo-aryan": "hi bn ur pa gu mr ne".split(),
    "semitic": "ar he mt am".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[0xC3] = 0xC3
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams, one per byte with a space before and after each text, and their offsets.

    Trigram i is centred on byte i; neighbours outside its text count as space.
    """
    b = _FOLD[data]
    left, right = np.empty_like(b), np.empty_like(b)
    if len(b):
        left[1:], right[:-1] = b[:-1], b[1:]
        some = offsets[:-1][offsets[1:] > offsets[:-1]]
        left[some] = 32
        right[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = 32
    h = (left * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int32), offsets


@dataclass(frozen=True)
class Machine:
    """Positive scores speak for ``yes``."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Hierarchy:
    families: tuple[str, ...]
    by_family: dict
    family_machines: tuple[Machine, ...]
    language_machines: dict


def _machine(x: np.ndarray, at: np.ndarray, y: np.ndarray, yes: str, no: str, epochs: int = 12, c: float = 1.0) -> Machine:
    """A linear SVM (hinge loss) on the rows ``at`` of x by dual coordinate descent, with classes weighted to balance; the last column of x is 1."""
    q = np.array([float(x[i] @ x[i]) for i in at])
    top = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], dtype=np.float32)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            row, old = x[at[k]], alpha[k]
            alpha[k] = min(max(old - (y[k] * float(w @ row) - 1) / q[k], 0.0), top[k])
            if alpha[k] != old:
                w += np.float32((alpha[k] - old) * y[k]) * row
    return Machine(yes, no, w[:-1].copy(), float(w[-1]))


_SCALE = 20.0


def _parts(text: str) -> list[bytes]:
    """What a text trains as: itself, and an excerpt if it is long enough."""
    b = text.encode()
    middle = len(b) // 2
    return [b, b[middle : middle + EXCERPT_BYTES]] if len(b) > 2 * EXCERPT_BYTES else [b]


def _counted(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of trigrams and their counts."""
    idx, _ = trigrams(np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]))
    return np.unique(idx, return_counts=True)


def train(texts: list[str], langs: list[str]) -> Hierarchy:
    return _trained([(lang, *_counted(p)) for t, lang in zip(texts, langs) for p in _parts(t)])


def _trained(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Hierarchy:
    """From (language, buckets, counts)."""
    names = [lang for lang, _, _ in rows]
    x = np.zeros((len(rows), BUCKETS + 1), dtype=np.float32)
    x[:, -1] = 1
    for k, (_, buckets, counts) in enumerate(rows):
        if len(buckets):
            x[k, buckets] = counts * (_SCALE / counts.sum())
    names = np.array(names)
    langs_ = sorted(set(names.tolist()))
    by_family = {f: tuple(sorted(n for n in langs_ if family_of(n) == f)) for f in sorted({family_of(n) for n in langs_})}
    own = np.array([family_of(n) for n in names])

    def pairs(values: np.ndarray, classes: tuple[str, ...]) -> tuple[Machine, ...]:
        out = []
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                at = np.flatnonzero((values == a) | (values == b))
                out.append(_machine(x, at, np.where(values[at] == a, 1.0, -1.0), a, b))
        return tuple(out)

    return Hierarchy(tuple(by_family), by_family, pairs(own, tuple(by_family)), {f: pairs(names, ls) for f, ls in by_family.items()})


def _vote(classes: tuple[str, ...], machines: tuple[Machine, ...], scores: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the class that wins most duels (ties by the sum of its margins), and its least margin."""
    wins, total, least = (np.zeros((len(classes), n)) for _ in range(3))
    least += 8.0
    at = {c: k for k, c in enumerate(classes)}
    for m, s in zip(machines, scores):
        for name, own in ((m.yes, s), (m.no, -s)):
            k = at[name]
            wins[k] += own > 0
            total[k] += np.tanh(own)
            least[k] = np.minimum(least[k], own)
    best = np.argmax(wins + total / (4 * len(classes) + 4), axis=0)
    return best, least[best, np.arange(n)]


def predictor(model: Hierarchy):
    machines = [*model.family_machines, *(m for f in model.families for m in model.language_machines[f])]

    def scores_of(idx: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        sizes = np.maximum(np.diff(offsets), 1)
        out = []
        for m in machines:
            sums = np.zeros(len(idx) + 1)
            np.cumsum(m.weights[idx], out=sums[1:], dtype=np.float64)
            out.append((sums[offsets[1:]] - sums[offsets[:-1]]) * (_SCALE / sizes) + m.bias)
        return out

    def predict(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        letters = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_ASCII_LETTER[data], out=letters[1:])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for k in np.flatnonzero(~has):
            has[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
        scores = scores_of(*trigrams(data, offsets))
        first = len(model.family_machines)
        family, margin = _vote(model.families, model.family_machines, scores[:first], n)
        names = np.empty(n, dtype=object)
        for k, f in enumerate(model.families):
            own = model.language_machines[f]
            best, near = _vote(model.by_family[f], own, scores[first : first + len(own)], n)
            first += len(own)
            names = np.where(family == k, np.array(model.by_family[f], dtype=object)[best], names)
            margin = np.where(family == k, np.minimum(margin, near), margin)
        prob = 1 / (1 + np.exp(-2 * np.clip(margin, -8, 8)))
        return [x if h else "und" for x, h in zip(names.tolist(), has.tolist())], np.where(has, prob, 0.0)

    return predict


def _apply(model: Hierarchy | None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(model) if model else lambda data, offsets: (["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1))
        for batch in batches:
            for first, end, data, offsets in K.chunks(batch, "text"):
                names, prob = predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(names, pa.string()), pa.array(prob, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return apply


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy | None:
    """Trains on a bounded sample of labelled documents that are not held out."""
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return None
    per_language = max(1, min(per_language, MAX_DOCUMENTS // len(counts)))
    share = F.lit(0).cast("long")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min((1 << 63) - 1, math.ceil((1 << 63) * min(1.0, per_language / n))))).otherwise(share)
    # One text a doc_id, so that an id that repeats counts once.
    chosen = labelled.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < share).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    rows = chosen.mapInArrow(K.releasing(_featured), "doc_id long, lang string, part int, buckets array<int>, counts array<long>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["part"], r["buckets"], r["counts"]))
    return _trained([(r["lang"], np.array(r["buckets"], dtype=np.int64), np.array(r["counts"], dtype=np.int64)) for r in rows]) if rows else None


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            for k, part in enumerate(_parts(text.as_py())):
                for column, value in zip(out, (doc, lang, k, *_counted(part))):
                    column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "lang", "part", "buckets", "counts"])


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.releasing(_apply(model)), "doc_id long, lang_pred string, score double")
