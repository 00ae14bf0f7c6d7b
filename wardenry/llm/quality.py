"""Quality classification by ordinal cumulative-link regression on hashed words, characters and byte kinds of whole texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import held_out, nullable
from wardenry.session import broadcast_if_small

# Dimensions of the hashed text, of which the first are for byte kinds and ratios, and characters of an n-gram.
DIMENSIONS, KIND_DIMENSIONS, CHARS = 1 << 16, 1024, 3
# Weight of words and characters beside byte kinds, whose few places would drown in theirs.
TEXT_WEIGHT = 0.5
# Expected rated documents that are learned from, steps of the fit, and rows that one step looks at, in turn.
TRAIN_DOCS = 6000
STEPS = 400
STEP_ROWS = 1024
L2 = 1e-4
SLICE_CHARS = 1 << 18
# A document stays if its grade is at least this one with at least this probability.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _WIDE = range(6)


def _classes() -> np.ndarray:
    """Bytes by kind: lower case, upper case, digit, blank, line end, beyond ASCII; any other sign stands for itself."""
    out = np.zeros(256, dtype=np.int64)
    next_class = 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = _WIDE
        elif c.islower():
            out[b] = _LOWER
        elif c.isupper():
            out[b] = _UPPER
        elif c.isdigit():
            out[b] = _DIGIT
        elif c in "\n\r\v\f":
            out[b] = _LINE
        elif b <= 32 or b == 127:
            out[b] = _SPACE
        else:
            out[b] = next_class
            next_class += 1
    return out


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1


def _slot(name: str, level: float, dimensions: int, steps: int = 20) -> int:
    """The hashed place of a ratio, cut into ``steps`` parts."""
    import zlib

    return zlib.crc32(f"{name}:{int(min(max(level, 0.0), 1.0) * steps)}".encode()) % dimensions


# Letters, marks and digits make words; so does all beyond the first plane.
_WORD = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(1 << 16)])
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes spread over all bits."""
    h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _word_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each word, in order: a polynomial in its code points."""
    edges = np.flatnonzero(np.diff(_WORD[np.minimum(codes, (1 << 16) - 1)] | (codes >= 1 << 16), prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, np.uint64)
    powers, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(codes), base, np.uint64))) for base in (_BASE, _UNBASE))
    sums = np.add.reduceat(np.append((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], np.uint64(0)), edges)[::2]
    return _mixed(sums * inverse[edges[::2]], 1)


def features(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text, as places and values of a sparse vector of length 1.

    Single words, pairs of neighbour words and runs of ``CHARS`` characters, all in lower case; then, in the first places, runs of three
    byte kinds, and how far words repeat. The square roots of the shares, so that a long text weighs as much as a short one. Null and
    empty texts have no runs.
    """
    text = text or ""
    runs, grams, words, repeats, upper = np.zeros(KIND_DIMENSIONS), np.zeros(dimensions - KIND_DIMENSIONS), 0, 0, 0
    last = None
    # What the next slice needs of this one, so that nothing is lost between two.
    kinds, tail, word = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE_CHARS)
        while end < len(text) and not text[end].isspace():
            end += 1
        part = text[at:end]
        k = np.append(kinds, _CLASS[np.frombuffer(part.encode("utf-8"), np.uint8)])
        kinds = k[-2:]
        if len(k) > 2:
            code = (k[:-2] * _KINDS + k[1:-1]) * _KINDS + k[2:]
            runs += np.bincount((code * 2654435761 >> 7) % KIND_DIMENSIONS, minlength=KIND_DIMENSIONS)
        codes = np.frombuffer(part.lower().encode("utf-32-le"), np.uint32)
        single = _word_hashes(codes)
        pairs = np.append(word, single)
        c = np.append(tail, codes).astype(np.uint64)
        run = np.zeros(max(len(c) - CHARS + 1, 0), np.uint64)
        for n in range(CHARS if len(run) else 0):
            run = run * np.uint64(1 << 21) + c[n : len(c) - CHARS + 1 + n]
        hashes = np.concatenate([single, _mixed(pairs[:-1] * np.uint64(_BASE) + pairs[1:], 2), _mixed(run, 3)])
        grams += np.bincount((hashes % np.uint64(len(grams))).astype(np.int64), minlength=len(grams))
        tail, word = c[len(c) - min(len(c), CHARS - 1) :].astype(np.uint32), pairs[-1:]
        found = part.split()
        if found:
            words += len(found)
            repeats += sum(map(eq, found, found[1:])) + (found[0] == last)
            upper += sum(map(str.isupper, found))
            last = found[-1]
        at = end
    out = np.sqrt(runs / max(runs.sum(), 1.0))
    if words:
        out[_slot("repeat", repeats / words, KIND_DIMENSIONS)] += 0.5
        out[_slot("upper", upper / words, KIND_DIMENSIONS)] += 0.5
    else:
        out[_slot("none", 0, KIND_DIMENSIONS)] += 0.5
    of_kinds, of_text = np.flatnonzero(out), np.flatnonzero(grams)
    values = np.append(out[of_kinds], TEXT_WEIGHT * np.sqrt(grams[of_text] / max(grams.sum(), 1.0)))
    return np.append(of_kinds, of_text + KIND_DIMENSIONS), (values / np.sqrt((values**2).sum())).astype(np.float32)


@dataclass
class Sparse:
    """Rows of a sparse matrix, one after the other; no row is empty."""

    index: np.ndarray
    value: np.ndarray
    lengths: np.ndarray
    width: int

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        return cls(np.tile(np.arange(x.shape[1]), len(x)), x.ravel(), np.full(len(x), x.shape[1]), x.shape[1])

    def parts(self, rows: int) -> list[Sparse]:
        """The rows in parts of at most ``rows`` and about equal size."""
        cuts = np.linspace(0, len(self.lengths), -(-len(self.lengths) // rows) + 1).astype(int)
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        return [Sparse(self.index[ends[a] : ends[b]], self.value[ends[a] : ends[b]], self.lengths[a:b], self.width) for a, b in zip(cuts, cuts[1:])]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.index] * self.value, np.cumsum(self.lengths) - self.lengths)

    def turned_times(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, np.repeat(d, self.lengths) * self.value, self.width)


@dataclass
class CumulativeLink:
    """P(grade <= k) = sigmoid(thresholds[k] - weights x): one direction for all grades and ordered thresholds."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """For each row the probabilities that its grade is at least each grade but the lowest."""
        return self.above(x @ self.weights)

    def above(self, z: np.ndarray) -> np.ndarray:
        """The same of rows whose products with the weights are ``z``."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray | Sparse, ratings: np.ndarray, steps: int = STEPS, l2: float = L2) -> CumulativeLink:
    """Maximum likelihood by Adam; every grade weighs the same however rare it is.

    Steps go round over the parts of the sample, so rows in random order are expected.
    """
    x = x if isinstance(x, Sparse) else Sparse.of(x)
    grades, every = np.unique(ratings, return_inverse=True)
    levels = len(grades)
    if levels < 2:
        return CumulativeLink([int(g) for g in grades], np.zeros(x.width, np.float32), np.zeros(0))
    share = np.bincount(every) / len(every)
    parts = x.parts(STEP_ROWS)
    places = np.split(every, np.cumsum([len(part.lengths) for part in parts])[:-1])
    # Thresholds are the first one plus positive gaps, so they stay in order.
    p = np.concatenate([np.zeros(x.width), [0.0], np.zeros(levels - 2)])
    m, v, d = np.zeros_like(p), np.zeros_like(p), x.width
    for step in range(1, steps + 1):
        part, y = parts[step % len(parts)], places[step % len(parts)]
        weight = (1 / (levels * share))[y]
        gaps = np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = part.times(p[:d])
        cdf = _sigmoid(theta[None, :] - z[:, None])
        edges = np.concatenate([np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))], axis=1)
        rows = np.arange(len(y))
        high, low = edges[rows, y + 1], edges[rows, y]
        chance = np.maximum(high - low, 1e-9)
        # Slopes of the log-likelihood in the upper and the lower threshold of each row's grade.
        up, down = weight * high * (1 - high) / chance, weight * low * (1 - low) / chance
        by_theta = np.zeros(levels + 1)
        np.add.at(by_theta, y + 1, up)
        np.add.at(by_theta, y, -down)
        by_theta = by_theta[1:-1]
        slope = np.concatenate([part.turned_times(down - up), [by_theta.sum()], np.array([by_theta[i + 1 :].sum() * g for i, g in enumerate(gaps)])]) / len(y)
        slope[:d] -= l2 * p[:d]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return CumulativeLink([int(g) for g in grades], p[:d].astype(np.float32), p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """The grade of a rating: 0 bad, 1 good but toxic, 2 good. Null where the quality is not rated."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality.isNotNull(), 2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, dimensions: int = DIMENSIONS) -> CumulativeLink | None:
    """Learn from ratings (id, grade) of documents that are not held out: about ``train_docs`` of them, chosen by hash.

    Features of the sample alone reach the driver. Ratings without a document, and null grades, are left out. None if none is left.
    """
    rated = ratings.where(F.col("grade").isNotNull() & ~held_out(F.col("id")))
    total = rated.count()
    if not total:
        return None
    drawn = rated.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(train_docs * float(1 << 20) / total)).select(F.col("id").alias("__rated"), "grade")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(broadcast_if_small(drawn), F.col("__id") == F.col("__rated")).select(F.col("grade").cast("long"), "text")

    place = np.uint16 if dimensions <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), dimensions) for t in batch.column(1)]
            index, value = [i.astype(place).tobytes() for i, _ in x], [v.astype(np.float16).tobytes() for _, v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["grade", "i", "v"])

    sample = rows.mapInArrow(run, "grade long, i binary, v binary").toArrow()
    if not sample.num_rows:
        return None
    # One random order, whatever order the rows arrived in.
    index, value, grades = (sample[c].to_pylist() for c in ("i", "v", "grade"))
    order = np.random.default_rng(0).permutation(sorted(range(len(grades)), key=lambda n: (index[n], value[n], grades[n])))
    x = Sparse(np.frombuffer(b"".join(index[n] for n in order), place), np.frombuffer(b"".join(value[n] for n in order), np.float16), np.array([len(value[n]) // 2 for n in order]), dimensions)
    return fit(x, np.array(grades)[order])


def _graded(model: CumulativeLink | None, texts: pa.Array, dimensions: int, keep_grade: int, keep_probability: float) -> list[pa.Array]:
    """Expected grade, tail probability and whether to keep, of a batch of texts."""
    if model is None or len(model.grades) < 2:
        only = float(model.grades[0]) if model else None
        return [pa.array([only] * len(texts), pa.float64()), pa.array([None] * len(texts), pa.float64()), pa.array([True] * len(texts), pa.bool_())]
    found = (features(t.as_py(), dimensions) for t in texts)
    above = model.above(np.array([model.weights[i] @ v for i, v in found], np.float64))
    place = [j for j, g in enumerate(model.grades[1:]) if g >= keep_grade]
    tail = above[:, place[0]] if place and model.grades[0] < keep_grade else np.full(len(above), float(model.grades[0] >= keep_grade))
    return [pa.array(model.grades[0] + above @ np.diff(np.array(model.grades, dtype=np.float64))), pa.array(tail), pa.array(tail >= keep_probability)]


def grade_documents(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """(``id_col``, ``expected_grade``, ``tail_probability``, ``kept``) of every row, judged where it is read.

    ``tail_probability`` is the chance of ``keep_grade`` or better. Null and empty texts are graded as texts without words. Without a
    model everything is kept, with null grades.
    """
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    schema = nullable(rows.select(id_col, F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability"), F.lit(True).alias("kept")).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_graded(shared.value, batch.column(1), dimensions, keep_grade, keep_probability)], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: CumulativeLink | None, text_col: str = "text", dimensions: int = DIMENSIONS, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of ``docs`` that ``grade_documents`` keeps, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_graded(shared.value, batch.column(place), dimensions, keep_grade, keep_probability)[2])

    return docs.mapInArrow(run, docs.schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(id, grade) of labels (doc_id, quality, toxic)."""
    return labels.select(F.col("doc_id").alias("id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn grades from ``labels`` (doc_id, quality, toxic) and grade all of ``docs``.

    Returns ``id_col``, ``held_out``, ``expected_grade`` (0 bad to 2 good), ``tail_probability`` (grade 1 or better) and ``kept``.
    Labels train the model and never decide on their own documents. Repeated rows are graded alike; an empty table gives no rows.
    """
    graded = grade_documents(docs, train(docs, ratings_of(labels), id_col, text_col, train_docs), id_col, text_col)
    return graded.select(id_col, held_out(F.col(id_col)).alias("held_out"), "expected_grade", "tail_probability", "kept")
