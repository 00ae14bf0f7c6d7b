"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import held_out, nullable
from wardenry.session import broadcast_if_small

# Labelled documents of each class that are learned from (expected), and characters of each: of a longer text some sentences.
TRAIN_DOCS = 1200
TRAIN_CHARS = 20_000
# Landmarks of each class; rounds of choosing witnesses and hard negatives.
LANDMARKS = 192
ROUNDS = 3
# Directions of the landmarks' kernel below this share of the largest are noise.
SPECTRUM = 2e-3
# Price of a class's margin errors against the machine's flatness.
COST = 300.0
# Subsequences of three characters with at most two others between them, and of four with at most one; each of these costs this factor.
DECAY = 0.6
GAPS = ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1), (1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1))
HASH_BITS = 20
# Distinct words a worker remembers, and text that is scored at a time.
REMEMBERED = 400_000
SLICE_CHARS = 1 << 20
# Words whose subsequences are in memory at a time; random and hardest clean words that a round adds.
BLOCK = 4096
RANDOM_WORDS, HARD_WORDS = 12_000, 4000
# Times that a clean word with a telling run weighs among clean words.
ALIKE = 30.0
# A word is a witness from the start if it has a run of characters that this share of toxic texts has, so many times the share of
# clean texts: in one word, or in several different ones, as clean texts hold a rare run once by chance.
RUNS, REPEATS, RUN_BITS = (4, 5, 6), (1, 2, 3), 22
WITNESS_SHARE, WITNESS_RATIO = 0.01, 20
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_SPACED = re.compile(r"(?:(?<=\s)|(?<=^))(?:\S[ \t]){3,}\S(?=\s|$)")
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalpha())
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, without ASCII signs and digits inside or around them (``i*d-i0ot`` is a word).

    Letters that stand alone in a row (``i d i o t``) count as one word as well.
    """
    text = (text or "").lower().encode("utf-8").translate(None, _SIGNS).decode("utf-8")
    out = set(text.split())
    for run in _SPACED.findall(text):
        out.add("".join(run.split()))
    return out


def sentences_of(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of gapped subsequences in words: (word, hashed subsequence, weight). A word is framed by one blank on each side."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer(("".join(f" {w} " for w in words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    at, keys, weights = [], [], []
    for steps in GAPS:
        span = sum(steps)
        n = len(codes) - span
        if n <= 0:
            continue
        inside = np.flatnonzero(owner[:n] == owner[span:])
        key, place = codes[inside] * _FACTORS[0], inside
        for step, factor in zip(steps, _FACTORS[1:]):
            place = place + step
            key = key + codes[place] * factor
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at.append(owner[inside])
        keys.append((key >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        weights.append(np.full(len(inside), DECAY ** (span - len(steps))))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(at), np.concatenate(keys), np.concatenate(weights)


@dataclass
class Machine:
    """The support vector machine as a sum over subsequences: ``table`` holds what each adds to a word's margin.

    A word's margin is ``sum_j beta_j k(word, landmark_j) + bias`` for the kernel of normalised words; as the kernel is an inner
    product over subsequences, the landmarks are summed once into ``table``. ``slope`` and ``shift`` make a document's probability.
    """

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for first in range(0, len(words), BLOCK):
            part = words[first : first + BLOCK]
            at, keys, weights = subsequences(part)
            norm = np.sqrt(np.bincount(at, weights**2, len(part)))
            out[first : first + len(part)] = np.bincount(at, weights * self.table[keys], len(part)) / np.maximum(norm, 1e-12)
        return out + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words (rows) and landmarks (columns)."""
    at, keys, weights = subsequences(landmarks)
    used, back = np.unique(keys, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)))
    np.add.at(dense, (back, at), weights)
    dense /= np.maximum(np.sqrt(np.bincount(at, weights**2, len(landmarks))), 1e-12)[None, :]
    out = np.zeros((len(words), len(landmarks)))
    for first in range(0, len(words), BLOCK // 16):
        part = words[first : first + BLOCK // 16]
        at, keys, weights = subsequences(part)
        norm = np.maximum(np.sqrt(np.bincount(at, weights**2, len(part))), 1e-12)
        place = np.minimum(np.searchsorted(used, keys), len(used) - 1)
        hit = np.flatnonzero(used[place] == keys)
        if not len(hit):
            continue
        hit = hit[np.argsort(at[hit], kind="stable")]
        rows, starts = np.unique(at[hit], return_index=True)
        sums = np.add.reduceat(dense[place[hit]] * weights[hit, None], starts, axis=0)
        out[first + rows] = sums / norm[rows, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 25) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge support vector machine, by Newton steps over the rows within the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    inside = np.ones(len(x), bool)
    for _ in range(steps):
        xi, wi = x[inside], c * weight[inside]
        w = np.linalg.solve(ridge + xi.T @ (xi * wi[:, None]), xi.T @ (wi * y[inside]))
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def learn(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine | None:
    """Train on labelled texts, cut into sentences: a toxic text has some toxic sentence, a clean one has none.

    Witnesses are words in sentences of toxic texts: at first those with a run of characters that is far more common there
    than in clean texts, then also the most toxic word of every other text; in each round they stand against words of clean sentences, hardest ones included. Landmarks are
    drawn from both. The document's probability is fitted to its highest margin over all sentences.
    """
    pool: dict[str, str] = {}
    # A word of many texts is in memory once.
    bag_of = lambda text: sorted(pool.setdefault(w, w) for w in set().union(*map(words_of, sentences_of(text))))
    bags, clean_bags = [bag_of(t) for t in toxic], [bag_of(t) for t in clean]
    bags = [b for b in bags if b]
    if not bags or not any(clean_bags):
        return None
    against = Counter(w for b in clean_bags for w in b)
    every = sorted(set().union(*bags))
    # In how many texts at least k different words have a run, for each run and k.
    seen, among = _run_counts(bags), _run_counts(clean_bags)
    common = max(3, WITNESS_SHARE * len(bags))
    telling = ((seen >= common) & (seen / len(bags) >= WITNESS_RATIO * (among + 0.1) / max(len(clean_bags), 1))).any(axis=0)
    ratio = seen[0] / (among[0] + 1)
    witnesses = Counter(w for b in bags for w, tells in zip(b, _best_run(b, telling)) if tells)
    often = Counter(w for b in bags for w in b)
    witnesses = Counter({w: n for w, n in witnesses.items() if often[w] / len(bags) >= WITNESS_RATIO * against[w] / max(len(clean_bags), 1)})
    if not witnesses:
        witnesses = Counter(max(zip(_best_run(b, ratio), b))[1] for b in bags)
    negatives = sorted(against)
    alike = {w for w, tells in zip(negatives, _best_run(negatives, telling)) if tells}
    rng = np.random.default_rng(0)
    hard = sorted(alike | {negatives[i] for i in rng.choice(len(negatives), min(len(negatives), RANDOM_WORDS), replace=False)})
    machine, best, low = None, {}, {}
    chosen: list[str] = []
    for step in range(rounds):
        positives = sorted(witnesses, key=lambda w: (-witnesses[w], w))
        if step < 2:  # then the landmarks stay, and the machine settles on them
            chosen = sorted({*chosen, *positives[:landmarks], *hard[-landmarks:]})
        gram = _kernel(chosen, chosen)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        kept = values > SPECTRUM * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(hard))])
        weight = np.concatenate([np.sqrt([witnesses[w] for w in positives]), np.array([against[w] for w in hard], dtype=float) ** 0.75])
        # Clean words that look like witnesses tell how far such a look can be trusted.
        weight[len(positives) :] *= [ALIKE if w in alike else 1.0 for w in hard]
        weight[: len(positives)] /= weight[: len(positives)].sum()
        weight[len(positives) :] /= weight[len(positives) :].sum()
        w = _svm(_kernel(positives + hard, chosen) @ root, y, weight, c=COST)
        beta = root @ w[:-1]
        at, keys, weights = subsequences(chosen)
        norm = np.maximum(np.sqrt(np.bincount(at, weights**2, len(chosen))), 1e-12)
        table = np.bincount(keys, weights * (beta / norm)[at], 1 << HASH_BITS)
        machine = Machine(table.astype(np.float32), float(w[-1]))
        low = dict(zip(negatives, machine.margins(negatives).tolist()))
        worst = sorted(negatives, key=lambda w: (low[w], w))[-HARD_WORDS:]
        hard = sorted((set(hard) | alike) - set(worst)) + worst
        best = dict(zip(every, machine.margins(every).tolist()))
        found = [max(b, key=lambda w: (best[w], w)) for b in bags if witnesses.keys().isdisjoint(b)]
        witnesses.update(w for w in found if best[w] > 0 and not against[w])
    top = [max(best[w] for w in b) for b in bags]
    bottom = [max(low[w] for w in b) for b in clean_bags if b]
    machine.slope, machine.shift = _platt(np.array(top), np.array(bottom))
    return machine


def _runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed run) of every run of RUNS characters in words that blanks frame, each once a word."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer(("".join(f" {w} " for w in words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found = [np.zeros(0, np.int64)]
    for size in RUNS:
        n = len(codes) - size + 1
        if n > 0:
            inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
            key = np.full(len(inside), size, np.uint64)
            for step in range(size):
                key = key * _FACTORS[0] + codes[inside + step]
            key = (key ^ (key >> np.uint64(29))) * _FACTORS[1]
            found.append((owner[inside] << RUN_BITS) | (key >> np.uint64(64 - RUN_BITS)).astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> RUN_BITS, pairs & ((1 << RUN_BITS) - 1)


def _run_counts(bags: list[list[str]]) -> np.ndarray:
    """For each k of REPEATS and each run, in how many texts at least k different words have it: tables of one size for any number of runs."""
    out = np.zeros((len(REPEATS), 1 << RUN_BITS), np.int32)
    for bag in bags:
        runs, n = np.unique(_runs(bag)[1], return_counts=True)
        for row, k in enumerate(REPEATS):
            out[row, runs[n >= k]] += 1
    return out


def _best_run(words: list[str], value: np.ndarray) -> list[float]:
    """The highest value among each word's runs."""
    out = np.zeros(len(words), value.dtype)
    for first in range(0, len(words), BLOCK):
        owner, runs = _runs(words[first : first + BLOCK])
        np.maximum.at(out, first + owner, value[runs])
    return out.tolist()


def _platt(high: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins of toxic and clean texts."""
    x, y = np.concatenate([high, low]), np.concatenate([np.ones(len(high)), np.zeros(len(low))])
    p = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        slope = design.T @ (q - y) / len(x) + np.array([1e-3 * p[0], 0])
        bend = design.T @ (design * (q * (1 - q))[:, None]) / len(x) + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(bend, slope)
        p = p - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Machine | None:
    """Learn from labels (doc_id, toxic) of documents that are not held out: an expected ``train_docs`` of either class, by hash.

    Texts of the sample reach the driver, about ``train_chars`` characters each at most: of a longer one as many of its sentences.
    Null labels and null texts are left out.
    """
    rated = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__rated"), (F.col("toxic") == 1).alias("toxic"))
    sizes = {r["toxic"]: r["rows"] for r in rated.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic"), train_docs / sizes[True]).otherwise(2 * train_docs / sizes[False])
    drawn = rated.where(F.pmod(F.xxhash64("__rated"), F.lit(1 << 20)) < share * float(1 << 20))
    # The draw is small at any size of the corpus: broadcast after a count, so that no text is shuffled to find its label.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(broadcast_if_small(drawn), F.col("__id") == F.col("__rated"))
    # Of a long text that was drawn, sentences are drawn by a hash of place and content; one as long as all that is drawn is cut.
    sentences = F.split(F.col("text"), r"(?<=[.!?])\s+|\n+")
    part = F.lit(train_chars * float(1 << 20)) / F.length("text")
    some = F.left(F.concat_ws("\n", F.filter(sentences, lambda x, i: F.pmod(F.xxhash64(x, i), F.lit(1 << 20)) < part)), F.lit(2 * train_chars))
    rows = rows.where(F.col("text").isNotNull()).select("toxic", F.when(F.length("text") <= train_chars, F.col("text")).otherwise(some).alias("text"))
    sample = sorted((r["toxic"], r["text"]) for r in rows.collect())
    return learn([t for toxic, t in sample if toxic], [t for toxic, t in sample if not toxic])


class _Scorer:
    """Margins of words, remembered: words repeat, so most are looked up."""

    def __init__(self, machine: Machine):
        self.machine, self.known, self.old = machine, {}, {}

    def top(self, text: str) -> float:
        """The highest margin of a text's words; texts are read in slices that end between words."""
        best, at = -np.inf, 0
        while at < len(text):
            end = min(len(text), at + SLICE_CHARS)
            while end < len(text) and not text[end].isspace():
                end += 1
            words = words_of(text[at:end])
            self._meet(words)
            best = max(best, max(map(self.known.__getitem__, words), default=-np.inf))
            at = end
        return best

    def _meet(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.old, self.known = self.known, {}
        new = []
        for w in words:
            if w in self.known:
                continue
            margin = self.old.get(w)
            if margin is None:
                new.append(w)
            else:
                self.known[w] = margin
        self.known.update(zip(new, self.machine.margins(new).tolist()))


def score_documents(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``score``, ``predicted``) of every row: the probability for the highest margin over the whole text.

    Null and empty texts, and all texts without a trained machine, score 0. Rows are scored where they are read.
    """
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    schema = nullable(rows.select(id_col, F.lit(0.0).alias("score")).schema)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        scorer = _Scorer(machine) if machine is not None else None
        for batch in batches:
            scores = []
            for text in batch.column(1):
                margin = scorer.top(text.as_py() or "") if scorer else -np.inf
                scores.append(machine.probability(margin) if margin > -np.inf else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from ``labels`` and score all of ``docs``: (``id_col``, ``held_out``, ``score``, ``predicted``). Repeated rows score alike."""
    found = score_documents(docs, train(docs, labels, id_col, text_col, train_docs), id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
