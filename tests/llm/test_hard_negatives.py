from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from wardenry.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    held = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, [math.floor(256 * x) for x in vector], label))
    out = Counter()
    for i, (anchor, v, label) in enumerate(held):
        if anchor is None or anchor % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), vid is None, vid or 0, j, lab) for j, (vid, w, lab) in enumerate(held) if j != i and len(w) == len(v)))
        for less, none, pid, _, lab in [s for s in scored if s[4] == label][:5]:
            fits = [s for s in scored if s[4] != label and 50 * -less <= 100 * -s[0] <= 95 * -less][:3]
            for rank, s in enumerate(fits):
                out[(anchor, None if none else pid, rank + 1, None if s[1] else s[2], -less, -s[0])] += 1
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, **options).select(COLUMNS).collect())


def vectors(seed, n=400, size=8, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        out.append((i, [round(c * 0.6 + rng.gauss(0, 0.5), 2) for c in centres[label]], label))
    return out


@pytest.mark.parametrize("chunk", [256, 3])
def test_negatives_equal_brute_force(spark, monkeypatch, chunk):
    """Blocks far smaller than a label, so that slots meet only when blocks are merged."""
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = vectors(chunk)
    want = plain(rows)
    assert mined(spark, rows, block=chunk) == want and len(want) > 20
    assert mined(spark, rows) == want


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.6, 0.1], i % 3) for i in range(120)]
    assert mined(spark, rows, block=7) == plain(rows)


def test_scores_beyond_doubles(spark):
    """Inner products above 2^53 are summed as integers."""
    rows = [(i, [(60000.0 - 7000 * (i % 4)) + i / 256 + j for j in range(64)], i % 4) for i in range(101)]
    want = plain(rows)
    assert mined(spark, rows) == want and max(k[4] for k in want) > 2**53


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 120) + [(200, None, 1), (250, [nan] * 8, 1), (300, [None] + [0.1] * 7, 2), (350, [inf] * 8, 0), (400, [0.1] * 8, None), (None, [0.5] * 8, 0), (None, [0.5] * 8, 1),
                              (450, [0.0] * 8, 0), (500, [], 0), (550, [], 1), (600, [0.5] * 3, 0), (601, [0.5] * 3, 1), (602, [0.5] * 3, 0), (603, [0.45] * 3, 2), (50, [-0.3] * 8, 2), (2**31, [0.2] * 8, 2**31 - 1)]
    rows += rows[:60]  # repeated rows, anchors among them
    assert mined(spark, rows, block=40) == plain(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    clashing = spark.createDataFrame([(*r, 1, 2) for r in vectors(6, 60)], SCHEMA + ", row int, score int")
    assert Counter(tuple(r) for r in hard_negatives.hard_negatives(clashing).select(COLUMNS).collect()) == plain(vectors(6, 60))
